"""Small tables with every awkward case, and brute-force versions of the operators."""

import hashlib
import re

import numpy as np

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside.
CLASHING = "n, key, size, score, doc, kind, row, copies, rank, lane, part, slice, found, element, k, lo, text2"

LONG = " ".join(f"wort{i % 977}x{i}" for i in range(40_000))
BASE = " ".join(f"basis{i}" for i in range(120))


def texts():
    near = [BASE.replace(f"basis{i} ", f"anders{i} ") for i in range(5, 100, 9)]
    chain = [" ".join(f"kette{i}" for i in range(k, k + 60)) for k in range(0, 40, 4)]
    return [
        None, "", "   \n\t ", "Eins", "eins", "zwei wörter", LONG, LONG + " ende", BASE, BASE, BASE.upper(), *near, *chain,
        "a b c d e", "A  B\nC d E", "i d i o t", "x" * 500, "x" * 500, "é" * 300, "Ein Satz." + "\n" + "é" * 300, "<|endoftext|> Los.", "12 34 !!",
    ]


def edge_docs(spark):
    """Documents with nulls in every column, repeated rows and extra columns whose names clash."""
    rows = [(i, t, [None, "de", "en"][i % 3], [None, "src0", "src1", "src1"][i % 4], len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[8], rows[8], (None, BASE, "de", "src0", 1), (None, None, None, None, None), (900, "only here", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING.split(", "):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def no_docs(spark):
    return edge_docs(spark).limit(0)


def shingles(text, width=5):
    words = WORD.findall((text or "").translate(UP))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in nodes}


def near_copies(docs):
    """{doc_id: (n, component)} of (doc_id, text) by comparing all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    own = components(ids, links)
    return {d: (len(sets[d]), own[d]) for d in ids}


def without_repeats(rows, span):
    """(bytes, removed, stretches, digest of the rest) of each text, by a table of all strings."""
    data = [(t or "").encode() for t in rows]
    seen = {}
    for b in data:
        for i in range(len(b) - span + 1):
            s = b[i : i + span]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out
