"""Exact duplicates, spelling variants and whitening against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.llm import exact, spelling, whitening
from tests.llm import cases
from workload.compare import connect, difference

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- exact duplicates


def body(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_duplicates(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(body(t), []).append(d)
    out, seen = [], set()
    for d, t in rows:
        ids = groups[body(t)]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep and (body(t), d) not in seen, hashlib.sha256(body(t).encode()).hexdigest()))
        seen.add((body(t), d))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [128, 2, 0])
def test_duplicates_of_awkward_texts(spark, monkeypatch, bits):
    monkeypatch.setattr(exact, "HEAVY", 8)
    monkeypatch.setattr(exact, "STEP", 2)
    docs = cases.edge_docs(spark)
    weak = {128: exact.content_hash, 2: lambda sha: F.substring(F.hex(sha), 1, 1), 0: lambda sha: F.lit("same")}[bits]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = exact.duplicate_report(docs, fingerprint=weak)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_duplicates(rows)
    kept = exact.keep_first(docs, fingerprint=weak)
    assert kept.columns == docs.columns
    expected = sorted(((d, body(t)) for (d, t) in rows if (d, body(t)) in {(k, body(u)) for k, u in best(rows)}), key=repr)
    assert sorted({(r.doc_id, body(r.text)) for r in kept.collect()}, key=repr) == sorted(set(expected), key=repr)
    assert kept.count() == len({body(t) for _, t in rows})


def best(rows):
    lowest = {}
    for d, t in rows:
        old = lowest.get(body(t), (None,))[0]
        lowest[body(t)] = (d if old is None else old if d is None else min(d, old),)
    return [(d, t) for t, (d,) in lowest.items()]


def test_one_row_repeated_very_often(spark):
    docs = spark.range(20_000).select((F.col("id") * 0).alias("doc_id"), F.lit("a \n b").alias("text"))
    got = exact.duplicate_report(docs)
    assert got.count() == 20_000
    assert got.where("kept").count() == 1
    assert exact.keep_first(docs).collect()[0].text == "a \n b"


def test_duplicates_match_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    problem, _ = difference(exact.duplicate_report(docs), connect(SF), exact.DUPLICATE_SQL)
    assert problem is None, problem
    assert exact.duplicate_report(cases.no_docs(spark)).count() == 0
    assert exact.keep_first(cases.no_docs(spark)).count() == 0


# ---------------------------------------------------------------- spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, least=2, factor=10):
    counts = {w: n for w, n in counts.items() if n >= least}
    others = {w: [v for v in counts if v != w and near(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) if vs else None for w, vs in others.items()}
    form = {w: v if v is not None and counts[v] >= factor * counts[w] else None for w, v in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or ("" if form[w] == "" else None), root(w), n, len(others[w]), counts[form[w]] if form[w] is not None else None) for w, n in counts.items())


def invented(seed, n, alphabet="abcdeé", sizes=(4, 9)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(*sizes))) for _ in range(n)}
    for w in rng.sample(sorted(words), n // 3):
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]}
    return {w: rng.choice([1, 2, 3, 5, 20, 60, 700, 9000]) for w in words}


@pytest.mark.parametrize("cell, leaf", [(32768, 128), (60, 8), (20, 3)])
def test_variants_of_invented_words(spark, monkeypatch, cell, leaf):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "PAIRS", 256 if leaf < 128 else 1 << 20)
    counts = invented(cell, 900) | {"": 50, "a": 4, "x" * 30_000: 5, "x" * 29_999: 50, "中文字典": 30, "中文字田": 3, "abcdefg": None, "😀bcdefg": 2}
    rows = [(w, n, "z") for w, n in counts.items()] + [(None, 5, None), ("abcde", 7, "z"), ("abcde", 7, "z")]
    counts = {w: n or 0 for w, n in counts.items()}
    counts["abcde"] = counts.get("abcde", 0) + 14
    words = spark.createDataFrame(rows, "word string, n long, size string")
    assert sorted(map(tuple, spelling.variants(words).collect())) == brute_variants(counts)


def test_tree_reaches_every_word_in_range():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, (400, 6)).astype(np.int32)
    tree = spelling.Tree(counts, 5)
    assert sorted(np.concatenate(tree.rows).tolist()) == list(range(400))
    reached = {(int(r), leaf) for leaf, rows in tree.reach(counts, 1, 1) for r in rows}
    home = tree.place(counts)
    for i, j in itertools.product(range(400), repeat=2):
        step = counts[j] - counts[i]
        if step[step > 0].sum() <= 1 and step[step < 0].sum() >= -1:
            assert (i, home[j]) in reached
    assert len(reached) < 400 * tree.leaves / 2


def test_words_of_awkward_texts(spark):
    docs = cases.edge_docs(spark)
    expected = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(cases.UP)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                expected[word] += 1
    got = spelling.corrupted_words(docs).groupBy("word").agg(F.sum("n").alias("n")).collect()
    assert {r.word: r.n for r in got} == expected
    assert spelling.spelling_report(cases.no_docs(spark)).count() == 0


def test_chains_end_at_the_root(spark):
    words = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl"]
    rows = [(w, 2 * 10**i) for i, w in enumerate(words)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert set(got.values()) == {words[-1]}


def test_variants_match_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    problem, rows = difference(spelling.spelling_report(docs), connect(SF), spelling.SPELLING_SQL)
    assert problem is None and rows > 100, problem


# ---------------------------------------------------------------- whitening


def brute_whitened(vectors, components=4):
    width = max(map(len, vectors))
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (width - len(v)) for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    w = (x - sums / n) @ u / np.sqrt(e)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, w, e / (centred**2).sum() * n


def vectors_of(seed=1, n=500, width=12):
    rng = np.random.default_rng(seed)
    spread = rng.normal(size=(width, width)) * np.linspace(3, 0.2, width)
    return (rng.normal(size=(n, width)) @ spread + 5).tolist()


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, n string, x int")


def test_whitening_of_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 64)
    good = list(enumerate(vectors_of()))
    good += [(1000 + i, good[3][1]) for i in range(90)] + [(None, good[4][1]), (7, good[7][1]), (2000, []), (2001, [2.0, 3.0])]
    bad = [(3000, None), (3001, [1.0, None]), (3002, [float("nan")] * 12), (3003, [float("inf")] * 12)]
    got = whitening.whiten(table(spark, good + bad)).collect()
    n, deviation, w, explained = brute_whitened([v for _, v in good])
    assert len(got) == 4 * len(good)
    sign = {}
    at = {}
    for k, (i, _) in enumerate(good):
        at.setdefault(i, k)
    for r in got:
        k, c = at[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (n, deviation[k])
        assert r.explained == pytest.approx(explained[c], rel=1e-9)
        sign.setdefault(c, np.sign(r.whitened * w[k, c]))
        assert r.whitened * sign[c] == pytest.approx(w[k, c], abs=1e-8)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_large_entries_are_exact(spark):
    rows = [(i, [float(x) * 2.0**12 for x in v]) for i, v in enumerate(vectors_of(3, 60, 4))]
    n, deviation, w, explained = brute_whitened([v for _, v in rows])
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 240
    for r in got:
        assert r.deviation == deviation[r.vec_id]
        assert abs(r.whitened) == pytest.approx(abs(w[r.vec_id, r.component - 1]), abs=1e-8)
    with pytest.raises(Exception, match="does not fit a long"):
        whitening.whiten(table(spark, [(1, [1e30]), (2, [0.0])])).collect()


def test_degenerate_vectors(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(table(spark, [(i, [i / 256, 2 * i / 256, 3.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1}
    assert sorted(abs(r.whitened) for r in line) == pytest.approx(sorted(abs(i - 2) / np.sqrt(2) for i in range(5)))
    assert line[0].explained == pytest.approx(1)


def test_factor_and_rotations():
    rng = np.random.default_rng(0)
    for n, rank in [(1, 1), (5, 5), (6, 3), (40, 40)]:
        g = rng.normal(size=(n, rank))
        a = g @ g.T
        f = whitening.pivoted_cholesky(a)
        assert f.shape == (n, rank) and np.allclose(f @ f.T, a)
        values, axes = whitening.one_sided_jacobi(f)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank])
        assert np.allclose(axes.T @ axes, np.eye(rank)) and np.allclose(a @ axes, axes * values)
