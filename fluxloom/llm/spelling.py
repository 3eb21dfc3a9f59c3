"""Spelling variants: words one letter apart, found by k-d trees over their letter counts.

One inserted, deleted or replaced letter moves a word's vector of letter counts by at most two in L1. A tree
per word length splits those vectors; a word searches the tree of its own length and that of the next one,
prunes every box that is too far, and compares the letters in order only with what is left.

Trees come in two levels. A small one per length, from a bounded sample of words, deals the words into cells,
and a word goes to each cell its range reaches; in a cell's task a tree over all of the cell's words finds the
pairs. What leaves a task is a count and the best neighbour per word, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.common import regrouped, staged

#: Runs of at least seven letters; shorter ones cannot give a word.
RUN = r"[A-Za-zÀ-ÿ]{7,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letter counts: a to z one each, other code points share the rest.
PLAIN, DIMENSIONS = 26, 90
#: Words of a cell, words of the sample that cells are drawn from, and words of a leaf of a cell's tree.
CELL, SAMPLE, LEAF = 32768, 200_000, 128
#: Bytes of letters, and pairs, that are held at once.
LETTERS, PAIRS = 16 << 20, 1 << 20


def corrupted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of all texts with their occurrences (word, n), not yet added up: some lose a letter.

    Runs of letters A to Z and U+00C0 to U+00FF, A to Z lower-cased. Where 31 divides the CRC32 of
    ``<id>:<run>`` the letter at that value modulo the length is deleted. Null texts have no words; a null id
    counts as empty. Results of fewer than seven letters are left out.
    """
    run = F.col("run")
    plain = F.length(run) == F.octet_length(run)
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    lower = runs.select("id", F.when(plain, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER)).alias("run"))
    marked = lower.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    words = marked.select(F.when(F.col("h") % 31 == 0, cut).otherwise(run).alias("word"), F.lit(1).cast("long").alias("n"))
    return words.where(F.length("word") >= 7)


class Tree:
    """A k-d tree over rows of counts, as arrays; leaves are numbered from left to right."""

    def __init__(self, counts: np.ndarray, leaf: int):
        self.dimension, self.cut, self.child, self.rows = [], [], [], []
        self.leaves = 0
        self._grow(counts, np.arange(len(counts)), leaf)

    def _grow(self, counts: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        """Split at the median of the dimension of largest variance that has a cut near it."""
        node = len(self.cut)
        for held in (self.dimension, self.cut, self.child):
            held.append(None)
        if len(rows) > leaf:
            here = counts[rows]
            for d in np.argsort(-here.var(axis=0), kind="stable")[:4]:
                value = np.sort(here[:, d])
                middle = int(value[len(value) // 2])
                cuts = [c for c in (middle - 1, middle) if value[0] <= c < value[-1]]
                if cuts:
                    cut = min(cuts, key=lambda c: abs(int((value <= c).sum()) - len(value) // 2))
                    self.dimension[node], self.cut[node] = int(d), cut
                    low = here[:, d] <= cut
                    self.child[node] = (self._grow(counts, rows[low], leaf), self._grow(counts, rows[~low], leaf))
                    return node
        self.child[node] = self.leaves
        self.rows.append(rows)
        self.leaves += 1
        return node

    def place(self, counts: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(counts), np.int64)
        held = [(0, np.arange(len(counts)))]
        while held:
            node, rows = held.pop()
            if self.cut[node] is None:
                out[rows] = self.child[node]
                continue
            low = counts[rows, self.dimension[node]] <= self.cut[node]
            held += [(child, some) for child, some in zip(self.child[node], (rows[low], rows[~low]), strict=True) if len(some)]
        return out

    def reach(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) for each leaf whose box a row meets by raising counts by ``up`` and lowering them by ``down`` in all."""
        n = len(counts)
        held = [(0, np.arange(n), np.full(n, up), np.full(n, down), {}, {})]
        while held:
            node, rows, ups, downs, low, high = held.pop()
            if self.cut[node] is None:
                yield self.child[node], rows
                continue
            d, cut = self.dimension[node], self.cut[node]
            at = counts[rows, d].astype(np.int64)
            # What this box asks of dimension d beyond what the boxes around it asked already.
            raised = ups - np.maximum(cut + 1 - at, 0) + np.maximum(low.get(d, 0) - at, 0)
            lowered = downs - np.maximum(at - cut, 0) + (np.maximum(at - high[d], 0) if d in high else 0)
            left, right = self.child[node]
            to_left, to_right = lowered >= 0, raised >= 0
            if to_left.any():
                held.append((left, rows[to_left], ups[to_left], lowered[to_left], low, {**high, d: cut}))
            if to_right.any():
                held.append((right, rows[to_right], raised[to_right], downs[to_right], {**low, d: cut + 1}, high))


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each word starts."""
    sizes = np.asarray(pa.compute.utf8_length(words), np.int64)
    joined = "".join(words.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, "<u4"), np.concatenate([[0], np.cumsum(sizes)])


def letter_counts(matrix: np.ndarray) -> np.ndarray:
    """Counts per letter of words of one length (rows of code points)."""
    slot = np.where((matrix >= 97) & (matrix <= 122), matrix.astype(np.int64) - 97, PLAIN + matrix.astype(np.int64) % (DIMENSIONS - PLAIN))
    slot += np.arange(len(matrix))[:, None] * DIMENSIONS
    return np.bincount(slot.ravel(), minlength=len(matrix) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.int32)


def _by_length(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the table, their letters as a matrix), a bounded number of letters at a time."""
    words = table.column("word")
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    flat, start = letters(words)
    sizes = np.diff(start)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        step = max(1, LETTERS // (4 * max(size, DIMENSIONS)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield size, some, flat[start[some][:, None] + np.arange(size)]


def cells(words: DataFrame) -> dict[int, Tree]:
    """A tree for each length with more words than a cell holds, from a bounded sample of all words."""
    sizes = dict(map(tuple, words.groupBy(F.length("word").alias("size")).count().collect()))
    total = sum(sizes.values())
    large = [s for s, n in sizes.items() if n > CELL]
    if not large:
        return {}
    some = words.where(F.length("word").isin(large) & (F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / total))))
    table = pa.Table.from_pylist([{"word": r.word} for r in some.orderBy("word").select("word").collect()], pa.schema([("word", pa.string())]))
    found: dict[int, list[np.ndarray]] = {}
    for size, _, matrix in _by_length(table):
        found.setdefault(size, []).append(letter_counts(matrix))
    return {
        size: Tree(counts, max(1, len(counts) * CELL // sizes[size]))
        for size, counts in ((size, np.concatenate(parts)) for size, parts in found.items())
    }


def _dealt(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Words per cell (size, cell, role, word, n): role 0 belongs there, 1 searches it for replaced letters, 2 for an inserted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(block, which, size, cell, role):
            k = len(which)
            fill = lambda v: pa.array(np.full(k, v) if np.isscalar(v) else v, pa.int32())
            return pa.RecordBatch.from_arrays(
                [fill(size), fill(cell), fill(role), block.column("word").take(pa.array(which)), block.column("n").take(pa.array(which))],
                names=["size", "cell", "role", "word", "n"],
            )

        for block in batches:
            if not block.num_rows:
                continue
            for size, some, matrix in _by_length(block):
                counts = letter_counts(matrix)
                own = trees[size].place(counts) if size in trees else np.zeros(len(some), np.int64)
                yield rows(block, some, size, own, 0)
                for cell, which in trees[size].reach(counts, 1, 1) if size in trees else ():
                    # Of two words in different cells the one in the lower cell searches.
                    which = which[own[which] < cell]
                    if len(which):
                        yield rows(block, some[which], size, cell, 1)
                for cell, which in trees[size + 1].reach(counts, 1, 0) if size + 1 in trees else ((0, np.arange(len(some))),):
                    yield rows(block, some[which], size + 1, cell, 2)

    return words.mapInArrow(run, "size int, cell int, role int, word string, n long")


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows where words ``a`` and ``b`` differ by one replaced letter, or by one that only ``b`` has."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front, back = a == b[:, :-1], a == b[:, 1:]
    prefix = np.where(front.all(axis=1), a.shape[1], (~front).argmax(axis=1)) if a.shape[1] else np.zeros(len(a), int)
    suffix = np.where(back.all(axis=1), a.shape[1], (~back[:, ::-1]).argmax(axis=1)) if a.shape[1] else prefix
    return prefix + suffix >= a.shape[1]


class _Near:
    """Near words of one side: how many, and the best by (largest n, smallest word)."""

    def __init__(self):
        self.parts = []
        self.held = 0

    def add(self, own: pa.Array, other: pa.Array, n: pa.Array):
        self.parts.append(pa.table({"word": own, "near": other, "n": n}))
        self.held += len(own)

    def out(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """Pairs so far, one row per word, once there are ``least`` of them."""
        if self.held < least:
            return
        table = pa.concat_tables(self.parts).sort_by([("word", "ascending"), ("n", "descending"), ("near", "ascending")]).combine_chunks()
        word = table.column("word").chunk(0).dictionary_encode()
        start = np.flatnonzero(np.diff(word.indices.to_numpy(), prepend=-1))
        best = table.take(pa.array(start))
        counts = np.diff(np.append(start, len(table)))
        columns = [best.column("word"), pa.array(counts, pa.int64()), best.column("n"), best.column("near")]
        yield from pa.table(columns, names=["word", "n_near", "best_n", "best"]).to_batches()
        self.parts, self.held = [], 0


def _hits(tree: Tree, points: np.ndarray, queries: np.ndarray, apart: int, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) pairs whose squared distance of letter counts is at most ``apart``.

    Counts of two words of one length that differ by one letter differ by +1 and -1; with a letter more, by +1
    alone. So the squared distance, one matrix product per leaf, decides the same as L1.
    """
    used = np.flatnonzero(points.any(axis=0) | queries.any(axis=0))
    kind = np.float32 if max(points.sum(axis=1).max(initial=0), queries.sum(axis=1).max(initial=0)) < 2048 else np.float64
    p, q = points[:, used].astype(kind), queries[:, used].astype(kind)
    pp, qq = (p * p).sum(axis=1), (q * q).sum(axis=1)
    for leaf, rows in tree.reach(queries, up, down):
        own = tree.rows[leaf]
        step = max(1, (4 * PAIRS) // max(1, len(own)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            d = q[some] @ p[own].T
            d *= -2
            d += qq[some][:, None]
            d += pp[own][None, :]
            i, j = np.nonzero(d <= apart)
            for cut in range(0, len(i), PAIRS):
                yield some[i[cut : cut + PAIRS]], own[j[cut : cut + PAIRS]]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each cell: rows arrive by cell, the cell's own words before those that search it."""
    near, home = _Near(), None
    for table in regrouped(batches, ["size", "cell", "role"]):
        size, role = table.column("size")[0].as_py(), table.column("role")[0].as_py()
        place = (size, table.column("cell")[0].as_py())
        found = list(_by_length(table))
        if role == 0:
            home, table0 = place, table
            matrix = np.concatenate([m for _, _, m in found])
            points = letter_counts(matrix)
            tree = Tree(points, LEAF)
        elif place != home:
            continue  # no word of this cell
        names, n = table0.column("word").combine_chunks(), table0.column("n").combine_chunks()
        asked, asked_n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
        for _, some, letters_of in found:
            queries = letter_counts(letters_of)
            for i, j in _hits(tree, points, queries, 1 if role == 2 else 2, 1, 0 if role == 2 else 1):
                if role == 0:
                    i, j = i[some[i] < j], j[some[i] < j]
                step = max(1, LETTERS // (4 * max(1, size)))
                for at in range(0, len(i), step):
                    a, b = i[at : at + step], j[at : at + step]
                    right = one_edit(letters_of[a], matrix[b])
                    a, b = pa.array(some[a[right]]), pa.array(b[right])
                    if len(a):
                        one, other = asked.take(a), names.take(b)
                        near.add(one, other, n.take(b))
                        near.add(other, one, asked_n.take(a))
                        yield from near.out(PAIRS)
    yield from near.out()


def variants(words: DataFrame, least: int = 2, factor: int = 10) -> DataFrame:
    """For each distinct word its form and root: (word, form, root, n, n_near, form_n).

    ``words`` (word string, n long) may repeat words; their n add up, and words below ``least`` are left out.
    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near
    word of largest n (ties: the smallest in code-point order) if that n is at least ``factor`` times its own;
    its root is where following forms ends. Null words are left out, a null n counts as 0, empty and very
    long words are compared like others; an empty table gives no rows; other columns are ignored.
    """
    known = words.where("word is not null").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n"))
    known = staged(known.where(F.col("n") >= least), "words")
    spread = max(32, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = _dealt(known, cells(known)).repartition(spread, "size", "cell").sortWithinPartitions("size", "cell", "role")
    pairs = dealt.mapInArrow(_search, "word string, n_near long, best_n long, best string")
    near = pairs.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("near"))).alias("best")
    )
    form_n = -F.col("best.n")
    formed = form_n >= factor * F.col("n")
    table = staged(
        known.join(near, "word", "left").select(
            "word",
            F.when(formed, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, form_n).alias("form_n"),
        ),
        "forms",
    )
    roots = table.where("form is not null").select("word", F.col("form").alias("root"))
    return table.join(_followed(roots), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _followed(roots: DataFrame) -> DataFrame:
    """The end of each chain (word, root), doubling the steps taken each round; n grows along a chain, so none is long."""
    while True:
        roots = staged(roots, "roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = staged(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not ahead.where("moved").limit(1).count():
            return ahead.drop("moved")
        roots = ahead.drop("moved")


def spelling_report(docs: DataFrame) -> DataFrame:
    """``variants`` of the words of all texts of ``docs``, some with a letter deleted by ``corrupted_words``."""
    return variants(corrupted_words(docs))


SPELLING_SQL = r"""
WITH RECURSIVE table_of(b, v, k) AS (
  SELECT range, range::UBIGINT, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END, k + 1 FROM table_of WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM table_of WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(
    [('0x' || x[2 * i - 1 : 2 * i])::UBIGINT for i in range(1, len(x) // 2 + 1)],
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h
  FROM counted, crc_table),
changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[1 : (h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2 :] ELSE run END AS word, n
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
  SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word AS a, b.word AS b, b.n AS n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
near AS (SELECT a AS word, count(*) AS n_near, max(n) AS best_n FROM pairs GROUP BY a),
best AS (SELECT p.a AS word, min(p.b) AS best FROM pairs p JOIN near k ON p.a = k.word AND p.n = k.best_n GROUP BY p.a),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
chain(word, tip) AS (
  SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.tip = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.tip AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms g ON g.word = c.tip AND g.form IS NULL
"""
