"""Exact top-k search by vector-approximation files, and near-duplicate embeddings by sign hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.llm.common import staged
from fluxloom.llm.components import components

# ---------------------------------------------------------------- exact top-k search

#: Vectors per block of the approximation file.
BLOCK = 2048
#: Queries scanned against a block at once.
QUERY_BLOCK = 256
#: One block in so many is scanned first, for the bounds that the whole scan starts from.
FIRST_BLOCKS = 4
#: Blocks of queries, and bytes of them, that a lane of the scans holds; beyond either there are more lanes.
REMEMBERED = 4096
HELD = 32 << 20
#: Scaled components from here on are refused: they, or cells around them, might not fit a long.
LARGEST = float(1 << 62)


def usable(vec: Column) -> Column:
    """True for a vector without null or non-finite components."""
    x = vec.cast("array<double>")
    return vec.isNotNull() & F.coalesce(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False)
    )


def scaled(vec: Column, scale: int) -> Column:
    """floor(scale * x) per component; one that does not fit is an error."""
    held = lambda y: F.when(F.abs(y) < LARGEST, F.floor(y)).otherwise(F.raise_error(F.lit("a scaled component does not fit a long")).cast("long"))
    return F.transform(vec.cast("array<double>"), lambda x: held(x * scale))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    lengths = np.asarray(pa.compute.list_value_length(column))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def approximation_file(vectors: DataFrame, width: int) -> DataFrame:
    """Blocks of vectors (vec_id, v) with one byte per component: which of 256 cells of the block's range it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BLOCK):
            x = _matrix(block.column(1), width)
            low = x.min(axis=0)
            step = (x.max(axis=0) - low) // 256 + 1
            codes = ((x - low) // step).astype(np.uint8)
            fields = [block.column(0).to_numpy().astype("<i8").tobytes(), low.tobytes(), step.tobytes(), codes.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.binary()) for f in fields], names=["ids", "low", "step", "codes"])

    return vectors.mapInArrow(run, "ids binary, low binary, step binary, codes binary")


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vec: str = "embedding", scale: int = 1024
) -> DataFrame:
    """The k highest integer inner products of each query row with all other rows: (query_id, rank, vec_id, score).

    1. Approximations: blocks of one-byte cells, read without the exact vectors. Every block of queries
       meets every block of cells on a grid of lanes: a lane holds some blocks of queries, at most HELD bytes,
       and reads some blocks of cells, so neither is multiplied by the other before it reaches its task.
       A cell's two ends bound the score from both sides. A first scan of one
       block in FIRST_BLOCKS gives each query a k-th best lower bound to start from, which a task raises as it
       goes. A pair is kept when its upper bound reaches that, then the k-th best lower bound of all blocks.
    2. Exact vectors in order of the bound: those of the k best bounds first, which gives the score to
       beat, then all whose bound still reaches it. The k-th result is then certain.

    Equal vectors beyond the k + 1 smallest ids cannot appear in a result and are left out first. Ties go
    to the smaller id. Scaled components from 2^62 on, and products and sums beyond a long, are errors. Vectors that are null or hold null, NaN or infinite components take no part; an
    empty vector scores 0; shorter vectors count as filled up with zeros; of rows that share an id the
    least vector counts. No queries or no candidates give no rows.
    """
    ready = vectors.where(usable(F.col(vec)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(vec), scale).alias("v"), is_query.alias("is_query")
    )
    ready = staged(ready.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query")), "vectors")
    width = ready.agg(F.max(F.size("v"))).first()[0] or 1
    copies = Window.partitionBy("v").orderBy("vec_id")
    rows = staged(
        ready.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).select("vec_id", "v"), "vectors"
    )
    spread = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, QUERY_BLOCK):
            need = block.column(2).to_numpy(zero_copy_only=False).astype(float)
            fields = [block.column(0).to_numpy().astype("<i8").tobytes(), _matrix(block.column(1), width).tobytes(), need.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.binary()) for f in fields], names=["query_ids", "queries", "need"])

    asked = ready.where("is_query").select("vec_id", "v")
    query_blocks = -(-asked.count() // QUERY_BLOCK) or 1

    across = -(-query_blocks // max(1, min(REMEMBERED, HELD // (QUERY_BLOCK * width * 8))))
    down = max(1, -(-spread // across))
    cells = staged(approximation_file(rows, width), "cells")

    def lanes(some: DataFrame, needs: DataFrame) -> DataFrame:
        """(lane, kind, a, b, c, d): per lane its blocks of queries, then its blocks of cells."""
        number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = lambda ids, n: F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")
        asking = needs.select("vec_id", "v", "need").repartition(query_blocks).mapInArrow(pack, "query_ids binary, queries binary, need binary")
        asking = asking.withColumn("x", dealt("query_ids", across)).withColumn("y", number(down))
        asking = asking.select((F.col("y") * across + F.col("x")).alias("lane"), F.lit(0).alias("kind"), "query_ids", "queries", "need", F.lit(None).cast("binary"))
        read = some.withColumn("y", dealt("ids", down)).withColumn("x", number(across))
        read = read.select((F.col("y") * across + F.col("x")).alias("lane"), F.lit(1).alias("kind"), "ids", "low", "step", "codes")
        return asking.union(read).toDF("lane", "kind", "a", "b", "c", "d").repartition(spread, "lane").sortWithinPartitions("lane", "kind")

    def asked_of(row: dict) -> dict:
        q = np.frombuffer(row["b"], np.int64).reshape(-1, width)
        best = np.full((len(q), k), -np.inf)
        parts = {"down": np.minimum(q, 0).astype(float), "up": np.maximum(q, 0).astype(float), "most": float(np.abs(q).max())}
        return parts | {"ids": np.frombuffer(row["a"], "<i8"), "q": q.astype(float), "need": np.frombuffer(row["c"], float), "best": best}

    def scored(asks: dict, ids: np.ndarray, at: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores at the lower ends of the cells, and what lies below and above; the best lower bounds are raised.

        A query's own score is minus infinity.
        """
        # Score at the cells' lower ends, and what their width can add or take away. Sums below
        # 2^52 are exact in doubles; beyond, the slack covers their rounding.
        base = asks["q"] @ at.T
        most = asks["most"] * (float(np.abs(at).max()) + float(step.max())) * width
        slack = 0.0 if most < 2.0**52 else most * 2.0**-45
        room = (step - 1).astype(float)
        base[asks["ids"][:, None] == ids] = -np.inf
        below, above = (asks["down"] @ room - slack)[:, None], (asks["up"] @ room + slack)[:, None]
        best = asks["best"]
        higher = np.flatnonzero(base.max(axis=1) + below[:, 0] > best.min(axis=1))
        both = np.concatenate([best[higher], base[higher] + below[higher]], axis=1)
        best[higher] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        return base, below, above

    def met(batches: Iterator[pa.RecordBatch], each, end) -> Iterator[pa.RecordBatch]:
        """``each`` of every block of queries and block of cells of a lane, ``end`` of each block of queries."""
        lane, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["lane"] != lane:
                    for asks in held:
                        yield from end(asks)
                    lane, held = row["lane"], []
                if row["kind"] == 0:
                    held.append(asked_of(row))
                    continue
                ids, low, step = np.frombuffer(row["a"], "<i8"), np.frombuffer(row["b"], np.int64), np.frombuffer(row["c"], np.int64)
                at = (np.frombuffer(row["d"], np.uint8).reshape(-1, width) * step + low).astype(float)
                for asks in held:
                    yield from each(asks, ids, *scored(asks, ids, at, step))
        for asks in held:
            yield from end(asks)

    def first_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def end(asks: dict) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(asks["ids"]), pa.array(list(asks["best"]), pa.list_(pa.float64()))], names=["query_id", "best"])

        return met(batches, lambda *_: (), end)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(asks: dict, ids: np.ndarray, base: np.ndarray, below: np.ndarray, above: np.ndarray) -> Iterator[pa.RecordBatch]:
            need = np.maximum(asks["best"].min(axis=1), asks["need"])
            i, j = np.nonzero((base + above >= need[:, None]) & (base > -np.inf))
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asks["ids"][i]), pa.array(ids[j]), pa.array(base[i, j] + below[i, 0]), pa.array(base[i, j] + above[i, 0])],
                    names=["query_id", "vec_id", "lower", "upper"],
                )

        return met(batches, each, lambda _: ())

    # k bounds per query and lane of the first scan; the limit on ranks cuts them before they are shuffled.
    open_ = asked.withColumn("need", F.lit(float("-inf")))
    some = cells.where(F.pmod(F.xxhash64("ids", F.lit(1)), F.lit(FIRST_BLOCKS)) == 0)
    lists = lanes(some, open_).mapInArrow(first_scan, "query_id long, best array<double>")
    of_query = Window.partitionBy("query_id")
    best = lambda *order: F.row_number().over(of_query.orderBy(*order))
    start = lists.select("query_id", F.explode("best").alias("bound")).withColumn("nth", best(F.desc("bound"))).where(F.col("nth") <= k)
    start = start.groupBy("query_id").agg(F.min("bound").alias("need"))
    needs = asked.join(start.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").fillna(float("-inf"), ["need"])
    needs = staged(needs, "needs")

    bounds = "query_id long, vec_id long, lower double, upper double"
    found = staged(lanes(cells, needs).mapInArrow(scan, bounds), "bounds")
    kth_lower = (
        found.withColumn("nth", best(F.desc("lower"))).where(F.col("nth") <= k).groupBy("query_id").agg(F.min("lower").alias("need"), F.count("*").alias("n"))
    )
    kth_lower = kth_lower.select("query_id", F.when(F.col("n") >= k, F.col("need")).otherwise(float("-inf")).alias("need"))
    candidates = staged(found.join(kth_lower, "query_id").where("upper >= need").select("query_id", "vec_id", "upper"), "candidates")
    exact = rows
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    read = lambda pairs: pairs.join(exact, "vec_id").join(asked, "query_id").select("query_id", "vec_id", product.alias("score"))
    first = staged(read(candidates.withColumn("nth", best(F.desc("upper"), "vec_id")).where(F.col("nth") <= k)), "scores")
    beat = first.groupBy("query_id").agg(F.min("score").alias("beat"), F.count("*").alias("n"))
    done = first.select("query_id", "vec_id")
    rest = candidates.join(beat, "query_id").where("upper >= beat").join(done, ["query_id", "vec_id"], "left_anti").select("query_id", "vec_id")
    return (
        first.union(read(rest))
        .withColumn("rank", best(F.desc("score"), "vec_id"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


# ---------------------------------------------------------------- near-duplicate embeddings

#: Vectors of a bucket that are compared in one piece; larger buckets are cut and compared piece by piece.
PIECE = 1024
#: Groups up to this size are compared by shifts, all groups of a batch at once.
SMALL_GROUP = 16


def tables_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Sign bits per key and number of tables for n vectors.

    Keys have log2(n) bits, so buckets of unrelated vectors stay small at any size. A pair just at the
    threshold agrees in one bit with probability p = 1 - angle / pi, in a key with p^bits, and the number of
    tables makes it meet somewhere with probability ``recall``; closer pairs meet almost surely.
    """
    bits = max(8, math.ceil(math.log2(max(n, 2))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


def _group_pairs(start: np.ndarray, end: np.ndarray):
    """Candidate pairs (i, j) of rows in small groups, by shifts."""
    group_end = np.repeat(end, end - start)
    rows = np.repeat(start, end - start) + np.arange((end - start).sum()) - np.repeat(np.cumsum(end - start) - (end - start), end - start)
    shift = 1
    while True:
        i = rows[rows + shift < group_end]
        if not len(i):
            return
        yield i, i + shift
        shift += 1


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a symmetric matrix of links connects: one per row at most."""
    label = np.arange(len(linked))
    while True:
        lowest = np.where(linked, label[None, :], len(linked)).min(axis=1)
        now = np.minimum(label, lowest)
        if (now == label).all():
            return [(i, int(a)) for i, a in enumerate(label) if i != a]
        label = now


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, recall: float = 0.95, vec_id: str = "vec_id", vec: str = "embedding", seed: int = 7
) -> DataFrame:
    """Clusters of embeddings with cosine of at least ``threshold``: (vec_id, n_links, component_id, kept).

    Random hyperplanes give each distinct vector one sign key per table. Vectors with a key in common are
    compared by exact cosine in double precision; a pair met in several tables counts in the first. A
    large bucket is cut into hashed pieces and piece meets piece, so no task holds more than two pieces.
    What leaves a task is a sum of links per vector and a forest of links, never all pairs.

    Equal vectors are one class: the class is compared once, its copies count as links of each other.
    Vectors that are null, empty, zero, or hold null, NaN or infinite components link with nothing and are
    returned with themselves as component, as are rows with a null id (component null). Vectors of
    different length never link. Repeated rows count as copies.
    """
    spark = vectors.sparkSession
    x = F.col(vec).cast("array<double>")
    sound = usable(F.col(vec)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False)) & F.col(vec_id).isNotNull()
    rows = staged(
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(sound, F.transform(x, lambda v: v + 0.0)).alias("v")), "vectors"
    )
    classes = staged(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "classes")
    links = None
    widths = classes.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).collect()
    for width, n in sorted(map(tuple, widths)):
        one = _links_of_width(classes.where(F.size("v") == width), width, n, threshold, recall, seed)
        links = one if links is None else links.union(one)
    if links is None:
        links = spark.createDataFrame([], "rep long, other long, n long")
    links = staged(links, "links")
    groups = components(links.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = links.where("other is null").groupBy("rep").agg(F.sum("n").alias("n"))
    answer = (
        classes.join(counts, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("v").alias("w"),
            (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return rows.join(answer, F.col("v") == F.col("w"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def _links_of_width(classes: DataFrame, width: int, n: int, threshold: float, recall: float, seed: int) -> DataFrame:
    """(rep, null, links) and (rep, other, null) for distinct vectors (v, rep, size) of one length."""
    bits, tables = tables_for(n, threshold, recall)
    planes = np.random.default_rng(seed).standard_normal((width, bits * tables))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for part in _blocks([batch], 4096):
                v = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                norm = np.sqrt((v / np.abs(v).max(axis=1, keepdims=True)) ** 2 @ np.ones(width))
                unit = v / np.abs(v).max(axis=1, keepdims=True) / norm[:, None]
                keys = ((unit @ planes) > 0).reshape(-1, tables, bits) @ weights
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1),
                        part.column(2),
                        pa.array([r.tobytes() for r in unit], pa.binary()),
                        pa.array([r.tobytes() for r in keys], pa.binary()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                    ],
                    names=["rep", "size", "unit", "keys", "key"],
                )

    signed = staged(classes.select("v", "rep", "size").mapInArrow(sign, "rep long, size long, unit binary, keys binary, key array<long>"), "signed")
    met = signed.select("rep", F.posexplode("key").alias("t", "key"))
    full = met.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # A bucket of n vectors is cut into ceil(n / PIECE) pieces; each piece meets itself and every other.
    cut = F.ceil(F.col("n") / PIECE).cast("int")
    dealt = (
        met.join(full, ["t", "key"])
        .select("rep", "t", "key", cut.alias("cut"), F.pmod(F.xxhash64("rep"), cut).cast("int").alias("own"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
        .select("rep", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    )
    vectors = signed.select("rep", "size", "unit", "keys")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            mark = np.stack([table.column(c).to_numpy() for c in ("t", "key", "i", "j")])
            change = np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1
            done = int(change[-1]) if len(change) else 0
            if done:
                yield from _compared(table.slice(0, done), np.concatenate([[0], change[:-1]]), change, width, tables, threshold)
            held = table.slice(done).combine_chunks().to_batches()[0] if done < len(table) else None
        if held is not None and held.num_rows:
            table = pa.Table.from_batches([held])
            yield from _compared(table, np.array([0]), np.array([held.num_rows]), width, tables, threshold)

    place = ["t", "key", "i", "j"]
    return (
        dealt.join(vectors, "rep")
        .select(*place, "own", "rep", "size", "unit", "keys")
        .repartition(*place)
        .sortWithinPartitions(*place)
        .mapInArrow(compare, "rep long, other long, n long")
    )


def _compared(table: pa.Table, start: np.ndarray, end: np.ndarray, width: int, tables: int, threshold: float):
    """Compare the rows of each group and give sums and forests of the links first met here."""
    column = lambda c: table.column(c).to_numpy()
    rep, size, own, t = column("rep"), column("size"), column("own"), column("t")
    paired = column("i") != column("j")
    unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), float).reshape(-1, width)
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(-1, tables)
    counts = np.zeros(len(rep), np.int64)
    edges = []

    def confirm(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fresh = ~((keys[i] == keys[j]) & (np.arange(tables) < t[i, None])).any(axis=1) & ~(paired[i] & (own[i] == own[j]))
        i, j = i[fresh], j[fresh]
        np.add.at(counts, i, size[j])
        np.add.at(counts, j, size[i])
        return i, j

    small = end - start <= SMALL_GROUP
    for i, j in _group_pairs(start[small], end[small]) if small.any() else ():
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        i, j = confirm(i[near], j[near])
        edges += zip(rep[i].tolist(), rep[j].tolist(), strict=True)
    for a, b in zip(start[~small].tolist(), end[~small].tolist(), strict=True):
        linked = unit[a:b] @ unit[a:b].T >= threshold
        i, j = np.nonzero(np.triu(linked, 1))
        for at in range(0, len(i), 1 << 16):
            confirm(i[at : at + (1 << 16)] + a, j[at : at + (1 << 16)] + a)
        edges += [(int(rep[a + i]), int(rep[a + j])) for i, j in _forest(linked)]
    some = np.flatnonzero(counts)
    left, right = (np.array(e, np.int64) for e in (zip(*edges, strict=True) if edges else ((), ())))
    none = lambda n: pa.nulls(n, pa.int64())
    names = ["rep", "other", "n"]
    yield pa.RecordBatch.from_arrays([pa.array(rep[some]), none(len(some)), pa.array(counts[some])], names=names)
    yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), none(len(left))], names=names)


_SOUND_SQL = """embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"""

TOP_K_SQL = f"""
WITH ready AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings WHERE {_SOUND_SQL}),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)])::BIGINT AS score
  FROM ready q JOIN ready c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

NEAR_SQL = f"""
WITH RECURSIVE ready AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE {_SOUND_SQL} AND len([x for x in embedding if x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ready a JOIN ready b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 9e-1),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN lowest ON lowest.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""
