"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source is expected ``target / source_size`` times. The expected copies are summed
along the source's documents in order of size, one random offset per source is added, and a document
is emitted once per integer boundary that its own share crosses. Neighbours in the order have like
sizes, so the words taken come near the target, off by about the largest document at most.

The running sum is ``rank * rate``. Ranks come from counts: of documents per source and size, then of
a hashed slice within a size, then of rows within the slice. No window holds the documents of a hot
source or of a hot size.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a source
of size 0 has target 0 and emits nothing; a document of size 0 takes 0 words; repeated rows are
documents of their own; an empty table gives no rows. Columns other than doc_id, text and source are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.llm.common import hex_unit, n_words

#: Sources weigh 1, 2, 3, 1, 2, 3, ... by code point.
CYCLE = 3
#: No source is repeated more often than this.
MAX_REPEATS = 3
#: Documents of one source and size are dealt into 16 to this power hashed slices.
SLICE_DIGITS = 3


def hex_slice(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, SLICE_DIGITS), 16, 10).cast("int")


def source_targets(sizes: DataFrame, cycle: int = CYCLE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """Target words per source from (source, source_size): one row per source in and out.

    Targets are ``min(cap, level * weight)`` with one level for all, which is where resharing the excess
    ends. The level follows from running sums over the sources in order of cap per weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    fill = Window.orderBy("cap_per_weight", F.col("source").isNull(), F.col("source").cast("binary"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weighed = (
        sizes.withColumn("weight", (F.row_number().over(order) - 1) % cycle + 1)
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("cap_per_weight", F.col("cap").cast("double") / F.col("weight"))
    )
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    levelled = weighed.withColumn("level", left.cast("double") / F.sum("weight").over(after))
    open_levels = F.when(F.col("level") <= F.col("cap_per_weight"), F.col("level"))
    return levelled.withColumn("level", F.min_by("level", F.when(open_levels.isNotNull(), F.col("cap_per_weight"))).over(everything)).select(
        "source",
        "source_size",
        F.when(F.col("cap_per_weight") <= F.col("level"), F.col("cap").cast("double"))
        .otherwise(F.col("level") * F.col("weight"))
        .alias("target"),
    )


def mix_sources(docs: DataFrame, seed: int = 0, cycle: int = CYCLE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """All columns of ``docs`` under ``doc`` with size, source_size, target and copies."""
    return _mixed(docs, docs.columns, seed, cycle, max_repeats)


def _mixed(docs: DataFrame, kept: list[str], seed: int, cycle: int, max_repeats: float) -> DataFrame:
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"),
        F.col("source"),
        n_words(F.col("text")).alias("size"),
        F.col("doc_id"),
    ).withColumn("slice", hex_slice(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    counted = sized.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    by_size = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(
        by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cycle, max_repeats
    )
    running = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    size_starts = by_size.select(
        F.col("source").alias("s1"),
        F.col("size").alias("z1"),
        F.coalesce(F.sum("n").over(running("source").orderBy("size")), F.lit(0)).alias("size_start"),
    ).join(targets.withColumnRenamed("source", "s0"), F.col("s0").eqNullSafe(F.col("s1"))).drop("s0")
    starts = (
        counted.select(
            F.col("source").alias("s2"),
            F.col("size").alias("z2"),
            F.col("slice").alias("i2"),
            F.coalesce(F.sum("n").over(running("source", "size").orderBy("slice")), F.lit(0)).alias("slice_start"),
        )
        .join(size_starts, F.col("s1").eqNullSafe(F.col("s2")) & (F.col("z1") == F.col("z2")))
        .select("s2", "z2", "i2", (F.col("size_start") + F.col("slice_start")).alias("start"), "source_size", "target")
        .repartition("s2", "z2", "i2")  # else the join would deal all documents by source and size alone
    )
    ranked = sized.withColumn(
        "within", F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("doc_id"))
    ).join(
        starts, F.col("s2").eqNullSafe(F.col("source")) & (F.col("z2") == F.col("size")) & (F.col("i2") == F.col("slice"))
    )
    offset = hex_unit(F.concat(F.coalesce(F.col("source"), F.lit("")), F.lit(f"/{seed}")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("start") + F.col("within")
    copies = F.floor(rank * F.col("rate") + F.col("offset")) - F.floor((rank - 1) * F.col("rate") + F.col("offset"))
    return ranked.withColumns({"offset": offset, "rate": rate}).select(
        "doc", "size", "source_size", "target", copies.cast("long").alias("copies")
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each document as often as it was taken, with its own columns."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def mix_report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Per document: how many words the mixture takes from it."""
    return _mixed(docs, ["doc_id"], seed, CYCLE, MAX_REPEATS).select(
        "doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


#: The same in SQL: ranks by windows over whole sources.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size,
         (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight,
         source_size * 3 AS cap
  FROM sizes),
levels AS (
  SELECT *, cap::DOUBLE / weight AS r,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source IS NULL, encode(source)
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source IS NULL, encode(source)
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT source, source_size,
         CASE WHEN r <= lv THEN cap::DOUBLE ELSE lv * weight END AS target
  FROM (SELECT *, (SELECT arg_min(level, r) FROM levels WHERE level <= r) AS lv FROM levels)),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate,
         ('0x' || substr(md5(coalesce(s.source, '') || '/0'), 1, 8))::BIGINT / 4294967296e0 AS shift,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size,
           ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 3))::BIGINT, s.doc_id NULLS FIRST) AS k
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, (floor(k * rate + shift) - floor((k - 1) * rate + shift))::BIGINT AS copies FROM placed)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, copies * size AS taken, copies FROM counted
"""
