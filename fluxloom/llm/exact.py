"""Exact duplicates: groups by 128-bit content hash, bytes compared inside groups, the smallest id stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.common import staged
from fluxloom.session import broadcast_if_small

SPACE = r"[\x20\x09-\x0D]+"
#: Hash lists up to this many bytes are sent to the tasks that read the texts.
SENT = 16 << 20
#: Groups that hold more than one row in HEAVY are looked up by broadcast: there are fewer than HEAVY of them.
HEAVY = 1024
#: Copies of one row that are written out per step.
STEP = 4096


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def content_hash(digest: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.substring(digest, 1, 16)


def _keyed(docs: DataFrame, doc_id: str, text: str, fingerprint: Callable[[Column], Column]) -> DataFrame:
    whole = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("body"), F.struct("*").alias("row"))
    digests = whole.withColumn("sha", F.unhex(F.sha2("body", 256)))
    return digests.withColumn("h", fingerprint(F.col("sha")))


def _classes(keyed: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Rows (doc_id, sha, h, copies), classes of equal texts (h, body, keep_id, n), and whether hashes collide.

    Groups are counted by hash without their texts. Texts of groups of two and more are then compared: an
    aggregate keyed by hash and text finds each distinct text once per task, so neither a hot group nor its
    bytes meet in one place. ``body`` is null unless two texts share the hash.
    """
    rows = staged(keyed.groupBy("doc_id", "sha", "h").agg(F.count("*").alias("copies")), "digests")
    groups = staged(rows.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("n")), "groups")
    several = staged(groups.where("n > 1").select("h"), "several")
    texts = keyed.select("h", "body").join(broadcast_if_small(several, SENT), "h", "left_semi").groupBy("h", "body").agg(F.count("*").alias("n"))
    clashing = staged(texts.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "clashing")
    if clashing.isEmpty():
        return rows, groups.select("h", F.lit(None).cast("string").alias("body"), "keep_id", "n"), False
    apart = keyed.join(clashing, "h", "left_semi").groupBy("h", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    plain = groups.join(clashing, "h", "left_anti").select("h", F.lit(None).cast("string").alias("body"), "keep_id", "n")
    return rows, staged(plain.union(apart.select("h", "body", "keep_id", "n")), "groups"), True


def _looked_up(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``keep_id`` and ``n`` of their class. Heavy classes are few and go to every task, others by hash."""
    share = max(1, total // HEAVY)
    named = classes.select(F.col("h").alias("class_h"), F.col("body").alias("class_body"), "keep_id", "n")
    same = F.col("h") == F.col("class_h")
    if "body" in rows.columns:
        same = same & (F.col("class_body").isNull() | (F.col("class_body") == F.col("body")))
    heavy = named.where(F.col("n") > share)
    of_heavy = rows.join(F.broadcast(heavy), same)
    others = rows.join(F.broadcast(heavy), same, "left_anti").join(named.where(F.col("n") <= share), same)
    return of_heavy.union(others).drop("class_h", "class_body")


def duplicate_report(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fingerprint: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after each run of ASCII white space became one space; null counts as
    empty. Of equal texts the row with the smallest id stays; a null id stays only where no row has one. Rows
    that share text and id are copies of which one stays. Texts are compared whole, whatever their length; an
    empty table gives no rows; other columns are ignored.
    """
    keyed = _keyed(docs, doc_id, text, fingerprint)
    rows, classes, clash = _classes(keyed)
    if clash:
        rows = keyed.groupBy("doc_id", "sha", "h", "body").agg(F.count("*").alias("copies"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / STEP)))
    copy = F.explode(F.sequence(F.col("part") * STEP, F.least(F.col("copies"), (F.col("part") + 1) * STEP) - 1))
    return (
        _looked_up(rows, classes, total)
        .withColumn("part", part)
        .withColumn("copy", copy)
        .select(
            "doc_id",
            "keep_id",
            F.col("n").alias("group_size"),
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def keep_first(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fingerprint: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """The rows of ``docs`` that ``duplicate_report`` keeps, with all their columns and their text as it is.

    Of rows that share text and id, and differ in other columns only, any one stays.
    """
    keyed = _keyed(docs, doc_id, text, fingerprint)
    _, classes, _ = _classes(keyed)
    several = staged(classes.where("n > 1"), "several").select(
        F.col("h").alias("class_h"), F.col("body").alias("class_body"), "keep_id"
    )
    same = (F.col("h") == F.col("class_h")) & (F.col("class_body").isNull() | (F.col("class_body") == F.col("body")))
    met = keyed.join(broadcast_if_small(several, SENT), same, "left")
    alone = met.where("class_h is null").select("row.*")
    first = met.where(F.col("class_h").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return alone.union(first.groupBy("h", "body").agg(F.first("row").alias("row")).select("row.*"))


DUPLICATE_SQL = r"""
WITH ready AS (
  SELECT doc_id, sha256(body) AS text_sha256, body FROM (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents))
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM ready WINDOW same AS (PARTITION BY body)
"""
