"""Small helpers that several operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxloom.session import shared_folder, staged

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of a numpy kernel takes at once.
CHUNK = 2 << 20

__all__ = ["WORD", "documents", "staged", "shared_folder", "n_words", "mix64", "rolling", "slices", "partitions", "hex_unit"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_unit(text: Column) -> Column:
    """A number in [0, 1) from the first eight hexadecimal digits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def smallest_digests(df: DataFrame, group: str, n: int) -> DataFrame:
    """Of each group the n rows (group, doc_id) whose ids have the smallest digests, as a bounded sample.

    A share of twice n rows of the group is taken by digest first, so that ranking sees some 2 n rows per group
    however large the table is. There must be few groups: their sizes come to the driver.
    """
    ids = df.select(group, "doc_id")
    sizes = ids.groupBy(group).count().collect()
    if not sizes:
        return ids
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r[0], 2.0 * n / r[1])]), F.col(group))
    digest = F.md5(F.col("doc_id").cast("string"))
    some = ids.where(hex_unit(F.col("doc_id").cast("string")) < share)
    nth = F.row_number().over(Window.partitionBy(group).orderBy(digest, "doc_id"))
    return some.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def partitions(n_bytes: int, each: int = 4 << 20, least: int = 32) -> int:
    """Number of partitions so that each gets about ``each`` bytes."""
    return max(least, math.ceil(n_bytes / each))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class rolling:
    """Hashes of any byte ranges of a buffer, from one prefix sum of a polynomial modulo 2^64.

    Equal ranges have equal hashes wherever they lie and whichever process computes them.
    """

    _tables: list = []

    def __init__(self, data: np.ndarray):
        n = len(data)
        if not rolling._tables or len(rolling._tables[1]) <= n:
            size = 1 << max(16, n.bit_length())
            base = 0x9E3779B97F4A7C15
            up = np.full(size, base, np.uint64)
            down = np.full(size, pow(base, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            letter = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
            rolling._tables[:] = [letter, np.cumprod(up), np.cumprod(down)]
        letter, up, self.down = rolling._tables
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letter[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + size)

    def windows(self, width: int) -> np.ndarray:
        """Hash of each window of ``width`` bytes."""
        m = len(self.sums) - width
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[width:] - self.sums[:m]) * self.down[:m] + np.uint64(width))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK):
    """Cut an Arrow batch into runs of whole rows of about ``limit`` bytes of ``column``."""
    text = batch.column(batch.schema.get_field_index(column))
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0), dtype=np.int64)
    start, total = 0, 0
    for i, size in enumerate(lengths):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(lengths):
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_binary())
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; words do not cross rows."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = True, True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def regrouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of batches sorted by ``keys``: each table holds the rows of one group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        mark = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys])
        cuts = np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1
        bounds = np.concatenate([[0], cuts, [batch.num_rows]])
        if held and (mark[:, 0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = mark[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal neighbours."""
    if not len(x):
        return []
    cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return list(zip(cuts.tolist(), np.append(cuts[1:], len(x)).tolist(), strict=True))
