"""Best-fit packing by minimum bin slack.

Documents become token ids and are cut into pieces of at most ``capacity`` tokens. Per bin, a bitset
subset-sum over the lengths still there finds the fullest combination, which is then removed. Only the
number of pieces of each length matters for that, so the search runs on a histogram of at most
``capacity`` rows, whatever the number of documents, and a combination is used as often as the
histogram allows before the next search. Pieces then take the places of their length by rank; ranks
come from counts of hashed slices, so no task holds a hot length.

Texts are tokenised word by word: the vocabulary's pre-tokeniser never joins across white space, so
each distinct word of a task is encoded once and looked up from then on by a 64-bit hash.

Defined results: null and empty texts are the closing id alone; a document given twice is packed
twice; an empty table gives no rows; extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.llm.common import rolling, runs, slices, staged, text_bytes

CAPACITY = 4096
CLOSING_ID = 1
#: Hashed slices of the pieces of one length.
SLICES = 4096
#: A task forgets its encoded words beyond so many, to bound its memory.
CACHED_WORDS = 1 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """Definition of a public tokenizer; it travels to the tasks as text."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


class word_ids:
    """Token ids of the distinct words seen so far, by hash."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.clear()

    def clear(self):
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for ids in encoded for i in ids), np.uint32, int(counts.sum()))
        starts = len(self.ids) + np.cumsum(counts) - counts
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        self.ids = np.concatenate([self.ids, flat])

    @staticmethod
    def simplified(data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Fewer distinct words with the same ids: A-Z in lower case, and closing marks on their own.

        The tokenizer lower-cases, and it parts letters and digits from marks. Words with "<" are left
        as they are, as special tokens are spelled with it and are looked for before lower-casing.
        """
        low = np.where((data >= 65) & (data <= 90), data | 32, data)
        seen = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == ord("<"), out=seen[1:])
        special = seen[end] > seen[start]
        for a, b in zip(start[special].tolist(), end[special].tolist(), strict=True):
            low[a:b] = data[a:b]
        closing = np.isin(low, np.frombuffer(b".,;:!?#$%&*)", np.uint8))
        tail = np.maximum.accumulate(np.where(closing, -1, np.arange(len(low))))[end - 1] + 1
        last = low[np.maximum(tail - 1, 0)]
        plain = ((last >= 97) & (last <= 122)) | ((last >= 48) & (last <= 57))
        cut = (tail > start) & (tail < end) & plain & ~special
        return low, np.sort(np.concatenate([start, tail[cut]])), np.sort(np.concatenate([end, tail[cut]]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the offset at which each row begins."""
        data, offsets = text_bytes(column)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges], after[edges - 1] = True, True
        start = np.flatnonzero(~space & before)
        end = np.flatnonzero(~space & after) + 1
        data, start, end = self.simplified(data, start, end)
        hashes = rolling(data).of(start, end)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > CACHED_WORDS:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == distinct[known]
        if not known.all():
            raw, fresh = data.tobytes(), first[~known]
            words = [raw[a:b].decode() for a, b in zip(start[fresh].tolist(), end[fresh].tolist(), strict=True)]
            self.learn(distinct[~known], words)
            at = np.searchsorted(self.hashes, distinct)
        at = at[which]
        counts = self.counts[at]
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        ids = self.ids[np.repeat(self.starts[at] - total[:-1], counts) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, offsets)]


def tokenize_pieces(
    docs: DataFrame, definition: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, keep_ids: bool = False
) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; with ``keep_ids`` also its ids, as little-endian 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(definition)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = coder.encode(part.column(1))
                rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc, a, b in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(closing_id)).astype("<u4").tobytes()
                    for k, at in enumerate(range(0, len(own), 4 * capacity)):
                        piece = own[at : at + 4 * capacity]
                        rows["doc_id"].append(doc)
                        rows["piece"].append(k)
                        rows["start"].append(at // 4)
                        rows["length"].append(len(piece) // 4)
                        rows["ids_crc32"].append(zlib.crc32(piece))
                        if keep_ids:
                            rows["ids"].append(piece)
                types = dict(doc_id=pa.int64(), piece=pa.int32(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64())
                if keep_ids:
                    types["ids"] = pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in types.items()], names=list(types))

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def minimum_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for so many pieces of each length: (times used, [(length, pieces of it per bin)]).

    Every bin starts with the longest piece left. Bit s of ``reach[i]`` tells whether the first i lengths
    can fill s; the search ends as soon as the rest of the bin can be filled to the last token.
    """
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left)
    bins = []
    while order:
        head = order[-1]
        room = capacity - head
        mask = (1 << (room + 1)) - 1
        reach, steps = [1], []
        for i in range(bisect_left(order, room + 1) - 1, -1, -1):
            n = order[i]
            spare = left[n] - (n == head)
            now = reach[-1]
            for _ in range(min(spare, room // n)):
                grown = (now | now << n) & mask
                if grown == now:
                    break
                now = grown
                reach.append(now)
                steps.append(n)
            if now >> room & 1:
                break
        fill = reach[-1].bit_length() - 1
        taken = {head: 1}
        for i in range(len(steps) - 1, -1, -1):
            if not reach[i] >> fill & 1:
                taken[steps[i]] = taken.get(steps[i], 0) + 1
                fill -= steps[i]
        times = min(left[n] // k for n, k in taken.items())
        bins.append((times, sorted(taken.items(), reverse=True)))
        for n, k in taken.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                order.pop(bisect_left(order, n))
    return bins


def places(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Per length and combination: the ranks it takes, its first bin, how many bins, and where in the bin."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, content in bins:
        at = 0
        for n, k in content:
            rows.append((n, used.get(n, 0), base, times, at))
            used[n] = used.get(n, 0) + k * times
            at += n * k
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "times", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to staged pieces (doc_id, piece, length, ...)."""
    keyed = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(SLICES)).cast("int"))
    counted = staged(keyed.groupBy("length", "slice").agg(F.count("*").alias("n")), "lengths")
    table = places(minimum_slack({r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("n")).collect()}, capacity))
    starts = counted.select(
        F.col("length").alias("l"),
        F.col("slice").alias("i"),
        F.coalesce(
            F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    ).repartition("l", "i")  # else the join would deal all pieces by length alone, as the window is dealt
    ranked = (
        keyed.withColumn("within", F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece")))
        .join(starts, (F.col("l") == F.col("length")) & (F.col("i") == F.col("slice")))
        .select(*pieces.columns, (F.col("before") + F.col("within") - 1).alias("rank"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The table is sorted by length and rank: one key of both finds each piece's row.
        firsts, where = np.unique(table["length"], return_index=True)
        ends = np.append(where[1:], len(table["length"]))
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            row = np.zeros(len(rank), np.int64)
            group = np.searchsorted(firsts, length)
            order = np.argsort(group, kind="stable")
            for a, b in runs(group[order]):
                own, g = order[a:b], group[order[a]]
                row[own] = where[g] + np.searchsorted(table["rank"][where[g] : ends[g]], rank[own], side="right") - 1
            nth = rank - table["rank"][row]
            times = table["times"][row]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            added = [pa.array(table["bin"][row] + nth % times), pa.array(table["offset"][row] + nth // times * length)]
            yield pa.RecordBatch.from_arrays(columns + added, names=batch.schema.names[:-1] + ["sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, definition: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document goes."""
    return pack(staged(tokenize_pieces(docs, definition or tokenizer_json(), capacity), "pieces"), capacity)


def sequences(docs: DataFrame, definition: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids as little-endian 32-bit, and where documents begin."""
    packed = pack(staged(tokenize_pieces(docs, definition or tokenizer_json(), capacity, keep_ids=True), "pieces"), capacity)
    # A sequence holds at most ``capacity`` tokens, so the list is bounded.
    return packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("parts")
    ).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("parts", lambda x: x["offset"]).alias("offsets"),
    )
