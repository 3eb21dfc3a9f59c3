"""Removal of passages that occur more than once, by a distributed sort of sampled suffixes.

A byte goes when some ``span`` bytes that cover it start anywhere else too. Sorting the suffixes of all
positions would move hundreds of bytes per byte of text. The sort here takes a sample that loses nothing:

1. Anchors. Every string of ``span`` bytes is anchored at the least-hashed ``GRAM`` bytes in it. Equal strings
   are anchored at equal grams at equal distances, and the strings at neighbouring positions mostly share
   their anchor, so a text has one anchor for some dozens of positions. Grams that occur once in all texts
   anchor no repeated string; their positions leave here.
2. Suffixes. The positions of one anchor are a suffix: the text from the first position to the end of the
   last string. Tasks sort their suffixes behind their grams, write them as front-coded runs (what a suffix
   shares with the one before it is a number, not bytes), and exchange the runs by gram.
3. Merge. Runs meet in a loser tree that keeps, for each waiting suffix, how far it agrees with the last one
   put out. Of two suffixes the one that agrees longer is smaller, without a look at bytes; only suffixes
   that agree equally long are compared, from there on.
4. Groups. Suffixes of one gram come out together. A suffix that comes out twice is repeated as a whole; if
   different suffixes share a gram, their single strings are matched by distance from the gram and a hash.

A suffix that a task has met twice is known to be repeated and is sent no more; a gram that occurs more often
than one task should hold sends no suffixes but its strings' hashes, dealt by text, into one further exchange, and so does
a gram with many different suffixes. So neither a passage
in a third of all texts nor one with ever new surroundings gathers in one task. "Equal" means equal bytes or
equal 64-bit hashes behind equal 64-bit gram hashes.

Defined results: a null text is empty; texts shorter than ``span`` keep everything; a copy of a text, also a
repeated row, makes it go as a whole; matches never cross texts; an empty table gives no rows; extra
columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.common import mix64, partitions, regrouped, rolling, runs, slices, staged, text_bytes
from fluxloom.llm.jaccard import _columns, _packed

SPAN = 200
GRAM = 32
#: Bytes of text handled at once in a task, bytes of text per route and per range of grams.
PIECE = 1 << 20
ROUTE = 4 << 20
#: Different suffixes of one gram that are matched in one task.
VARIANTS = 4096
#: Occurrences of one gram whose suffixes are gathered in one task.
HOT = 1 << 16
#: Bytes of suffixes whose strings are matched at once.
MATCHED = 1 << 20


# ---------------------------------------------------------------- anchors


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchored(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(first position, last position, gram hash, anchor, hash of the suffix) of the suffixes of the rows in ``data``."""
    ends = offsets[1:]
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE + span - 1]
        if len(part) < span:
            continue
        roll = rolling(part)
        grams = roll.windows(gram)
        # The position in the low bits makes the first of equal grams the least, and tells which it is.
        least = _least((grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64), span - gram + 1)
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        position = np.arange(at, at + len(anchor))
        row_end = ends[np.minimum(np.searchsorted(ends, position, side="right"), len(ends) - 1)] if len(ends) else position
        sound = np.flatnonzero(position + span <= row_end)
        if not len(sound):
            continue
        own = anchor[sound]
        cuts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (sound[1:] != sound[:-1] + 1)]))
        first, last = sound[cuts], sound[np.append(cuts[1:], len(sound)) - 1]
        anchor = own[cuts]
        whole = roll.of(first, last + span) ^ mix64((anchor - first).astype(np.uint64))
        # Chosen grams have small hashes: hashed once more they spread evenly over the ranges.
        yield first + at, last + at, mix64(grams[anchor]), anchor + at, whole


# ---------------------------------------------------------------- front-coded runs


def sorted_run(suffixes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (rows of bytes, filled up with zeros), and what each shares with the one before it."""
    padded = np.concatenate([suffixes, lengths.astype(">u2")[:, None].view(np.uint8)], axis=1)
    order = np.argsort(np.ascontiguousarray(padded).view(f"V{padded.shape[1]}")[:, 0], kind="stable")
    rows, size = suffixes[order], lengths[order]
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
    return order, shared


class run:
    """Reader of one front-coded run: the current suffix, what it shares with the one before, and its payload."""

    __slots__ = ("shared", "rest", "data", "at", "i", "text", "payload")

    def __init__(self, shared: bytes, rest: bytes, data: bytes, payload: list):
        self.shared = np.frombuffer(shared, np.uint16).tolist()
        self.rest = np.frombuffer(rest, np.uint16).tolist()
        self.data, self.payload, self.at, self.i, self.text = data, payload, 0, -1, b""

    def advance(self) -> int:
        """Step to the next suffix; returns what it shares with the last, or -1 at the end."""
        self.i += 1
        if self.i == len(self.shared):
            return -1
        h, end = self.shared[self.i], self.at + self.rest[self.i]
        self.text = self.text[:h] + self.data[self.at : end]
        self.at = end
        return h


def agreement(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix of a and b, known to be h at least."""
    end = min(len(a), len(b))
    while h < end:
        step = min(32, end - h)
        x = int.from_bytes(a[h : h + step]) ^ int.from_bytes(b[h : h + step])
        if x:
            return h + step - (x.bit_length() + 7) // 8
        h += step
    return end


def merged(readers: list[run]) -> Iterator[tuple[bytes, int, object]]:
    """Suffixes of sorted runs in order, with what each shares with the one before it, and its payload."""
    size = 1
    while size < len(readers):
        size *= 2
    agree = [r.advance() for r in readers] + [-1] * (size - len(readers))
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser). Both agreements refer to the same suffix, the last one that came this way."""
        ha, hb = agree[a], agree[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        if ha < 0:
            return a, b
        x, y = readers[a].text, readers[b].text
        h = agreement(x, y, ha)
        if x[h : h + 1] <= y[h : h + 1]:
            agree[b] = h
            return a, b
        agree[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, loser[node] = play(build(2 * node), build(2 * node + 1))
        return w

    winner = build(1)
    while agree[winner] >= 0:
        r = readers[winner]
        yield r.text, agree[winner], r.payload[r.i]
        agree[winner] = r.advance()
        node = (winner + size) >> 1
        while node:
            other = loser[node]
            if agree[winner] != agree[other]:
                if agree[winner] < agree[other]:
                    loser[node], winner = winner, other
            else:
                winner, loser[node] = play(winner, other)
            node >>= 1


# ---------------------------------------------------------------- groups


class matcher:
    """Repeated strings among the different suffixes of each gram; gathers groups and solves many at once."""

    def __init__(self, span: int):
        self.span = span
        self.clear()

    def clear(self):
        self.texts, self.group, self.distance, self.times, self.owner, self.start = [], [], [], [], [], []
        self.bytes = 0

    def add(self, group: int, variants: list) -> None:
        for text, distance, times, owner, start in variants:
            self.texts.append(text)
            self.group.append(group)
            self.distance.append(distance)
            self.times.append(times)
            self.owner.append(owner)
            self.start.append(start)
            self.bytes += len(text)

    def _hashes(self):
        """Per string: a hash of gram, distance and bytes; its suffix; its place in it."""
        lengths = np.array([len(t) for t in self.texts])
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        count = lengths - self.span + 1
        begin = np.repeat(np.cumsum(lengths) - lengths, count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        which = np.repeat(np.arange(len(lengths)), count)
        position = begin + place
        text = rolling(data).of(position, position + self.span)
        side = (np.array(self.distance)[which] - place).astype(np.uint64) << np.uint64(32)
        return mix64(text ^ mix64(side + np.array(self.group, np.uint64)[which])), which, place

    def solve(self) -> dict[str, list]:
        """Spans (owner, lo, hi) of the suffixes that are not known to be repeated as a whole."""
        rows: dict[str, list] = {"kind": [], "h": [], "k": [], "lo": [], "hi": []}
        if self.texts:
            h, which, place = self._hashes()
            times = np.array(self.times)
            _, group = np.unique(h, return_inverse=True)
            often = np.bincount(group, weights=times[which])[group] > 1
            hit = often & (times[which] == 1)
            which, place = which[hit], place[hit]
            if len(which):
                cut = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1)]))
                end = np.append(cut[1:], len(which)) - 1
                start = np.array(self.start)[which[cut]]
                rows = {
                    "kind": np.zeros(len(cut), np.int32), "h": np.zeros(len(cut), np.int64), "k": np.array(self.owner, np.int64)[which[cut]],
                    "lo": start + place[cut], "hi": start + place[end] + self.span,
                }
        self.clear()
        return rows

    def scatter(self) -> dict[str, list]:
        """Every string as a hash with its place, for the exchange of grams with too many different suffixes."""
        h, which, place = self._hashes()
        start = np.array(self.start)[which] + place
        rows = {
            "kind": np.array(self.times, np.int32)[which], "h": h.view(np.int64), "k": np.array(self.owner, np.int64)[which],
            "lo": start, "hi": start + self.span,
        }
        self.clear()
        return rows


# ---------------------------------------------------------------- job

_RUN = dict(
    part=pa.int32(), kind=pa.int32(), shared=pa.binary(), rest=pa.binary(), data=pa.binary(), distance=pa.binary(), times=pa.binary(),
    owner=pa.binary(), start=pa.binary(),
)
_SPANS = dict(kind=pa.int32(), h=pa.int64(), k=pa.int64(), lo=pa.int64(), hi=pa.int64())


def _suffix_rows(parts: np.ndarray, data: np.ndarray, first, last, grams, anchors, times, owner, start, span: int) -> dict[str, list]:
    """One front-coded run per range of grams."""
    rows: dict[str, list] = {k: [] for k in _RUN}
    order = np.argsort(parts, kind="stable")
    width = int((last - first).max()) + span if len(first) else 0
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    for a, b in runs(parts[order]):
        own = order[a:b]
        lengths = last[own] - first[own] + span
        text = padded[first[own][:, None] + np.arange(width)]
        text[np.arange(width) >= lengths[:, None]] = 0
        text = np.concatenate([grams[own].astype(">u8")[:, None].view(np.uint8), text], axis=1)
        rank, shared = sorted_run(text, lengths + 8)
        own, text, lengths = own[rank], text[rank], lengths[rank] + 8
        keep = (np.arange(text.shape[1]) >= shared[:, None]) & (np.arange(text.shape[1]) < lengths[:, None])
        rows["part"].append(int(parts[own[0]]))
        rows["kind"].append(1)
        rows["shared"].append(shared.astype(np.uint16).tobytes())
        rows["rest"].append((lengths - shared).astype(np.uint16).tobytes())
        rows["data"].append(text[keep].tobytes())
        rows["distance"].append((anchors - first)[own].astype(np.int32).tobytes())
        rows["times"].append(times[own].astype(np.int32).tobytes())
        rows["owner"].append(owner[own].tobytes())
        rows["start"].append(start[own].astype(np.int64).tobytes())
    return rows


def _hot_rows(data: np.ndarray, first, last, grams, anchors, times, owner, start, span: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Every string of the suffixes as a hash with its place, in pieces that go to any part."""
    loose = matcher(span)
    for i in range(len(first)):
        text = data[first[i] : last[i] + span].tobytes()
        loose.add(int(grams[i]), [[text, int(anchors[i] - first[i]), int(times[i]), int(owner[i]), int(start[i])]])
        if loose.bytes >= MATCHED // 16 or i == len(first) - 1:
            part = int(owner[i]) & ((1 << bits) - 1)
            found = loose.scatter()
            rows = dict(
                part=[part], kind=[2], data=[found["h"].tobytes()], times=[found["kind"].tobytes()], owner=[found["k"].tobytes()],
                start=[found["lo"].astype(np.int64).tobytes()],
            )
            yield _columns(rows, _RUN)


def _texts(docs: DataFrame, routes: int) -> DataFrame:
    k = F.xxhash64("doc_id", "text")
    return docs.select("doc_id", "text", k.alias("k"), F.pmod(k, F.lit(routes)).cast("int").alias("route"))


def repeated_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(k, lo, hi): byte ranges to remove from the document with ``k = xxhash64(doc_id, text)``; they may overlap."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = partitions(n_bytes, ROUTE)
    bits = max(5, (n_bytes // (2 * ROUTE)).bit_length())
    gram = min(GRAM, span)
    hot_from = HOT
    long_ones = _texts(docs, routes).where(F.octet_length("text") >= span)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=PIECE):
                data, offsets = text_bytes(part.column(0))
                route = part.column(1).to_numpy().astype(np.int64)
                for first, _, grams, _, _ in anchored(data, offsets, span, gram):
                    row = np.searchsorted(offsets, first, side="right") - 1
                    own = runs(row)
                    rows = _packed([grams[a:b] for a, b in own], route[row[[a for a, _ in own]]], bits)
                    yield _columns(rows, dict(part=pa.int32(), elements=pa.binary(), owners=pa.binary()))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regrouped(batches, ["part"]):
            elements = [np.frombuffer(e, np.uint64) for e in table.column("elements").to_pylist()]
            owners = []
            for o in table.column("owners").to_pylist():
                n = int(np.frombuffer(o, np.int64, 1)[0])
                owners.append(np.frombuffer(o, np.int64, n, 8)[np.frombuffer(o, np.int32, offset=8 + 8 * n)].astype(np.int32))
            element, route = np.concatenate(elements), np.concatenate(owners)
            order = np.argsort(element, kind="stable")
            element, route = element[order], route[order]
            same = element[1:] == element[:-1]
            often = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            element, route = element[often], route[often]
            _, which, many = np.unique(element, return_inverse=True, return_counts=True)
            hot = many[which] > hot_from
            rows: dict[str, list] = {"route": [], "hot": [], "grams": []}
            for some, is_hot in ((~hot, 0), (hot, 1)):
                order = np.lexsort((element[some], route[some]))
                elements, routes_ = element[some][order], route[some][order]
                for a, b in runs(routes_):
                    for c, v in zip(rows, (int(routes_[a]), is_hot, np.unique(elements[a:b]).tobytes()), strict=True):
                        rows[c].append(v)
            yield _columns(rows, dict(route=pa.int32(), hot=pa.int64(), grams=pa.binary()))

    met = long_ones.select("text", "route").mapInArrow(sketch, "part int, elements binary, owners binary")
    met = met.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "route int, hot long, grams binary")
    texts = long_ones.select("route", F.lit(1).alias("kind"), "k", "text", F.lit(None).cast("binary").alias("grams"))
    none = lambda t: F.lit(None).cast(t)
    both = texts.union(met.select("route", F.lit(0), "hot", none("string"), "grams"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot, route = np.zeros(0, np.uint64), np.zeros(0, np.uint64), -1
        sent, certain = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            routes_, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in runs(2 * routes_.astype(np.int64) + kinds):
                if routes_[a] != route:
                    known, hot, route = np.zeros(0, np.uint64), np.zeros(0, np.uint64), routes_[a]
                if kinds[a] == 0:
                    new = [np.frombuffer(g, np.uint64) for g in batch.column(4).slice(a, b - a).to_pylist()]
                    known = np.unique(np.concatenate([known, *new]))
                    is_hot = batch.column(2).slice(a, b - a).to_pylist()
                    hot = np.unique(np.concatenate([hot, *[g for g, h in zip(new, is_hot, strict=True) if h]]))
                    continue
                for part in slices(batch.slice(a, b - a), limit=PIECE) if len(known) else ():
                    data, offsets = text_bytes(part.column(3))
                    key = part.column(2).to_numpy()
                    for first, last, grams, anchors, whole in anchored(data, offsets, span, gram):
                        some = np.isin(grams, known)
                        first, last, grams, anchors, whole = (x[some] for x in (first, last, grams, anchors, whole))
                        row = np.searchsorted(offsets, first, side="right") - 1
                        owner, start = key[row], first - offsets[row]
                        # Of equal suffixes in this task the first goes out, the second tells that it is repeated.
                        _, once, which, many = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                        before = np.isin(whole[once], sent)
                        double = (many > 1) | before
                        hit = double[which]
                        rows = dict(
                            part=[int(key[0] & ((1 << bits) - 1))], kind=[0], owner=[owner[hit].tobytes()], start=[start[hit].tobytes()],
                            data=[(last - first + span)[hit].astype(np.int64).tobytes()],
                        )
                        if hit.any():
                            yield _columns(rows, _RUN)
                        go = once[~np.isin(whole[once], certain)]
                        times = np.where(double[which[go]], 2, 1)
                        certain = np.concatenate([certain, whole[go][times > 1]])
                        sent = np.concatenate([sent, whole[once[~before]]])
                        loose = np.isin(grams[go], hot)
                        at = go[loose]
                        yield from _hot_rows(data, first[at], last[at], grams[at], anchors[at], times[loose], owner[at], start[at], span, bits)
                        go, times = go[~loose], times[~loose]
                        if len(go):
                            parts = (grams[go] >> np.uint64(64 - bits)).astype(np.int64)
                            yield _columns(
                                _suffix_rows(parts, data, first[go], last[go], grams[go], anchors[go], times, owner[go], start[go], span), _RUN
                            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regrouped(batches, ["part", "kind"]):
            if table.column("kind")[0].as_py() == 0:
                read = lambda c: np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()])  # noqa: E731, B023
                k, lo = read("owner"), read("start")
                zero = np.zeros(len(k), np.int32)
                yield _columns(dict(kind=zero, h=zero.astype(np.int64), k=k, lo=lo, hi=lo + read("data")), _SPANS)
                continue
            if table.column("kind")[0].as_py() == 2:
                for r in table.select(["data", "times", "owner", "start"]).to_batches():
                    for h, t, k, lo in zip(*(c.to_pylist() for c in r.columns), strict=True):
                        lo = np.frombuffer(lo, np.int64)
                        yield _columns(
                            dict(kind=np.frombuffer(t, np.int32), h=np.frombuffer(h, np.int64), k=np.frombuffer(k, np.int64), lo=lo, hi=lo + span), _SPANS
                        )
                continue
            readers = []
            for r in table.select(["shared", "rest", "data", "distance", "times", "owner", "start"]).to_pylist():
                payload = [np.frombuffer(r[c], t).tolist() for c, t in (("distance", np.int32), ("times", np.int32), ("owner", np.int64), ("start", np.int64))]
                readers.append(run(r["shared"], r["rest"], r["data"], list(zip(*payload, strict=True))))
            yield from _groups(readers, span)

    sorted_runs = both.repartition("route").sortWithinPartitions("route", "kind").mapInArrow(
        cut, "part int, kind int, shared binary, rest binary, data binary, distance binary, times binary, owner binary, start binary"
    )
    spans = sorted_runs.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(merge, "kind int, h long, k long, lo long, hi long")
    spans = staged(spans, "spans")
    # Strings of grams with too many suffixes: kind counts how often each row's string was met.
    loose = spans.where("kind > 0")
    twice = loose.groupBy("h").agg(F.sum("kind").alias("times")).where("times > 1").select("h")
    return spans.where("kind = 0").select("k", "lo", "hi").union(loose.where("kind = 1").join(twice, "h").select("k", "lo", "hi"))


def _groups(readers: list[run], span: int) -> Iterator[pa.RecordBatch]:
    """Merge runs and find what is repeated in each group of one gram."""
    few, many = matcher(span), matcher(span)
    whole: dict[str, list] = {"kind": [], "h": [], "k": [], "lo": [], "hi": []}
    variants: list = []
    spilled = False

    def repeated(owner: int, start: int, length: int) -> None:
        for c, v in zip(whole, (0, 0, owner, start, start + length), strict=True):
            whole[c].append(v)

    def close(gram: bytes) -> Iterator[pa.RecordBatch]:
        number = int.from_bytes(gram)
        if spilled:
            many.add(number, variants)
            yield _columns(many.scatter(), _SPANS)
        elif len(variants) > 1:
            few.add(number, variants)
            if few.bytes >= MATCHED:
                yield _columns(few.solve(), _SPANS)

    last = b""
    for text, shared, (distance, times, owner, start) in merged(readers):
        if shared < 8:
            if last:
                yield from close(last[:8])
            variants, spilled = [], False
        elif shared == len(text) == len(last):
            # The same suffix again: both are repeated as a whole.
            v = variants[-1]
            if v[2] == 1:
                v[2] = 2
                repeated(v[3], v[4], len(v[0]))
            if times == 1:
                repeated(owner, start, len(v[0]))
            continue
        if len(variants) >= VARIANTS:
            many.add(int.from_bytes(text[:8]), variants)
            yield _columns(many.scatter(), _SPANS)
            variants, spilled = [], True
        variants.append([text[8:], distance, times, owner, start])
        last = text
        if len(whole["k"]) >= 1 << 16:
            yield _columns(whole, _SPANS)
            whole = {c: [] for c in whole}
    if last:
        yield from close(last[:8])
    yield _columns(few.solve(), _SPANS)
    yield _columns(whole, _SPANS)


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went, and in how many stretches."""
    spans.sort()
    out, at, n = [], 0, 0
    end = -1
    for lo, hi in spans:
        if lo > end:
            n += 1
            out.append(text[at:lo])
            end = hi
        end = max(end, hi)
        at = end
    out.append(text[at:])
    left = b"".join(out)
    return left, len(text) - len(left), n


def remove_repeats(docs: DataFrame, span: int = SPAN, report: bool = False) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; a character of which a byte goes is dropped.

    With ``report`` instead doc_id, n_bytes, n_removed, n_spans and kept_sha256, on bytes as they are.
    """
    spans = repeated_spans(docs, span)
    columns = ["doc_id"] if report else [c for c in docs.columns if c != "text"]
    texts = docs.select(
        F.xxhash64("doc_id", "text").alias("k"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"),
        F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("absent"),
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"),
    )
    row_type = texts.schema["row"].dataType
    none = lambda t: F.lit(None).cast(t)
    both = texts.union(spans.select("k", F.lit(0), "lo", "hi", none("string"), none("boolean"), none(row_type)))
    if report:
        out = dict(n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept_sha256=pa.string())
        fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    else:
        out, fields = dict(text=pa.string()), "text string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = None, []
        for batch in batches:
            keys, kinds, los, his = (batch.column(i).to_pylist() for i in range(4))
            is_text = [i for i, kind in enumerate(kinds) if kind == 1]
            rows: dict[str, list] = {c: [] for c in out}
            for i, k in enumerate(keys):
                if k != own:
                    own, found = k, []
                if kinds[i] == 0:
                    found.append((los[i], his[i]))
                    continue
                text = batch.column(4)[i].as_py().encode()
                left, removed, n = _kept(text, found)
                if report:
                    for c, v in zip(out, (len(text), removed, n, hashlib.sha256(left).hexdigest()), strict=True):
                        rows[c].append(v)
                else:
                    rows["text"].append(None if batch.column(5)[i].as_py() else left.decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(6).take(pa.array(is_text, pa.int64())), *[pa.array(rows[c], t) for c, t in out.items()]], names=["row", *out]
            )

    done = both.repartition("k").sortWithinPartitions("k", "kind", "lo").mapInArrow(apply, f"row {row_type.simpleString()}, {fields}")
    named = {c: F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)}
    if report:
        return done.select(named["doc_id"], *out)
    return done.select(*[F.col("text") if c == "text" else named[c] for c in docs.columns])


def repeat_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text"), report=True)
