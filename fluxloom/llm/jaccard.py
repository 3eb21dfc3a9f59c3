"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets of Jaccard similarity t
share at least t times the larger one, so if both are put in one global order and cut to their first
``n - ceil(t n) + l`` elements, these prefixes share l elements at least. The join works on prefixes only:

1. Documents of equal sets form a class; one of them stands for it.
2. A first prefix, in order of the hash, whose length l grows with the set: a class that does not find
   enough of its prefix in any other class's prefix links with nothing. Most documents end here.
3. What is left counts its shingles. Those that no other class has cannot be shared and come first in the
   final order, then the rarer ones. Each class now picks its own l: from prefix length to prefix length
   it weighs the postings to read against the pairs to be verified, which fall with l.
4. Classes with a prefix element in common are candidates if they share l of them, the smaller l of both;
   candidates are verified on their whole sets. As only reachability is asked for, a pair already connected
   needs no test. First every list of postings is tied to its first class, which parts the classes into
   neighbourhoods that no candidate pair crosses. A neighbourhood that fits a task is searched there, from
   each class to all classes not yet reached. In a larger one every list meets one leader at a time, all
   over the cluster, until the open pairs are few, which are then tested, or leaders bring little more: then
   its classes are dealt into blocks, and every two blocks meet in a task that looks for links between groups.
   So a group of thousands of near copies costs a few tests per member, and no pair that could connect two
   components is left out.

Defined results: null and empty texts have an empty set and link with nothing; a text of fewer words than a
shingle is one shingle; rows with a null id link with nothing and have no component; repeated rows are copies
of each other; an empty table gives no rows; extra columns are not looked at. Two different shingles share a
hash with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.common import mix64, regrouped, rolling, runs, slices, staged, text_bytes, word_spans
from fluxloom.llm.components import components
from fluxloom.session import broadcast_if_small

SHINGLE = 5
#: Similarity in hundredths.
SIMILARITY = 75
#: The first prefix asks for one match in so many elements of the set, besides one.
FIRST_MATCH = 10
#: Matches a class may ask for in its final prefix.
CHOICES = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32])
#: Postings that cost as much as comparing one element of a candidate's set.
ELEMENT_COST = 0.125
#: Owners of postings that stand for several classes of one step.
STAND_INS = np.array([-1, -2])
#: Elements of one hash range that a task holds at once, about.
RANGE = 1 << 20
#: Elements of a neighbourhood that one task searches; larger ones are searched all over the cluster.
NEIGHBOURHOOD = 1 << 22
#: There all open pairs are tested when they are at most so many times the postings. After so many rounds of leaders that
#: brought fewer links than this share of the classes, blocks of about so many elements meet in pairs.
OPEN_PAIRS = 2
VAIN_ROUNDS = 2
WORTH = 0.25
BLOCK = 1 << 20
#: Times that a class's bound is taken again over the classes that are left, where more than MANY are searched together.
PRUNINGS = 3
MANY = 64
#: Words of bits that cost as much as a posting.
READS = 3


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row. A-Z count as a-z; words are parted by ASCII white space."""
    data, offsets = text_bytes(column)
    data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    start, end = word_spans(data, offsets)
    words = rolling(data).of(start, end)
    first = np.searchsorted(start, offsets)
    factor = mix64(np.arange(1, width + 1, dtype=np.uint64) << np.uint64(8)) | np.uint64(1)
    # Hash of the ``width`` words from each word on; those that cross a row are not used.
    total = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        total += words[k : k + len(total)] * factor[k]
    total = mix64(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(total[a : b - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = (words[a:b] * factor[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n, similarity: int = SIMILARITY):
    """Least overlap of a set of n elements with a similar one."""
    return -(-n * similarity // 100)


def first_match(n):
    return 1 + n // FIRST_MATCH


def _packed(elements: list[np.ndarray], owners: np.ndarray, bits: int) -> dict[str, list]:
    """Postings by hash range: per range the elements, and for each the place of its owner in ``owners``."""
    lengths = np.array([len(e) for e in elements])
    flat = np.concatenate(elements) if len(elements) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(elements), dtype=np.int32), lengths)
    part = (flat >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(flat), np.int64)
    order = np.argsort(part, kind="stable")
    part, flat, owner = part[order], flat[order], owner[order]
    rows: dict[str, list] = {"part": [], "elements": [], "owners": []}
    for a, b in runs(part):
        used, place = np.unique(owner[a:b], return_inverse=True)
        rows["part"].append(int(part[a]))
        rows["elements"].append(flat[a:b].tobytes())
        rows["owners"].append(np.int64(len(used)).tobytes() + owners[used].tobytes() + place.astype(np.int32).tobytes())
    return rows


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (element, owner) of one hash range."""
    elements, owners = [], []
    for e, o in zip(table.column("elements").to_pylist(), table.column("owners").to_pylist(), strict=True):
        elements.append(np.frombuffer(e, np.uint64))
        n = int(np.frombuffer(o, np.int64, 1)[0])
        owners.append(np.frombuffer(o, np.int64, n, 8)[np.frombuffer(o, np.int32, offset=8 + 8 * n)])
    element, owner = np.concatenate(elements), np.concatenate(owners)
    order = np.lexsort((owner, element))
    element, owner = element[order], owner[order]
    fresh = np.concatenate([[True], (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])])
    return element[fresh], owner[fresh]


def _frequency(element: np.ndarray) -> np.ndarray:
    cuts = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1], [True]]))
    return np.repeat(np.diff(cuts), np.diff(cuts))


def _bits(n_elements: float) -> int:
    return max(5, int(np.ceil(np.log2(max(n_elements / RANGE, 1)))))


def _columns(rows: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    n = max((len(v) for v in rows.values()), default=0)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[k], t) if k in rows else pa.nulls(n, t) for k, t in types.items()], names=list(types)
    )


def _sketches(docs: DataFrame, similarity: int) -> DataFrame:
    """Steps 1 and 2: (doc_id, n, key, key2) for every row, and (key, found) for first prefixes, by kind."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _bits(n_bytes / 6 * (1 - similarity / 100 + 1 / FIRST_MATCH))
    types = dict(
        part=pa.int32(), kind=pa.int32(), doc_id=pa.int64(), n=pa.int64(), key=pa.int64(), key2=pa.int64(), elements=pa.binary(), owners=pa.binary()
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(1))
                sizes, key, key2 = set_keys(sets)
                rows = dict(part=list(key & ((1 << bits) - 1)), kind=[0] * len(sets), doc_id=part.column(0), n=sizes, key=key, key2=key2)
                yield _columns(rows, types)
                # Sets that this task has sent before need not go again.
                able = np.flatnonzero(np.asarray(part.column(0).is_valid()) & (sizes > 0))
                once = able[np.unique(key[able], return_index=True)[1]]
                once = once[~np.isin(key[once], seen)]
                seen = np.concatenate([seen, key[once]])
                cut = (sizes - needed(sizes, similarity) + first_match(sizes))[once]
                flat = np.concatenate([sets[i][:c] for i, c in zip(once, cut, strict=True)] or [np.zeros(0, np.uint64)])
                owner = np.repeat(key[once], cut)
                distinct, which, times = np.unique(flat, return_inverse=True, return_counts=True)
                # What several classes share already here counts here, and goes out for two stand-ins only: a
                # shingle that very many documents have costs two postings per step, not one per document.
                double = times[which] > 1
                local, found = np.unique(owner[double], return_counts=True)
                yield _columns(dict(part=local & ((1 << bits) - 1), kind=[2] * len(local), n=found, key=local), types)
                alone = np.split(flat[~double], np.cumsum(np.bincount(np.repeat(np.arange(len(cut)), cut)[~double], minlength=len(cut)))[:-1])
                common = distinct[times > 1]
                rows = _packed([*(alone if len(cut) else []), common, common], np.append(key[once], STAND_INS), bits)
                yield _columns(rows | {"kind": [1] * len(rows["part"])}, types)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {k: types[k] for k in ("kind", "doc_id", "n", "key", "key2")}
        for table in regrouped(batches, ["part", "kind"]):
            kind = table.column("kind")[0].as_py()
            if kind != 1:
                passed = table.select(list(out))
                yield from passed.set_column(0, "kind", pa.array([min(kind, 1)] * len(table), pa.int32())).to_batches()
                continue
            element, owner = _unpacked(table)
            owner, found = np.unique(owner[_frequency(element) > 1], return_counts=True)
            yield _columns({"kind": [1] * len(owner), "n": found, "key": owner}, out)

    schema = "part int, kind int, doc_id long, n long, key long, key2 long, elements binary, owners binary"
    met = docs.select("doc_id", "text").mapInArrow(sketch, schema).repartition("part").sortWithinPartitions("part", "kind")
    return staged(met.mapInArrow(meet, "kind int, doc_id long, n long, key long, key2 long"), "sketches")


def _shared_sets(sets: DataFrame, similarity: int) -> DataFrame:
    """Step 3: (id, n, l, prefix, shared) of classes that may still link, from (id, n, elements)."""
    bits = _bits(sets.agg(F.sum("n")).first()[0] or 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                elements = [np.frombuffer(e, np.uint64) for e in part.column(2).to_pylist()]
                rows = _packed(elements, part.column(0).to_numpy(), bits)
                yield _columns(rows, dict(part=pa.int32(), elements=pa.binary(), owners=pa.binary()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regrouped(batches, ["part"]):
            element, owner = _unpacked(table)
            often = _frequency(element)
            element, owner, often = element[often > 1], owner[often > 1], often[often > 1]
            order = np.argsort(owner, kind="stable")
            element, owner, often = element[order], owner[order], often[order].astype(np.int64)
            spans = runs(owner)
            rows = dict(
                id=[int(owner[a]) for a, _ in spans],
                elements=[element[a:b].tobytes() for a, b in spans],
                often=[often[a:b].tobytes() for a, b in spans]
            )
            yield _columns(rows, dict(id=pa.int64(), elements=pa.binary(), often=pa.binary()))

    counted = (
        sets.select("id", "n", "elements")
        .mapInArrow(deal, "part int, elements binary, owners binary")
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(count, "id long, elements binary, often binary")
    )
    sizes = sets.select(F.col("id"), F.col("n"), F.lit(None).cast("binary").alias("elements"), F.lit(None).cast("binary").alias("often"))
    gathered = sizes.unionByName(counted.select("id", F.lit(None).cast("long").alias("n"), "elements", "often"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = dict(id=pa.int64(), n=pa.int64(), l=pa.int32(), prefix=pa.list_(pa.int64()), shared=pa.list_(pa.int64()))
        rows: dict[str, list] = {k: [] for k in types}
        for table in regrouped(batches, ["id"]):
            n = next(x for x in table.column("n").to_pylist() if x is not None)
            parts = [np.frombuffer(e, np.uint64) for e in table.column("elements").to_pylist() if e is not None]
            if not parts or sum(map(len, parts)) < needed(n, similarity):
                continue
            element = np.concatenate(parts)
            often = np.concatenate([np.frombuffer(e, np.int64) for e in table.column("often").to_pylist() if e is not None])
            order = np.lexsort((element, often))
            element, often = element[order].view(np.int64), often[order]
            alone = n - len(element)
            choices = CHOICES[CHOICES <= needed(n, similarity)]
            cuts = np.maximum(n - needed(n, similarity) + choices - alone, 0)
            read = np.concatenate([[0], np.cumsum(often - 1)])[cuts]
            cost = read + ELEMENT_COST * n * read / choices
            best = int(np.argmin(np.where(cuts >= choices, cost, 0)))
            if cuts[best] < choices[best]:
                continue  # fewer elements than matches asked for: nothing can link
            for k, v in zip(types, (table.column("id")[0].as_py(), n, int(choices[best]), element[: cuts[best]], np.sort(element)), strict=True):
                rows[k].append(v)
            if len(rows["id"]) >= 1024:
                yield _columns(rows, types)
                rows = {k: [] for k in types}
        yield _columns(rows, types)

    return (
        gathered.repartition("id")
        .sortWithinPartitions("id")
        .mapInArrow(choose, "id long, n long, l int, prefix array<long>, shared array<long>")
    )


def _near(a: str, b: str, similarity: int) -> Column:
    """Sizes that two similar sets can have."""
    return (F.col(a) * 100 >= F.col(b) * similarity) & (F.col(b) * 100 >= F.col(a) * similarity)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar. Elements that only one class has are in no overlap."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("shared").alias(f"set_{s}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
    return joined.where(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * similarity).select("a", "b")


def _enough(found: DataFrame) -> DataFrame:
    return found.groupBy("a", "b").agg(F.count("*").alias("matches"), F.min("l").alias("l")).where("matches >= l").select("a", "b")


class _Classes:
    """Classes (id, n, l, prefix, shared) of a table that are searched together.

    A class can overlap a partner in elements that another class has as well, so their number bounds the sizes of
    its partners. Only elements of a class of such a size count, which tightens the bound again.
    """

    def __init__(self, table: pa.Table, similarity: int):
        self.similarity = similarity
        self.ids, self.size, self.asked = (table.column(c).to_numpy() for c in ("id", "n", "l"))
        flat = lambda c: (np.concatenate([x.flatten().to_numpy() for x in table.column(c).chunks]), pa.compute.list_value_length(table.column(c)).to_numpy())
        code, lengths = flat("prefix")
        code = np.unique(code, return_inverse=True)[1].astype(np.int32)
        self.codes, self.code, self.own = np.split(code, np.cumsum(lengths)[:-1]), code, np.repeat(np.arange(len(self.ids), dtype=np.int32), lengths)
        element, several = flat("shared")
        self.element = np.unique(element, return_inverse=True)[1].astype(np.int32)
        self.several, self.begin = several, np.concatenate([[0], np.cumsum(several)])
        self.marked = np.zeros(self.element.max(initial=-1) + 1, bool)
        # 100 both >= similarity (x + y - both) with both <= several gives the largest y that x may match.
        self.most = self._largest(several)
        self.alive, self.bits = np.ones(len(self.ids), bool), None
        for _ in range(PRUNINGS if len(self.ids) > MANY else 0):
            before = int(self.alive.sum())
            self._prune()
            if self.alive.sum() > 0.95 * before:
                break
        if self.alive.sum() > MANY:
            self._mark_common()

    def _largest(self, common: np.ndarray) -> np.ndarray:
        return np.minimum((common * (100 + self.similarity)) // self.similarity - self.size, self.size * 100 // self.similarity)

    def _prune(self) -> None:
        least = needed(self.size, self.similarity)
        self.alive &= self.most >= least
        holder = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.several)
        some = self.alive[holder]
        holder, place = holder[some], self.element[some].astype(np.int64) * (int(self.size.max(initial=0)) + 1)
        sizes, most = self.size[holder], np.minimum(self.most, self.size.max(initial=0))[holder]
        key = np.sort(place + sizes)
        others = np.searchsorted(key, place + most, "right") - np.searchsorted(key, place + least[holder]) - (sizes <= most)
        common = np.bincount(holder[others > 0], minlength=len(self.ids))
        self.most = np.minimum(self.most, self._largest(common))
        self.alive &= (common >= least) & (self.most >= least)

    def _mark_common(self) -> None:
        """A row of bits per class for the elements that one class in MANY has and more, and the number of its others."""
        often = np.bincount(self.element)
        common = MANY * often >= len(self.ids)
        place = np.cumsum(common, dtype=np.int64) - 1
        held = common[self.element]
        owner = np.repeat(np.arange(len(self.ids)), self.several)[held]
        at = place[self.element[held]]
        self.bits = np.zeros((len(self.ids), -(-int(common.sum()) // 64)), np.uint64)
        np.add.at(self.bits, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        self.others = self.several - np.bincount(owner, minlength=len(self.ids))

    def _similar(self, x: int, near: np.ndarray, both: np.ndarray) -> np.ndarray:
        return near[100 * both >= self.similarity * (self.size[x] + self.size[near] - both)]

    def postings(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Holders of each prefix element among ``some`` classes, and where each element's begin."""
        of = some[self.own]
        element, holder = self.code[of], self.own[of]
        rank = np.argsort(element, kind="stable")
        return holder[rank], np.searchsorted(element[rank], np.arange(self.code.max(initial=-1) + 2))

    def able(self, x: int) -> np.ndarray:
        """Classes of a size that x and they can match."""
        size, most = self.size, self.most
        return self.alive & (size <= most[x]) & (most >= size[x]) & (100 * size >= self.similarity * size[x]) & (100 * size[x] >= self.similarity * size)

    def near(self, x: int, able: np.ndarray, holders: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The classes among ``able`` that are similar to x."""
        near, codes = np.flatnonzero(able), self.codes[x]

        def matching(near: np.ndarray) -> np.ndarray:
            met = np.concatenate([holders[begin[c] : begin[c + 1]] for c in codes.tolist()])
            matches = np.bincount(met, minlength=len(self.ids))[near]
            return near[matches >= np.minimum(self.asked[x], self.asked[near])]

        if self.bits is None:
            near = matching(near)
        else:
            # Both tests lose nothing; the one that reads less goes first.
            listed = READS * int((begin[codes + 1] - begin[codes]).sum()) < self.bits.shape[1] * len(near)
            near = matching(near) if listed else near
            both = np.bitwise_count(self.bits[near] & self.bits[x]).sum(axis=1, dtype=np.int64)
            near = self._similar(x, near, both + np.minimum(self.others[near], self.others[x]))
            near = matching(near) if len(near) > MANY and not listed else near
        if not len(near):
            return near
        own = self.element[self.begin[x] : self.begin[x + 1]]
        self.marked[own] = True
        width = self.several[near]
        at = np.repeat(self.begin[near] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        both = np.bincount(np.repeat(np.arange(len(near)), width), self.marked[self.element[at]], len(near)).astype(np.int64)
        self.marked[own] = False
        return self._similar(x, near, both)


def _searched(table: pa.Table, similarity: int) -> Iterator[tuple[int, int]]:
    """(node, component) within one neighbourhood (id, n, l, prefix, shared), for classes that link with another.

    Classes that no class still waiting can match read no postings. What is left is counted over postings and
    verified for all candidates of a class at once.
    """
    c = _Classes(table.take(pa.array(np.argsort(table.column("id").to_numpy()))), similarity)
    waiting = c.alive.copy()
    holders, begin = c.postings(waiting)
    listed = int(waiting.sum())
    for seed in np.flatnonzero(waiting).tolist():
        if not waiting[seed]:
            continue
        waiting[seed] = False
        stack, found = [seed], []
        while stack:
            x = stack.pop()
            if 2 * waiting.sum() < listed:
                holders, begin = c.postings(waiting)
                listed = int(waiting.sum())
            if not listed:
                break
            able = waiting & c.able(x)
            if not able.any():
                continue
            near = c.near(x, able, holders, begin).tolist()
            waiting[near] = False
            stack += near
            found += near
        for y in [seed, *found] if found else ():
            yield int(c.ids[y]), int(c.ids[seed])


def _joined(table: pa.Table, similarity: int) -> Iterator[tuple[int, int]]:
    """Links (a, b) that connect the groups of two blocks (id, n, l, prefix, shared, group, own), or of one block.

    Members of the largest group are not searched from: what they link with finds them, and what joins them
    later is connected by then.
    """
    c = _Classes(table, similarity)
    group, side = table.column("group").to_numpy(), table.column("own").to_numpy()
    _, label = np.unique(group, return_inverse=True)
    sides = [side == s for s in np.unique(side).tolist()]
    lists = [c.postings(c.alive & s) for s in sides]
    members = np.bincount(label[c.alive], minlength=label.max(initial=0) + 1)
    largest = int(np.argmax(members))
    for x in np.flatnonzero(c.alive).tolist():
        if label[x] == largest:
            continue
        other = len(sides) - 1 if sides[0][x] else 0
        able = c.able(x) & sides[other] & (label != label[x])
        if not able.any():
            continue
        near = c.near(x, able, *lists[other])
        for g in np.unique(label[near]).tolist():
            y = int(near[label[near] == g][0])
            yield int(c.ids[x]), int(c.ids[y])
        if len(near):
            met = np.append(label[near], label[x])
            label[np.isin(label, met)] = largest if (met == largest).any() else label[x]


def link_components(sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Step 4: (node, component) of the classes (id, n, l, prefix, shared) that link with another."""
    postings = sets.select(F.explode("prefix").alias("element"), "id")
    heads = postings.groupBy("element").agg(F.min("id").alias("a"))
    ties = postings.join(heads, "element").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    area = components(ties).select(F.col("node").alias("id"), F.col("component").alias("area"))
    placed = staged(sets.join(area, "id"), "areas")
    sizes = placed.groupBy("area").agg(F.sum(F.size("shared")).alias("elements"))
    large = staged(sizes.where(F.col("elements") > NEIGHBOURHOOD).select("area"), "large")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regrouped(batches, ["area"]):
            if table.num_rows > 1:
                got = list(_searched(table, similarity))
                yield _columns({"node": [a for a, _ in got], "component": [b for _, b in got]}, dict(node=pa.int64(), component=pa.int64()))

    small = placed.join(large, "area", "left_anti").repartition("area").sortWithinPartitions("area")
    groups = small.mapInArrow(search, "node long, component long")
    if large.isEmpty():
        return groups
    return groups.union(_by_rounds(placed.join(large, "area", "left_semi"), similarity))


def _by_rounds(sets: DataFrame, similarity: int) -> DataFrame:
    """(node, component) of neighbourhoods (area, id, n, l, prefix, shared) too large for one task."""
    n_classes = sets.count()
    postings = staged(sets.select(F.explode("prefix").alias("element"), "id", "n", "l"), "postings")
    links, groups, vain, turn = None, None, 0, 0
    while True:
        open_ = postings.withColumn("group", F.col("id"))
        if groups is not None:
            open_ = postings.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
        open_ = staged(open_, "open")
        per_group = open_.groupBy("element", "group").agg(F.count("*").alias("k"))
        lists = per_group.groupBy("element").agg(F.sum("k").alias("n_all"), F.sum(F.col("k") * F.col("k")).alias("inside"), F.count("*").alias("groups"))
        lists = staged(lists.where("groups > 1").select("element", ((F.col("n_all") * F.col("n_all") - F.col("inside")) / 2).alias("pairs"), "n_all"), "lists")
        size = lists.agg(F.sum("pairs"), F.sum("n_all")).first()
        if not size[0]:
            break
        open_ = open_.join(lists.select("element"), "element")
        last = size[0] <= OPEN_PAIRS * size[1]
        if not last and vain >= VAIN_ROUNDS:
            found = staged(_by_blocks(sets, groups, similarity), "links")
            links = found if links is None else links.union(found)
            groups = staged(components(links), "groups")
            break
        if last:
            left = open_.select("element", *[F.col(c).alias(f"{c}_a") for c in ("id", "n", "l", "group")])
            right = open_.select("element", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "l", "group")])
            met = left.join(right, "element").where((F.col("id_a") < F.col("id_b")) & (F.col("group_a") != F.col("group_b")) & _near("n_a", "n_b", similarity))
        else:
            rank = F.xxhash64(F.col("id"), F.lit(turn))
            heads = open_.groupBy("element").agg(F.min_by(F.struct("id", "n", "l", "group"), rank).alias("h"))
            heads = heads.select("element", *[F.col(f"h.{c}").alias(f"{c}_a") for c in ("id", "n", "l", "group")])
            right = open_.select("element", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "l", "group")])
            met = right.join(heads, "element").where((F.col("group_a") != F.col("group_b")) & _near("n_a", "n_b", similarity))
        pairs = met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), F.least("l_a", "l_b").alias("l"))
        # A leader meets a class in some of their common lists only, so any match makes them candidates.
        pairs = _enough(pairs) if last else pairs.select("a", "b").distinct()
        found = staged(_verified(pairs, sets, similarity), "links")
        new = found.count()
        links = found if links is None else links.union(found)
        if new:
            groups = staged(components(links), "groups")
        if last:
            break
        vain = 0 if new > WORTH * n_classes else vain + 1
        turn += 1
    return groups if groups is not None else sets.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)


def _by_blocks(sets: DataFrame, groups: DataFrame | None, similarity: int) -> DataFrame:
    """Links (a, b) that connect what ``groups`` (node, component) leave apart: each two blocks of a neighbourhood meet in a task."""
    cuts = sets.groupBy("area").agg(F.ceil(F.sum(F.size("shared")) / F.lit(BLOCK)).cast("int").alias("cut"))
    known = sets if groups is None else sets.join(groups.withColumnRenamed("node", "id"), "id", "left")
    known = known.withColumn("group", F.col("id") if groups is None else F.coalesce("component", "id"))
    dealt = known.join(cuts, "area").withColumn("own", F.pmod(F.xxhash64("id"), F.greatest("cut", F.lit(1))).cast("int"))
    place = ["area", "i", "j"]
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("cut", F.lit(1)) - 1))).select(
        "area", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "l", "prefix", "shared", "group"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regrouped(batches, place):
            if table.num_rows > 1:
                got = list(_joined(table, similarity))
                yield _columns({"a": [a for a, _ in got], "b": [b for _, b in got]}, dict(a=pa.int64(), b=pa.int64()))

    return met.repartition(*place).sortWithinPartitions(*place).mapInArrow(search, "a long, b long")


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit keys of each set: equal sets have equal ones."""
    sizes = np.array([len(s) for s in sets], np.int64)
    key = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64) + sizes.astype(np.uint64)
    key2 = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    return sizes, mix64(key).view(np.int64), key2.view(np.int64)


CLASS = ["key", "key2", "n"]


def _grouped(docs: DataFrame, similarity: int) -> DataFrame:
    """(doc_id, key, key2, n, component, component_id) of each row: its class of equal sets, and the group of classes.

    Classes are nodes by their keys, not by a document's id, so different texts that share an id stay apart.
    ``component`` is null for classes without links.
    """
    sketches = _sketches(docs, similarity)
    rows = sketches.where("kind = 0").select("doc_id", *CLASS)
    classes = rows.where("n > 0 and doc_id is not null").groupBy(*CLASS).agg(F.min("doc_id").alias("doc"))
    classes = staged(classes.withColumn("id", F.xxhash64(*CLASS)), "classes")
    found = sketches.where("kind = 1").groupBy("key").agg(F.sum("n").alias("found"))
    # A partner has needed(n) elements at least, and the smaller of both asks for so many matches.
    least = F.lit(1) + F.floor(F.ceil(F.col("n") * similarity / 100.0) / FIRST_MATCH)
    candidates = staged(classes.join(found, "key").where(F.col("found") >= least).select(*CLASS, "id", "doc"), "candidates")
    open_ids = staged(candidates.select(F.col("doc").alias("doc_id")).distinct(), "candidates")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(0))
                n, key, key2 = set_keys(sets)
                rows = dict(key=key, key2=key2, n=n, elements=[s.tobytes() for s in sets])
                yield _columns(rows, dict(key=pa.int64(), key2=pa.int64(), n=pa.int64(), elements=pa.binary()))

    texts = docs.select("doc_id", "text").join(broadcast_if_small(open_ids), "doc_id").select("text")
    whole = texts.mapInArrow(elements, "key long, key2 long, n long, elements binary").groupBy(*CLASS).agg(F.first("elements").alias("elements"))
    whole = whole.join(candidates.select(*CLASS, "id"), CLASS).select("id", "n", "elements")
    sets = staged(_shared_sets(staged(whole, "sets"), similarity), "shared")
    groups = staged(link_components(sets, similarity), "groups")
    linked = groups.join(classes.select(F.col("id").alias("node"), *CLASS, "doc"), "node")
    lowest = linked.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = linked.join(lowest, "component").select(*CLASS, "component", "component_id")
    alone = classes.join(named.select(*CLASS), CLASS, "left_anti").select(*CLASS, F.lit(None).cast("long").alias("component"), F.col("doc").alias("component_id"))
    return rows.join(named.union(alone), CLASS, "left").select(
        "doc_id", *CLASS, "component", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def near_copies(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    return _grouped(docs, similarity).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row of the smallest id stays, once.

    Where different texts share that id, one of each group stays, the one of the smallest keys. Rows without
    an id stay.
    """
    rows = staged(_grouped(docs.select("doc_id", "text"), similarity).where("doc_id is not null"), "grouped")
    repeated = staged(rows.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    kept = rows.where("doc_id = component_id")
    once = kept.join(repeated, "doc_id", "left_anti").select("doc_id")
    plain = docs.join(once, "doc_id", "left_semi").select(*docs.columns)
    out = plain.unionByName(docs.where("doc_id is null"))
    if repeated.isEmpty():
        return out
    # Classes without links, empty ones among them, are groups of their own.
    own = F.when(F.col("component").isNull(), F.struct(*CLASS))
    empty = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.lit(1))
    some = kept.join(repeated, "doc_id").select("doc_id", "component", own.alias("own"), empty.alias("filled"), F.struct(*CLASS).alias("class"))
    chosen = some.groupBy("doc_id", "component", F.when(F.col("filled") == 1, F.col("own")).alias("own"), "filled").agg(F.min("class").alias("class"))
    keyed = _keyed(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns))
    one = keyed.join(chosen.select(F.col("doc_id").alias("chosen_id"), F.col("class").alias("chosen")), (F.col("id") == F.col("chosen_id")) & (F.col("class") == F.col("chosen")))
    return out.unionByName(one.groupBy("id", "class").agg(F.first("row").alias("row")).select("row.*").select(*docs.columns))


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, class, row) of each row: its whole columns, and the keys of its set."""
    rows = docs.select(F.struct("*").alias("row")).select(F.col("row.doc_id").alias("id"), F.col("row.text").alias("text"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, key, key2 = set_keys(shingle_sets(part.column(1)))
                class_ = pa.StructArray.from_arrays([pa.array(key), pa.array(key2), pa.array(n)], CLASS)
                yield pa.RecordBatch.from_arrays([part.column(0), class_, part.column(2)], names=["id", "class", "row"])

    return rows.mapInArrow(run, f"id long, class struct<key: bigint, key2: bigint, n: bigint>, row {rows.schema['row'].dataType.simpleString()}")
