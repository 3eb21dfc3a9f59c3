"""Toxicity by a support vector machine with a gapped subsequence string kernel and Nyström landmarks.

The sentences that the machine sees are short runs of letters: each word of a text, without the marks
inside it, and each run of single letters put together. The kernel of two sentences sums all common
subsequences of ORDER letters, each weighed by DECAY to the power of the letters it spans in both, so
"i-d-i-o-t", "iidiot" and "idixot" stay near "idiot". Kernel values with a few landmark sentences,
whitened by the landmarks' own kernel matrix, are the machine's features (Nyström).

Labels mark documents, not sentences. Offending sentences are those that occur in toxic documents so much
more often than in clean ones that chance would not do so for any of all sentences. Documents that have a
sentence between the same neighbours count once, so that copies of a document prove nothing. They, and
variants with a letter put in or taken out, are the positive
sentences, however many there are; the commonest sentences of clean documents and those nearest to a positive
one are negative, but for sentences that are commoner in toxic documents than in clean ones.

All sentences of whole texts are judged, each distinct one once per task. A text's score is a logistic
function of its worst sentence, the sum and the number of the sentences on the wrong side, and its length,
fitted to the labelled documents: an offending-looking sentence in a long text may be an accident.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.common import mix64, rolling, slices, smallest_digests, staged, text_bytes, word_spans

ORDER = 3
DECAY = 0.6
#: Longer sentences are read in overlapping stretches of so many letters.
STRETCH = 24
OVERLAP = 12
#: Bound of the fit: labelled documents per label that sentences are learned from.
SAMPLE = 4000
#: Bounds of the fit: negatives of either kind, landmarks.
NEGATIVES = 1500
LANDMARKS = 100
#: Chance of any offending sentence by accident, by the Chernoff bound over all sentences.
ACCIDENT = 1e-3
#: An offending sentence is at most this share as frequent in clean documents as in toxic ones.
MOST_CLEAN = 0.1
#: Sentences whose kernels are computed at once.
STEP = 2048
#: Sentences that others are compared with at once.
BLOCK = 200
#: A task forgets its scored sentences beyond so many, to bound its memory.
CACHED = 1 << 20
#: Triples of letters, and cells of a table of triples by landmarks, that are held at once.
DIRECT, TABLE = 1 << 22, 1 << 23

#: Letters that digits stand for inside words. Fixed values.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}


# ---------------------------------------------------------------- sentences


def stretches(sentence: str) -> list[str]:
    if len(sentence) <= STRETCH:
        return [sentence]
    return [sentence[i : i + STRETCH] for i in range(0, len(sentence) - OVERLAP, STRETCH - OVERLAP)]


def letters(word: str) -> str:
    """A word in lower case without anything but letters; look-alikes inside it are read as letters."""
    word = word.lower()
    if not word.isalpha():
        if any(c.isalpha() for c in word):
            word = "".join(LOOKALIKES.get(c, c) for c in word)
        word = "".join(c for c in word if c.isalpha())
    return word


def sentences(column: pa.Array):
    """Distinct words (as text), which word each occurrence is, the row of each, and (row, sentence) of spelled runs."""
    data, offsets = text_bytes(column)
    data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    start, end = word_spans(data, offsets)
    row = np.searchsorted(offsets, start, side="right") - 1
    hashes = rolling(data).of(start, end)
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    # Runs of three and more words of one character, with a mark perhaps: "i d i o t", "i. d. i. o. t."
    ascii_letter = (data[start] >= 97) & (data[start] <= 122) if len(start) else np.zeros(0, bool)
    mark = np.zeros(len(start), bool)
    two = end - start == 2
    mark[two] = np.isin(data[start[two] + 1], np.frombuffer(b".,-_*'", np.uint8))
    single = ascii_letter & ((end - start == 1) | mark)
    change = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    spelled = []
    for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        rows = row[a:b]
        for r in np.unique(rows).tolist():
            run = bytes(data[start[a:b][rows == r]]).decode()
            spelled += [(r, s) for s in stretches(run)] if len(run) >= ORDER else []
    return distinct, raw, start[first], end[first], which, row, spelled


# ---------------------------------------------------------------- kernel


def by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points) of the sentences of each length from ORDER on, at most STEP at once."""
    groups: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        if len(t) >= ORDER:
            groups.setdefault(len(t), []).append(i)
    for size in sorted(groups):
        for at in range(0, len(groups[size]), STEP):
            own = groups[size][at : at + STEP]
            joined = "".join(texts[i] for i in own).encode("utf-32-le")
            yield np.array(own), np.frombuffer(joined, np.int32).reshape(len(own), size)


class expansion:
    """Letter triples of landmarks, so that a kernel value is one sum over a sentence's triples.

    Only triples that occur in a landmark have a row in a table; row 0 stands for all others. Letters that no
    landmark has are one letter. Where few letters make few triples, rows are looked up in an array.
    """

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.alphabet = np.array(sorted({ord(c) for z in landmarks for c in z}), np.int64)
        self.base = len(self.alphabet) + 1
        cells = [np.unique(cell) for _, codes in by_length(landmarks) for cell, _ in self.triples(self.coded(codes))]
        self.keys = np.unique(np.concatenate(cells)) if cells else np.zeros(0, np.int64)
        self.place = None
        if self.base**ORDER <= DIRECT:
            self.place = np.zeros(self.base**ORDER, np.int32)
            self.place[self.keys] = np.arange(1, len(self.keys) + 1)

    def coded(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0)

    def triples(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        for i, j, k in combinations(range(codes.shape[1]), ORDER):
            yield (codes[:, i] * self.base + codes[:, j]) * self.base + codes[:, k], DECAY ** (k - i + 1)

    def rows(self, cell: np.ndarray) -> np.ndarray:
        if self.place is not None:
            return self.place[cell]
        at = np.minimum(np.searchsorted(self.keys, cell), len(self.keys) - 1)
        return np.where(self.keys[at] == cell, at + 1, 0)

    def table(self, weights: np.ndarray) -> np.ndarray:
        """Per triple the landmarks' decays times their weights (one row of them per landmark), added up."""
        out = np.zeros((len(self.keys) + 1, *weights.shape[1:]))
        for places, codes in by_length(self.landmarks):
            for cell, decay in self.triples(self.coded(codes)):
                np.add.at(out, self.rows(cell), decay * weights[places])
        return out

    def sums(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        """Weighed triples of each sentence over its own length in the kernel's space."""
        out = np.zeros((len(texts), *table.shape[1:]))
        for places, points in by_length(texts):
            total = np.zeros((len(places), *table.shape[1:]))
            for cell, decay in self.triples(self.coded(points)):
                total += decay * table[self.rows(cell)]
            norm = np.sqrt(self_kernel(points))
            out[places] = total / norm.reshape(-1, *[1] * (total.ndim - 1))
        return out


def self_kernel(points: np.ndarray) -> np.ndarray:
    """Kernel of each sentence with itself; sentences of one length, as code points."""
    size = points.shape[1]
    same = (points[:, :, None] == points[:, None, :]).astype(np.float64)
    weights = same * DECAY**2
    decay = np.tril(DECAY ** np.maximum(np.subtract.outer(np.arange(size), np.arange(size)) - 1, 0), -1)
    for _ in range(ORDER - 1):
        # All weight before (i, j) in both, decayed by the letters between.
        weights = same * DECAY**2 * (decay @ weights @ decay.T)
    return weights.sum(axis=(1, 2))


def kernel(texts: list[str], others: list[str]) -> np.ndarray:
    """Normalised kernel, between 0 and 1; sentences shorter than ORDER are like nothing."""
    if not texts or not others:
        return np.zeros((len(texts), len(others)))
    out, at = [], 0
    while at < len(others):
        # As many others as keep the table of their triples small.
        size, triples = 0, 0
        while at + size < len(others) and (not size or (size + 1) * (triples + math.comb(len(others[at + size]), ORDER)) <= TABLE):
            triples += math.comb(len(others[at + size]), ORDER)
            size += 1
        space = expansion(others[at : at + size])
        out.append(space.sums(texts, space.table(np.diag(1 / lengths(space.landmarks)))))
        at += size
    return np.concatenate(out, axis=1)


def lengths(texts: list[str]) -> np.ndarray:
    """Length of each sentence in the kernel's space; 1 below ORDER letters."""
    norm = np.ones(len(texts))
    for places, points in by_length(texts):
        norm[places] = np.sqrt(self_kernel(points))
    return norm


def nearest(texts: list[str], others: list[str]) -> np.ndarray:
    """The largest kernel value of each text with any of the others, a block of them at a time."""
    near = np.zeros(len(texts))
    for at in range(0, len(others), BLOCK):
        near = np.maximum(near, kernel(texts, others[at : at + BLOCK]).max(axis=1))
    return near


# ---------------------------------------------------------------- machine


def variants(word: str) -> list[str]:
    """The word with one letter put in between, doubled, or taken out."""
    out = []
    for i in range(1, len(word)):
        out.append(word[:i] + "xqz"[i % 3] + word[i:])
        out.append(word[:i] + word[i - 1] + word[i:])
    if len(word) > 4:
        out += [word[:i] + word[i + 1 :] for i in range(1, len(word) - 1)]
    return out


def support_vectors(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps until they no longer change.

    The last column of x is the constant, which is not penalised much.
    """
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        xi, ci = x[inside], cost[inside]
        new = np.linalg.solve(ridge + (xi * ci[:, None]).T @ xi, xi.T @ (ci * y[inside]))
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def spread_out(texts: list[str], n: int) -> list[str]:
    """n of the sentences, each the one least like those before it."""
    chosen, near = texts[:1], np.zeros(len(texts))
    while chosen and len(chosen) < min(n, len(texts)):
        near = np.maximum(near, kernel(texts, chosen[-1:])[:, 0])
        chosen.append(texts[int(np.argmin(near))])
    return chosen


def fit(positive: list[str], negative: list[str]) -> dict | None:
    """Machine from labelled sentences; none if either kind is missing."""
    positive, negative = ([t for t in some if len(t) >= ORDER] for some in (positive, negative))
    if not positive or not negative:
        return None
    hard = nearest(negative, positive)
    hardest = [negative[i] for i in np.argsort(-hard, kind="stable")[: 10 * LANDMARKS]]
    landmarks = sorted({*spread_out(positive, LANDMARKS // 2), *spread_out(hardest, LANDMARKS // 2)})
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = values > 1e-4 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    avoided = set(negative)
    more = sorted({v for p in positive for v in variants(p)} - avoided - set(positive))
    texts = positive + more + negative
    y = np.array([1.0] * (len(positive) + len(more)) + [-1.0] * len(negative))
    x = np.c_[kernel(texts, landmarks) @ whiten, np.ones(len(texts))]
    # Both kinds weigh alike, and known sentences as much as all their variants.
    weights = np.r_[
        np.full(len(positive), 0.5 / len(positive)), np.full(len(more), 0.5 / max(len(more), 1)), np.full(len(negative), 1 / len(negative))
    ]
    w = support_vectors(x, y, 20.0 * len(texts) * weights)
    space = expansion(landmarks)
    table = space.table(whiten @ w[:-1] / lengths(landmarks))
    return {"space": space, "table": table, "bias": float(w[-1]), "landmarks": landmarks}


def margins(texts: list[str], machine: dict) -> np.ndarray:
    """What the machine says: its landmarks' weights are added up per letter triple beforehand."""
    return machine["space"].sums(texts, machine["table"]) + machine["bias"]


#: What is known of a text: worst margin, sum and number of margins above 0, distinct offending sentences counted
#: once, and words.
FEATURES = 4


def features(column: pa.Array, machine: dict, known: dict) -> np.ndarray:
    """Features of each text; ``known`` keeps the margins of sentences already seen."""
    distinct, raw, start, end, which, row, spelled = sentences(column)
    if len(known["hashes"]) > CACHED:
        known["hashes"], known["margins"] = np.zeros(0, np.uint64), np.zeros(0)
    at = np.searchsorted(known["hashes"], distinct)
    old = at < len(known["hashes"])
    old[old] = known["hashes"][at[old]] == distinct[old]
    fresh = np.flatnonzero(~old)
    words = [stretches(letters(raw[a:b].decode(errors="replace"))) for a, b in zip(start[fresh].tolist(), end[fresh].tolist(), strict=True)]
    texts = sorted({s for w in words for s in w} | {s for _, s in spelled})
    margin = dict(zip(texts, margins(texts, machine).tolist(), strict=True))
    hashes = np.concatenate([known["hashes"], distinct[fresh]])
    values = np.concatenate([known["margins"], np.array([max(margin[s] for s in w) for w in words], float)])
    order = np.argsort(hashes, kind="stable")
    known["hashes"], known["margins"] = hashes[order], values[order]
    value = known["margins"][np.searchsorted(known["hashes"], distinct)]
    out = np.zeros((len(column), FEATURES))
    out[:, 0] = machine["bias"]
    np.maximum.at(out[:, 0], row, value[which])
    bad = value[which] > 0
    pairs = np.unique(np.stack([row[bad], which[bad]]), axis=1)
    np.add.at(out[:, 1], pairs[0], value[pairs[1]])
    np.add.at(out[:, 2], pairs[0], 1)
    for r, s in sorted(set(spelled)):
        out[r, 0] = max(out[r, 0], margin[s])
        if margin[s] > 0:
            out[r, 1] += margin[s]
            out[r, 2] += 1
    out[:, 0] = np.clip(out[:, 0], -4, 4)
    out[:, 1:3] = np.log1p(out[:, 1:3])
    out[:, 3] = np.log1p(np.bincount(row, minlength=len(column)))
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a slight ridge, by Newton steps; the last coefficient is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-2 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ w, -30, 30)))


def unseen() -> dict:
    return {"hashes": np.zeros(0, np.uint64), "margins": np.zeros(0)}


def train(docs: DataFrame, labels: DataFrame, rows: Column) -> dict:
    """Machine from the documents (doc_id, text) with a label (doc_id, toxic) for which ``rows`` holds.

    At most SAMPLE documents of each label are read, those of the smallest digests of their ids; of rows that
    share an id the one of the least text.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.where(rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = staged(smallest_digests(known, "toxic", SAMPLE), "sample")

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                distinct, raw, start, end, which, row, spelled = sentences(part.column(0))
                words = [stretches(letters(raw[a:b].decode(errors="replace"))) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                doc, toxic = part.column(1).to_pylist(), part.column(2).to_pylist()
                # Neighbours of each occurrence; rows end where the row number changes.
                own = np.concatenate([[-1], row, [-1]])
                near = np.concatenate([[0], which + 1, [0]])
                left = np.where(own[:-2] == row, near[:-2], 0)
                right = np.where(own[2:] == row, near[2:], 0)
                code = np.concatenate([[np.uint64(0)], distinct])
                around = mix64(code[left] * np.uint64(3) + code[right]).view(np.int64)
                _, once = np.unique(np.stack([row, which]), axis=1, return_index=True)
                got = [
                    (doc[r], toxic[r], s, c)
                    for r, w, c in zip(row[once].tolist(), which[once].tolist(), around[once].tolist(), strict=True)
                    for s in words[w]
                    if len(s) >= ORDER
                ]
                got += [(doc[r], toxic[r], s, 0) for r, s in set(spelled)]
                columns = list(zip(*got, strict=True)) if got else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())],
                    names=["doc_id", "toxic", "sentence", "around"],
                )

    # The sample is bounded by SAMPLE, so its ids may be sent everywhere and its sentences kept.
    # Of rows that share an id the least text counts, so rows are bounded as ids are.
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = staged(sample.repartition(spread, "doc_id").select("text", "doc_id", "toxic"), "sample")
    said = staged(sample.mapInArrow(unique, "doc_id long, toxic int, sentence string, around long"), "sentences")
    size = dict(chosen.groupBy("toxic").count().collect())
    toxic, clean = max(size.get(1, 0), 1), max(size.get(0, 0), 1)
    alone = said.groupBy("sentence", "around", "toxic").agg(F.min("doc_id").alias("doc_id"))
    per = alone.groupBy("sentence", "doc_id").agg(F.max("toxic").alias("toxic"))
    counts = staged(per.groupBy("sentence").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "counts")
    n, share = F.col("bad") + F.col("good"), F.lit(toxic / (toxic + clean))
    rate = F.col("bad") / n
    relative = rate * F.log(rate / share) + F.coalesce((1 - rate) * F.log((1 - rate) / (1 - share)), F.lit(0.0))
    offending = (
        counts.where((F.col("bad") > 0) & (F.col("good") / clean <= MOST_CLEAN * F.col("bad") / toxic))
        .withColumn("surprise", n * relative)
        .where(F.col("surprise") > math.log(max(counts.count(), 1) / ACCIDENT))
    )
    # The vocabulary of the sample bounds them. What is commoner in toxic documents is no example of the harmless.
    positive = [r[0] for r in offending.orderBy(F.desc("surprise"), "sentence").collect()]
    fair = counts.where((F.col("good") > 0) & (F.col("good") / clean >= F.col("bad") / toxic))
    common = [r[0] for r in fair.orderBy(F.desc("good"), "sentence").limit(NEGATIVES).collect()]
    near = _nearest(fair.select("sentence"), positive)
    machine = fit(positive, sorted(set(common + near) - set(positive)))
    if machine is None:
        return {"machine": None, "curve": None}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unseen()
        for batch in batches:
            for part in slices(batch):
                x = features(part.column(0), machine, known)
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    measured = sample.mapInArrow(measure, "toxic int, x array<double>").collect()
    y, x = np.array([r[0] for r in measured], float), np.array([r[1] for r in measured])
    total = dict(known.groupBy("toxic").count().collect())
    weight = np.where(y > 0, total.get(1, 0) / toxic, total.get(0, 0) / clean)
    return {"machine": machine, "curve": logistic(x, y, weight)}


def _nearest(clean: DataFrame, positive: list[str]) -> list[str]:
    """The clean sentences nearest to a positive one."""
    if not positive:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nearest(texts, positive))], names=["sentence", "near"]
            )

    spread = clean.repartition(int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sentence")
    found = spread.mapInArrow(run, "sentence string, near double")
    return [r[0] for r in found.orderBy(F.desc("near"), "sentence").limit(NEGATIVES).collect()]


def _scored(docs: DataFrame, model: dict, harmless_only: bool) -> DataFrame:
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{names.index('text')}"
    kept = [f for f in plain.schema if harmless_only or f.name != text]
    machine, curve = model["machine"], model["curve"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unseen()
        for batch in batches:
            for part in slices(batch, text):
                p = np.zeros(part.num_rows)
                if machine is not None:
                    p = probability(features(part.column(part.schema.get_field_index(text)), machine, known), curve)
                out = part.select([f.name for f in kept])
                if harmless_only:
                    yield out.filter(pa.array(p < 0.5))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*out.schema.names, "score", "predicted"]
                    )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    done = plain.mapInArrow(run, fields if harmless_only else f"{fields}, score double, predicted int")
    back = [F.col(f.name).alias(names[int(f.name[1:])]) for f in kept]
    return done.select(*back) if harmless_only else done.select(*back, "score", "predicted")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of ``docs`` but text, with score and predicted. Texts without a sentence score as the curve has it for none."""
    return _scored(docs, model, False)


def harmless(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that score below one half, as they are."""
    return _scored(docs, model, True)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels of four fifths of the ids, score all documents.

    Null and empty texts score as harmless; a null id is never held out; repeated rows score alike;
    without labels of both kinds every document scores below one half.
    """
    model = train(docs.select("doc_id", "text"), labels, ~held_out(F.col("doc_id")))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
