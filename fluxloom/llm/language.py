"""Language identification by nearest centroid.

A text is a vector of byte 1- to 3-grams, hashed to a fixed number of cells, weighed by TF-IDF and
brought to length one. Each language has several centroids, clustered from its own texts; a text gets
the language of the centroid of highest cosine. A text farther from that centroid than all but a
stated share of the centroid's own texts is rejected.

Document frequencies are counted over all training texts. Only the clustering works on a bounded
sample per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.common import slices, smallest_digests, staged, text_bytes

#: Cells that n-grams are hashed to.
CELLS = 4096
#: Centroids per language.
CENTROIDS = 4
#: Bound of the sample: training texts per language that the centroids are clustered from.
SAMPLE = 1000
#: A centroid rejects texts with a lower cosine than all but this share of its own texts.
REJECTED_SHARE = 0.005
#: Answer for texts without a letter and for rejected ones.
UNKNOWN = "und"
#: Rows whose count vectors are held at once.
ROWS = 256


def gram_counts(column: pa.Array) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams per row. A-Z count as a-z, anything ASCII but letters as a blank."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = table[65:91] = np.arange(97, 123)
    # A blank before and after each text.
    padded = np.full(len(data) + 2 * n, 32, np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(data)) + 2 * row + 1] = table[data]
    row = np.repeat(np.arange(n), np.diff(offsets) + 2)
    out = np.zeros(n * CELLS, np.int64)
    two = padded[:-1] * 256 + padded[1:]
    three = two[:-1] * 256 + padded[2:]
    letter = padded != 32
    for gram, own, keep in (
        (padded, row, letter),
        (two, row[1:], (row[:-1] == row[1:]) & (letter[:-1] | letter[1:])),
        (three, row[2:], (row[:-2] == row[2:]) & letter[1:-1]),
    ):
        cell = (gram * 0x9E3779B1 >> 15) % CELLS
        out += np.bincount((own * CELLS + cell)[keep], minlength=n * CELLS)
    return out.reshape(n, CELLS)


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def spherical_means(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Cluster unit vectors by cosine: start from the mean and farthest points, until nothing moves."""
    means = [x.mean(axis=0)]
    for _ in range(1, min(k, len(x))):
        means.append(x[np.argmin((x @ np.array([m / max(np.linalg.norm(m), 1e-300) for m in means]).T).max(axis=1))])
    means = np.array(means)
    before = None
    for _ in range(rounds):
        means = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-300)
        own = (x @ means.T).argmax(axis=1)
        if before is not None and (own == before).all():
            break
        before = own
        means = np.array([x[own == i].mean(axis=0) if (own == i).any() else means[i] for i in range(len(means))])
    return means


def train(docs: DataFrame, rows: Column, text: str = "text", lang: str = "lang") -> dict:
    """Model from the rows of ``docs`` where ``rows`` holds and language and text are known."""
    known = docs.where(rows & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.col("doc_id")
    )
    chosen = staged(smallest_digests(known.where("doc_id is not null"), "lang", SAMPLE).distinct(), "sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                for at in range(0, part.num_rows, ROWS):
                    counts = gram_counts(part.column(0).slice(at, ROWS))
                    df += (counts > 0).sum(axis=0)
                    n += len(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, CELLS)), pa.array(np.concatenate([[n], df]))], names=["cell", "n"]
        )

    sums = known.select("text").mapInArrow(frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    found = {r[0]: r[1] for r in sums}
    n = found.get(-1, 0)
    idf = np.log((n + 1) / (np.array([found.get(i, 0) for i in range(CELLS)]) + 1)) + 1e-3

    def cluster(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        counts = [gram_counts(pa.array([t])) for t in group["text"].sort_values()]
        x = weighed(np.concatenate(counts), idf)
        means = spherical_means(x, CENTROIDS)
        cosine = x @ means.T
        own, best = cosine.argmax(axis=1), cosine.max(axis=1)
        out = [
            (key[0], m.astype("<f8").tobytes(), float(np.quantile(best[own == i], REJECTED_SHARE)))
            for i, m in enumerate(means)
            if (own == i).any()
        ]
        return pd.DataFrame(out, columns=["lang", "centroid", "floor"])

    # At most SAMPLE ids per language: small beside the texts, and joined on both so that none is drawn twice.
    # Of rows that share an id the least text counts, so a group's rows are bounded as its ids are.
    sample = known.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    got = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, floor double").collect()
    got = sorted(got, key=lambda r: (r[0], r[1]))
    return {
        "idf": idf,
        "langs": [r[0] for r in got],
        "centroids": np.array([np.frombuffer(r[1], "<f8") for r in got]).reshape(len(got), CELLS),
        "floors": np.array([r[2] for r in got]),
    }


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but ``text``, with lang_pred, score (cosine) and rejected.

    lang_pred is the nearest language, or ``und`` with score 0 where the text is null or has no letter;
    ``rejected`` tells that the text lies outside what the centroid has seen. Equal cosines go to the
    language that sorts first; without a learned language all texts are ``und``.
    """
    kept = [c for c in docs.columns if c != text]
    prepared = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("text"),
    )
    langs = pa.array(model["langs"] + [UNKNOWN])
    idf, centroids, floors = model["idf"], model["centroids"], model["floors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in slices(batch):
                for at in range(0, whole.num_rows, ROWS):
                    part = whole.slice(at, ROWS)
                    some = np.asarray(part.column(1).is_valid()) & bool(len(floors))
                    best, score, rejected = np.full(len(some), len(floors)), np.zeros(len(some)), ~some
                    if some.any():
                        cosine = weighed(gram_counts(part.column(1).filter(pa.array(some))), idf) @ centroids.T
                        top = cosine.argmax(axis=1)
                        best[some], score[some] = top, np.clip(cosine.max(axis=1), 0, 1)
                        rejected[some] = score[some] < floors[top]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), langs.take(pa.array(best)), pa.array(score), pa.array(rejected)],
                        names=["row", "lang_pred", "score", "rejected"],
                    )

    schema = f"row {prepared.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    return prepared.mapInArrow(run, schema).select("row.*", "lang_pred", "score", "rejected")


def identify(docs: DataFrame, text: str = "text") -> DataFrame:
    """Operator with rejection in force: rejected texts get ``und``. Learns from all rows with a language."""
    found = predict(docs, train(docs, F.lit(True), text), text)
    return found.withColumn("lang_pred", F.when(F.col("rejected"), UNKNOWN).otherwise(F.col("lang_pred")))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """Learn from three quarters of the documents, predict all."""
    docs = docs.select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = train(docs, ~out)
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model)
