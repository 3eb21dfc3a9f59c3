import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.llm import vectors
from tests.llm import cases

SCHEMA = "vec_id long, embedding array<float>, label int, score string, n string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, "a", None, "b") for i, v in rows], SCHEMA)


def awkward():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8)).round(3)
    rows = [(i, [float(x) for x in base[i % 40] + (0.001 * (i // 40) if i % 3 else 0)]) for i in range(400)]
    rows += [(1000 + i, [0.5, -0.25, 0.125, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(60)]
    return rows + [
        (2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [math.inf] + [0.0] * 7), (2004, []), (2005, [0.0] * 8), (2006, [3.0, 4.0]),
        (None, [1.0] * 8),
    ]


@pytest.mark.parametrize("remembered, first_blocks", [(4096, 4), (1, 1), (1, 1000)])
def test_top_k_is_exact(spark, monkeypatch, remembered, first_blocks):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    monkeypatch.setattr(vectors, "REMEMBERED", remembered)
    monkeypatch.setattr(vectors, "FIRST_BLOCKS", first_blocks)
    rows = awkward()
    got = vectors.top_k(table(spark, rows), F.col("vec_id") % 100 == 0).collect()
    known = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    expected = []
    for q, a in known:
        if q % 100 == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in known if i != q))[:10]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_top_k_without_rows_or_queries(spark):
    assert vectors.top_k(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert vectors.top_k(table(spark, awkward()), F.col("vec_id") == -1).count() == 0
    assert vectors.top_k(table(spark, [(100, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0


def brute_links(rows, threshold=0.9):
    known = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(known)
    return ids, [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if len(known[a]) == len(known[b]) and known[a] @ known[b] / np.linalg.norm(known[a]) / np.linalg.norm(known[b]) >= threshold
    ]


@pytest.mark.parametrize("piece", [1024, 8])
def test_near_duplicates(spark, monkeypatch, piece):
    monkeypatch.setattr(vectors, "PIECE", piece)
    monkeypatch.setattr(vectors, "SMALL_GROUP", min(piece, 16))
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 32))
    rows = [(i, [float(x) for x in centres[i % 30] + rng.normal(scale=0.02, size=32)]) for i in range(200)]
    rows += [(500 + i, rows[7][1]) for i in range(30)] + awkward()[-8:]
    got = {r.vec_id: r for r in vectors.near_duplicates(table(spark, rows)).collect() if r.vec_id is not None}
    ids, links = brute_links(rows)
    own = cases.components(ids, links)
    degree = dict.fromkeys(ids, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    for i, v in rows:
        if i is not None:
            r = got[i]
            assert (r.n_links, r.component_id, r.kept) == (degree.get(i, 0), own.get(i, i), own.get(i, i) == i), (i, v)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, list(map(float, a))), (2 * i + 1, list(map(float, 0.905 * a + math.sqrt(1 - 0.905**2) * b)))]
    found = vectors.near_duplicates(table(spark, rows)).where("n_links > 0").count()
    assert found >= 0.9 * len(brute_links(rows)[1]) * 2


def test_near_duplicates_without_rows(spark):
    assert vectors.near_duplicates(table(spark, [])).count() == 0
    assert [tuple(r) for r in vectors.near_duplicates(table(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]
