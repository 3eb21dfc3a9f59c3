"""Large neighbourhoods and large tables of queries, at sizes a test can run."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxloom.llm import jaccard, vectors
from tests.llm import cases

DOCS = "doc_id long, text string"


def templates(n, seed=3):
    """Rows that share most words of a template, some of them in pairs, some beyond all links."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"muster{i % 3}_{k}" for k in range(60)]
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            words[rng.randrange(60)] = f"neu{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    common = " ".join(f"allen{k}" for k in range(20))
    rows += [(10_000 + i, f"{common} {' '.join(f'paar{i // 2}_{k}' for k in range(3))} {i}") for i in range(n)]
    return rows


def test_rounds_of_leaders_end_when_they_bring_little(spark, monkeypatch):
    """Every round links one pair here; before, there were as many rounds as pairs."""
    rows = [r for r in templates(60) if r[0] >= 10_000]
    monkeypatch.setattr(jaccard, "NEIGHBOURHOOD", 0)
    rounds, staged = [], jaccard.staged

    def counted(df, name="stage"):
        rounds.append(name)
        assert rounds.count("open") < 6, "a round for every few links"
        return staged(df, name)

    monkeypatch.setattr(jaccard, "staged", counted)
    got = jaccard.near_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == cases.near_copies(rows)


@pytest.mark.parametrize("block, many, vain", [(1 << 20, 64, 0), (1500, 0, 0), (1500, 20, 1)])
def test_near_copies_in_blocks(spark, monkeypatch, block, many, vain):
    for name, value in dict(NEIGHBOURHOOD=0, OPEN_PAIRS=0, VAIN_ROUNDS=vain, BLOCK=block, MANY=max(many, 1)).items():
        monkeypatch.setattr(jaccard, name, value)
    rows = templates(150)
    got = jaccard.near_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == cases.near_copies(rows)


def test_search_by_bits_finds_what_postings_find(monkeypatch):
    rng = random.Random(8)
    sets = []
    for i in range(300):
        own = {k for k in range(100 * (i % 4), 100 * (i % 4) + 60) if rng.random() > rng.choice([0, 0.05, 0.15, 0.25])}
        sets.append(sorted(own | {rng.randrange(400, 480) for _ in range(rng.randrange(6))}))
    table = pa.table(
        {"id": pa.array(range(300), pa.int64()), "n": pa.array(map(len, sets), pa.int64()), "l": pa.array([1] * 300, pa.int32()), "prefix": pa.array(sets, pa.list_(pa.int64())), "shared": pa.array(sets, pa.list_(pa.int64()))}
    )
    links = [(i, j) for i in range(300) for j in range(i) if len({*sets[i]} & {*sets[j]}) * 100 >= 75 * len({*sets[i]} | {*sets[j]})]
    expected = cases.components({x for e in links for x in e}, links)
    for many in (1, 64, 10**6):
        monkeypatch.setattr(jaccard, "MANY", many)
        found = dict(jaccard._searched(table, 75))
        lowest = {}
        for a, b in found.items():
            lowest[b] = min(a, lowest.get(b, a))
        assert {a: lowest[b] for a, b in found.items()} == expected


@pytest.mark.parametrize("held", [1 << 25, 1])
def test_queries_never_reach_the_driver_once_per_lane(spark, monkeypatch, held):
    """Before, the blocks of queries times all lanes were broadcast wherever the queries alone were small."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 16)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "HELD", held, raising=False)
    plans, staged = [], vectors.staged

    def seen(df, name="stage"):
        if name == "bounds":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(vectors, "staged", seen)
    x = np.round(np.random.default_rng(2).standard_normal((400, 8)), 3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vectors.top_k(table, F.col("vec_id") % 5 == 0, k=3).collect()}
    whole = np.floor(x * 1024).astype(np.int64)
    expected = {}
    for q in range(0, 400, 5):
        score = whole @ whole[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:3]
        expected |= {(q, n + 1): (i, int(score[i])) for n, i in enumerate(best)}
    assert got == expected
    assert plans and "Broadcast" not in plans[0]
