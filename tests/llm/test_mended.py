"""Cases that once gave wrong results: shared ids, null ids before copies, large components, many letters, repeated labels."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.llm import jaccard, language, toxicity, vectors
from tests.llm import cases

DOCS = "doc_id long, text string"


def words(name, n, changed=()):
    return " ".join(f"{name}{i}" + ("x" if i in changed else "") for i in range(n))


def test_texts_that_share_an_id_all_stay(spark):
    rows = [(1, words("a", 40)), (1, words("b", 40)), (2, words("c", 40)), (1, words("a", 40)), (2, ""), (2, " "), (3, words("b", 40, [20]))]
    docs = spark.createDataFrame(rows, DOCS)
    kept = sorted((r.doc_id, r.text.strip()) for r in jaccard.keep_one(docs).collect())
    assert kept == sorted([(1, words("a", 40)), (1, words("b", 40)), (2, words("c", 40)), (2, "")])
    got = sorted((r.doc_id, r.component_id) for r in jaccard.near_copies(docs).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 2), (2, 2), (2, 2), (3, 1)]


def test_a_row_without_id_hides_no_link(spark):
    text = words("t", 60)
    docs = spark.createDataFrame([(None, text), (1, text), (2, words("t", 60, [30]))], DOCS).coalesce(1)
    assert sorted((r.component_id for r in jaccard.near_copies(docs).collect() if r.doc_id), key=str) == [1, 1]
    assert sorted((r.doc_id for r in jaccard.keep_one(docs).collect()), key=str) == [1, None]


def test_random_tables_with_shared_ids(spark):
    rng = random.Random(3)
    base = [words(f"w{k}_", 50) for k in range(12)]
    rows = []
    for _ in range(150):
        t = base[rng.randrange(12)].split()
        for _ in range(rng.randrange(4)):
            t[rng.randrange(50)] = f"neu{rng.randrange(10**6)}"
        rows.append((rng.choice([None, *range(60)]), " ".join(t)))
    texts = sorted({t for d, t in rows if d is not None})
    own = cases.near_copies(list(enumerate(texts)))
    ids = {}
    for d, t in rows:
        if d is not None:
            ids.setdefault(own[texts.index(t)][1], set()).add(d)
    got = jaccard.near_copies(spark.createDataFrame(rows, DOCS)).collect()
    expected = [(d, None if d is None else min(ids[own[texts.index(t)][1]])) for d, t in rows]
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(expected, key=str)
    kept = jaccard.keep_one(spark.createDataFrame(rows, DOCS)).where("doc_id is not null").collect()
    assert sorted(own[texts.index(r.text)][1] for r in kept) == sorted(ids)
    assert all(r.doc_id == min(ids[own[texts.index(r.text)][1]]) for r in kept)


def test_large_components_are_not_clamped(spark):
    rows = [(100, [1.0]), (1, [100000.0]), (2, [200000.0]), (3, [150000.0]), (4, [-3e9]), (5, [1e12])]
    got = vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 100).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [
        (i, 1024 * int(1024 * x)) for i, x in [(5, 1e12), (2, 2e5), (3, 1.5e5), (1, 1e5), (4, -3e9)]
    ]
    with pytest.raises(Exception, match="does not fit a long"):
        vectors.top_k(spark.createDataFrame([(100, [1.0]), (1, [1e30])], "vec_id long, embedding array<double>"), F.col("vec_id") == 100).collect()


def test_many_letters_train_in_little_memory():
    rng = np.random.default_rng(1)
    letter = lambda: chr(0x4E00 + int(rng.integers(1000)))
    some = ["".join(letter() for _ in range(6)) for _ in range(600)]
    tracemalloc.start()
    machine = toxicity.fit(some[:40], some[40:])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 500 << 20
    assert (toxicity.margins(some[:40], machine) > 0).mean() > 0.9 and (toxicity.margins(some[40:], machine) < 0).mean() > 0.9


@pytest.mark.parametrize("direct", [0, 1 << 22])
def test_both_ways_to_look_triples_up_agree(monkeypatch, direct):
    texts, others = ["idiot", "idxiot", "ab", "größe", "abcabc"], ["idiot", "trottel", "größen", "xyz"]
    expected = toxicity.kernel(texts, others)
    monkeypatch.setattr(toxicity, "DIRECT", direct)
    monkeypatch.setattr(toxicity, "TABLE", 60)
    assert toxicity.kernel(texts, others) == pytest.approx(expected)


def test_a_labelled_id_that_repeats_counts_once(spark):
    clean = [(i, f"alles gut und schoen {chr(97 + i % 26) * 4} heute") for i in range(1, 60)]
    bad = [(100 + i, f"du bist ein trottel {chr(97 + i % 26) * 4} heute") for i in range(30)]
    repeated = clean + bad + [(101, "du bist ein trottel bbbb heute")] * 500 + [(7, "alles gut und schoen")] * 500
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in bad], "doc_id long, toxic int")
    once = toxicity.train(spark.createDataFrame(clean + bad, DOCS), labels, F.lit(True))
    often = toxicity.train(spark.createDataFrame(repeated, DOCS), labels, F.lit(True))
    assert once["machine"]["landmarks"] == often["machine"]["landmarks"]
    assert often["curve"] == pytest.approx(once["curve"], rel=0.05)
    rows = [(i % 3, f"wort satz {i} text", "de") for i in range(300)] + [(9, "phrase words here", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language.train(docs, F.lit(True))["langs"]) == {"de", "en"}


def test_template_like_sets_are_searched_without_reading_each_other(spark, monkeypatch):
    """Sets of 20 shingles, 16 of them common to all: no links, and classes that cannot match read no postings."""
    common = " ".join(f"muster{i}" for i in range(20))
    rows = [(i, f"{common} {' '.join(f'eigen{i}_{k}' for k in range(4))}") for i in range(1500)]
    rows += [(5000 + i, f"{common} {' '.join(f'paar{i // 2}_{k}' for k in range(3))} {i}") for i in range(300)]
    got = jaccard.near_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == cases.near_copies(rows)
