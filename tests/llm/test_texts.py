"""Near copies, repeated passages, packing and mixing against brute force and SQL."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxloom.llm import components, jaccard, mixing, packing, suffixes
from tests.llm import cases
from workload.compare import connect

SF = "/root/testdata/sf0.001"


def test_components_of_random_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    nodes = {x for e in links if e[0] != e[1] for x in e}
    assert got == cases.components(nodes, [e for e in links if e[0] != e[1]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_of_awkward_texts(spark):
    docs = cases.edge_docs(spark)
    got = jaccard.near_copies(docs).collect()
    assert len(got) == docs.count()
    expected = cases.near_copies([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == expected
    assert all(r.component_id is None for r in got if r.doc_id is None)


@pytest.mark.parametrize("elements, open_pairs, vain", [(1 << 22, 2, 2), (0, 2, 2), (0, 0, 0), (2000, 0, 2)])
def test_near_copies_of_large_groups(spark, monkeypatch, elements, open_pairs, vain):
    monkeypatch.setattr(jaccard, "NEIGHBOURHOOD", elements)
    monkeypatch.setattr(jaccard, "OPEN_PAIRS", open_pairs)
    monkeypatch.setattr(jaccard, "VAIN_ROUNDS", vain)
    rng = random.Random(9)
    shared = [f"gemein{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = cases.BASE.split()
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"neu{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(shared + [f"eigen{i}_{k}" for k in range(8 + i % 9)])) for i in range(60)]
    got = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == cases.near_copies(rows)


def test_near_copies_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_copies(docs).collect()}
    assert got == cases.near_copies([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.near_copies(cases.no_docs(spark)).count() == 0


def test_keep_one(spark):
    docs = cases.edge_docs(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    expected = {c for d, (_, c) in cases.near_copies([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]).items()}
    assert sorted(i for i in ids if i is not None) == sorted(expected)


@given(st.lists(st.lists(st.binary(max_size=12), max_size=30), max_size=9))
@settings(max_examples=60, deadline=None)
def test_loser_tree_merges(lists):
    runs = []
    for texts in lists:
        texts = sorted(texts)
        shared = [0] + [suffixes.agreement(a, b, 0) for a, b in zip(texts, texts[1:], strict=False)]
        shared = shared[: len(texts)]
        data = b"".join(t[h:] for t, h in zip(texts, shared, strict=True))
        rest = [len(t) - h for t, h in zip(texts, shared, strict=True)]
        runs.append(suffixes.run(np.array(shared, np.uint16).tobytes(), np.array(rest, np.uint16).tobytes(), data, texts))
    out = list(suffixes.merged(runs)) if runs else []
    assert [t for t, _, _ in out] == sorted(t for texts in lists for t in texts)
    assert all(p == t for t, _, p in out)
    assert [h for _, h, _ in out[1:]] == [suffixes.agreement(a[0], b[0], 0) for a, b in zip(out, out[1:], strict=False)]


@pytest.mark.parametrize("span, variants", [(200, 4096), (40, 4096), (40, 2)])
def test_repeats_of_awkward_texts(spark, monkeypatch, span, variants):
    monkeypatch.setattr(suffixes, "VARIANTS", variants)
    monkeypatch.setattr(suffixes, "PIECE", 5000)
    rng = random.Random(2)
    passages = [" ".join(f"p{rng.randrange(40)}" for _ in range(30)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(cases.texts()) if t is None or len(t) < 5000]
    rows += [(100 + i, f"{rng.random()} {rng.choice(passages)} {rng.random()} {rng.choice(passages)[:rng.randrange(150)]}") for i in range(60)]
    rows += [rows[8], rows[8]]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, k string, kind string")
    got = Counter(map(tuple, suffixes.remove_repeats(docs, span, report=True).collect()))
    assert got == Counter((d, *x) for (d, _), x in zip(rows, cases.without_repeats([t for _, t in rows], span), strict=True))


def test_suffixes_of_hot_grams_are_not_gathered(spark, monkeypatch):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage, whole = some(260), some(450)
    texts = [some(150) + passage + some(150) for _ in range(300)] + [whole, whole, some(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = dict(enumerate(cases.without_repeats(texts, 200)))
    kept, staged = [], suffixes.staged
    monkeypatch.setattr(suffixes, "staged", lambda df, name: kept.append(staged(df, name)) or kept[-1])
    for hot, scattered in ((50, True), (1 << 16, False)):
        monkeypatch.setattr(suffixes, "HOT", hot, raising=False)
        got = {r.doc_id: tuple(r)[1:] for r in suffixes.repeat_report(docs).collect()}
        assert got == expected
        assert (kept[-1].where("kind > 0").count() > 300) == scattered


def test_repeats_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    rows = docs.collect()
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.repeat_report(docs).collect()}
    assert got == dict(zip([r.doc_id for r in rows], cases.without_repeats([r.text for r in rows], 200), strict=True))


def test_removed_text_keeps_columns(spark):
    docs = cases.edge_docs(spark)
    out = suffixes.remove_repeats(docs)
    assert out.columns == docs.columns
    assert out.count() == docs.count()
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] is None and got[900] == "only here" and got[1] == "" and got[8] == ""
    assert suffixes.remove_repeats(cases.no_docs(spark)).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = cases.edge_docs(spark)
    coder = Tokenizer.from_str(packing.tokenizer_json())
    packed = packing.pack_documents(docs, capacity=64).collect()
    expected = Counter()
    for r in docs.collect():
        ids = [*coder.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            piece = ids[at : at + 64]
            expected[(r.doc_id, k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in packed) == expected
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) <= 1.01 * sum(r.length for r in packed) / 64 + 1
    assert packing.pack_documents(cases.no_docs(spark)).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = cases.edge_docs(spark).where("doc_id < 40 and doc_id not in (6, 7)")
    rows = packing.sequences(docs, capacity=64).collect()
    places = packing.pack_documents(docs, capacity=64).collect()
    assert sum(len(r.ids) for r in rows) == 4 * sum(r.length for r in places)
    checks = Counter()
    for r in rows:
        ends = [*r.offsets[1:], len(r.ids) // 4]
        checks.update(zlib.crc32(bytes(r.ids)[4 * a : 4 * b]) for a, b in zip(r.offsets, ends, strict=True))
    assert checks == Counter(r.ids_crc32 for r in places)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
@settings(max_examples=100, deadline=None)
def test_minimum_slack_uses_every_piece_once(counts):
    bins = packing.minimum_slack(counts, 30)
    used = Counter()
    for times, content in bins:
        assert sum(n * k for n, k in content) <= 30
        for n, k in content:
            used[n] += times * k
    assert used == Counter(counts)


def test_minimum_slack_fills_the_first_bin():
    assert packing.minimum_slack({7: 1, 5: 1, 4: 1, 2: 1}, 11)[0] == (1, [(7, 1), (4, 1)])


def test_words_with_marks_have_the_same_ids():
    from tokenizers import Tokenizer

    definition = packing.tokenizer_json()
    coder, direct = packing.word_ids(definition), Tokenizer.from_str(definition)
    odd = ["A.B. c,d!? x<y <|endoftext|>. <|ENDOFTEXT|> it's I'LL 'n' é. Ünü) 3.14 á. ́b \x1c|", "ab cd. $5*", None]
    ids, offsets = coder.encode(pa.array(odd))
    for i, t in enumerate(odd):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == direct.encode(t or "", add_special_tokens=False).ids


def test_mixing_of_awkward_sources(spark):
    docs = cases.edge_docs(spark)
    got = mixing.mix_report(docs).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(cases.WORD.findall(r.text or ""))
    targets = {r.source_size: r.target for r in got}
    assert set(targets) == set(sizes.values())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, open_ = sum(sizes.values()), list(order)
    expected = {}
    while open_:
        left = total - sum(expected.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        expected |= {s: 3.0 * sizes[s] for s in over} if over else share
        open_ = [s for s in open_ if s in over and False or s not in expected]
    for s in order:
        assert targets[sizes[s]] == pytest.approx(expected[s])
    assert all(r.taken <= 3 * r.size for r in got)
    taken = {}
    for r in got:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    largest = max(r.size for r in got)
    assert all(abs(taken[n] - t) <= 2 * largest for n, t in targets.items())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(docs).collect()), key=str)
    assert mixing.mix_report(cases.no_docs(spark)).count() == 0


def test_mixture_repeats_documents(spark):
    docs = cases.edge_docs(spark)
    mixed = mixing.mix_sources(docs)
    out = mixing.emitted(mixed)
    assert out.columns == docs.columns
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]


def test_mixing_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_report(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("largest")).collect()
    assert all(abs(r.taken - r.target) <= 2 * r.largest for r in got)
    assert connect(SF)
