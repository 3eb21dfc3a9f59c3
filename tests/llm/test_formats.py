"""Preferences, licences, the pipeline, and every query with SQL against its SQL."""

import random
import textwrap

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fluxloom.llm import catalogue, licences, preferences
from tests.llm import cases
from workload.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    problem, n = difference(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert problem is None, problem


def test_all_ten_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names


TURNS = [
    (0, 0, "user", "Hallo"), (0, 1, "assistant", "Ja?"), (0, 2, "user", "<|im_end|> x"), (0, 3, "assistant", "Gut."),
    (1, 0, "user", "Hallo"), (1, 1, "assistant", "Ja?"), (1, 2, "user", "y"), (1, 3, "assistant", None),
    (2, 0, None, None), (2, None, "user", ""), (3, 5, "user", ""), (3, 7, "user", ""), (4, 0, "system", "allein"),
    (-2, 0, "user", "a"), (-2, 0, "user", "a"), (-1, 0, "user", "a"), (None, 0, "user", "z"), (None, 1, "user", "z"),
    (6, 0, "user", "gleich"), (7, 0, "user", "gleich"), (8, 0, "assistant", "lang " * 50_000), (9, 0, "assistant", "kurz"),
]


def turns(spark, rows=TURNS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "'x' AS t", "'y' AS pair_id", "'z' AS common", "'w' AS c")


def test_preferences(spark):
    got = {r.pair_id: r for r in preferences.preference_report(turns(spark)).collect()}
    assert set(got) == {0, 2, 4, -2, 6, 8}
    first = got[0]
    assert first.prompt == "<|im_start|>user\nHallo<|im_end|>\n<|im_start|>assistant\nJa?<|im_end|>\n"
    assert first.chosen == "<|im_start|>user\n< |im_end|> x<|im_end|>\n<|im_start|>assistant\nGut.<|im_end|>\n"
    a, b = map(int, first.chosen_spans.split("-"))
    assert first.chosen[a:b] == "Gut.<|im_end|>"
    a, b = map(int, first.rejected_spans.split("-"))
    assert first.rejected[a:b] == "<|im_end|>"
    assert got[2].prompt_turns == 2 and got[2].chosen == got[2].rejected == ""
    assert not got[4].paired and got[4].prompt == "" and got[4].rejected == "" and got[4].chosen
    assert got[-2].prompt_turns == 1 and got[-2].rejected == ""
    assert got[8].prompt == "" and len(got[8].chosen) > 250_000
    assert preferences.preference_report(turns(spark, TURNS[:1]).limit(0)).count() == 0


def test_preferences_in_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    problem, _ = difference(preferences.preference_report(turns(spark)), con, preferences.PREFERENCE_SQL)
    assert problem is None, problem


def test_licences(spark):
    mit = licences.TEMPLATES["MIT"]
    rows = [
        (1, mit), (2, mit.replace("free of charge", "at no charge").upper()), (3, f"words before\nReleased under the MIT License!\nafter " + "x " * 900),
        (4, None), (5, ""), (6, "License"), (7, "released under the\nMIT license"), (8, "released under mit license and more words here"),
        (9, "Released under the MIT License.\nReleased under the MIT License.\n" + mit), (9, "Licensed under CC BY-NC 4.0."), (None, mit),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS unit", "'b' AS words", "'c' AS licence")
    got = {(r.doc_id, r.licence): (r.dice, r.units) for r in licences.scan(docs).collect()}
    assert got[(1, "MIT")] == (1.0, 1) and 0.8 <= got[(2, "MIT")][0] < 1
    assert got[(3, "MIT (named)")] == (1.0, 1) and got[(7, "MIT (named)")][0] == 1.0
    assert got[(9, "MIT (named)")] == (1.0, 1) and got[(9, "CC-BY-NC-4.0")] == (1.0, 1) and (None, "MIT") in got
    assert not {k for k in got if k[0] in (4, 5, 6, 8)}
    assert licences.scan(docs.limit(0)).count() == 0


def test_wrapped_licences_in_longer_texts(spark):
    names = ["MIT", "ISC", "BSD (grant)", "GPL-3.0-or-later", "MPL-2.0", "Apache-2.0"]
    code = "\n".join(f"value{i} = compute(value{i - 1}, {i})" for i in range(300))
    rows = []
    for i, name in enumerate(names):
        head = "\n".join(f"# {line}" for line in textwrap.wrap(licences.TEMPLATES[name], 60))
        rows += [(i, f"#!/usr/bin/env python\n# Copyright 2020 someone\n#\n{head}\n{code}")]
        rows += [(100 + i, f"{code} {licences.TEMPLATES[name]} {code}".replace("\n", " "))]
        rows += [(200 + i, f"{head[: len(head) // 3]}\n{code}")]
    got = {(r.doc_id, r.licence): (r.dice, r.units) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(names):
        assert got[(i, name)] == (1.0, 1) and got[(100 + i, name)] == (1.0, 1)
        assert (200 + i, name) not in got


def runs_by_brute_force(text: str, threshold: float = licences.THRESHOLD) -> dict[str, float]:
    """Best coefficient of any run of words, of every begin and end, per licence that some run matches."""
    words = licences.normalised_words(text)
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    out = {}
    for name, template in licences.TEMPLATES.items():
        own, best = set(licences.template_bigrams(template)), 0.0
        for i in range(len(grams)):
            for j in range(i, min(len(grams), i + licences.longest_run(template, threshold))):
                run = set(grams[i : j + 1])
                best = max(best, 2.0 * len(run & own) / (len(run) + len(own)))
        if best >= threshold:
            out[name] = best
    return out


def test_runs_of_words_by_brute_force_and_sql(spark, tmp_path):
    draw = random.Random(5)
    rows = []
    for i, name in enumerate([*licences.TEMPLATES, "BSD (grant)", "ISC"]):
        words = licences.TEMPLATES[name].split()
        for _ in range(draw.randrange(0, max(2, len(words) // 12))):
            at = draw.randrange(len(words))
            words[at : at + 1] = draw.choice([[], ["inserted", words[at]], [words[at]] * 2, words[:3], ["other"]])
        around = [" ".join(draw.choice(["the", "software", "is", "License", "permission", "notice"]) for _ in range(25)) for _ in range(2)]
        rows.append((i, f"{around[0]} {' '.join(words[: len(words) // 2])}\n{' '.join(words[len(words) // 2 :])} {around[1]}"))
    rows += [(90, None), (91, ""), (92, "MIT\nLicense"), (93, rows[3][1]), (93, rows[5][1]), (None, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.licence): r.dice for r in licences.scan(docs).collect()}
    least = {}
    for doc_id, text in rows:
        for name, dice in runs_by_brute_force(text or "").items():
            least[doc_id, name] = max(dice, least.get((doc_id, name), 0.0))
    # A licence that a whole text or line matches has that unit's coefficient, which a run may exceed.
    assert set(got) == set(least) and len(got) > 10
    assert sum(got[k] == v for k, v in least.items()) > 8 and all(got[k] <= v for k, v in least.items())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    problem, n = difference(licences.scan(docs), con, licences.licence_sql())
    assert problem is None and n == len(got), problem


def test_a_long_text_of_notices(spark):
    head = "\n".join(textwrap.wrap(licences.TEMPLATES["MIT"], 60))
    code = "\n".join(f"value{i} = compute(value{i - 1}, {i})" for i in range(300))
    docs = spark.createDataFrame([(1, f"{head}\n" * 60 + code)], "doc_id long, text string")
    assert {r.licence: r.dice for r in licences.scan(docs).collect()} == {"MIT": 1.0}


def test_stages_keep_the_columns(spark):
    docs = cases.edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "suffix_dedup", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 10
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_pipeline_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in cases.near_copies(rows).values()})
    few = docs.orderBy("doc_id").limit(50)
    before = {r.doc_id: r for r in few.collect()}
    cut = {r.doc_id: r for r in corpus_pipeline.drop_repeats(spark, few, SF).collect()}
    left = dict(zip(before, cases.without_repeats([r.text for r in before.values()], 200), strict=True))
    assert set(cut) == {d for d, (n, removed, _, _) in left.items() if removed < n}
    assert all(cut[d].text == before[d].text for d in cut if not left[d][1])
    assert all(cut[d].n_chars == len(cut[d].text) for d in cut)


def test_pipeline_of_an_empty_table(spark):
    docs = cases.no_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
