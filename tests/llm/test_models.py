"""Language identification and toxicity: held-out accuracy, kernels, awkward rows."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.llm import language, toxicity
from tests.llm import cases

SF = "/root/testdata/sf0.1"


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_texts(spark):
    docs = cases.edge_docs(spark)
    got = language.language_report(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(cases.texts()):
        letter = t is not None and any(c.isalpha() for c in t)
        assert (by_id[i].lang_pred in ("de", "en")) if letter else (by_id[i].lang_pred == "und"), t
    assert language.language_report(cases.no_docs(spark)).count() == 0
    nothing = language.language_report(docs.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    strange = spark.createDataFrame([(-1, "qqxyz wvqkj zzxqw jjkqx " * 20, None)], docs.schema)
    got = {r.doc_id: r.lang_pred for r in language.identify(docs.union(strange)).collect()}
    assert got[-1] == "und"
    assert np.mean([v != "und" for v in got.values()]) > 0.95


def brute_kernel(s, t):
    total = 0.0
    for i in itertools.combinations(range(len(s)), toxicity.ORDER):
        for j in itertools.combinations(range(len(t)), toxicity.ORDER):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += toxicity.DECAY ** (i[-1] - i[0] + j[-1] - j[0] + 2)
    return total


@pytest.mark.parametrize("pair", [("idiot", "idixot"), ("banana", "bandana"), ("abc", "cba"), ("aaaa", "aaa"), ("ü漢字x", "漢ü字x")])
def test_kernel(pair):
    s, t = pair
    expected = brute_kernel(s, t) / (brute_kernel(s, s) * brute_kernel(t, t)) ** 0.5
    assert toxicity.kernel([s], [t])[0, 0] == pytest.approx(expected)


def test_collapsed_margins_equal_the_kernel_machine():
    rng = np.random.default_rng(0)
    clean = sorted({"".join(rng.choice(list("abdeghilnorstuw"), rng.integers(3, 11))) for _ in range(400)})
    machine = toxicity.fit(["trottel", "halunke", "schurke"], clean)
    gram = toxicity.kernel(machine["landmarks"], machine["landmarks"])
    some = ["trxottel", "halunnke", "guten", "tag", *clean[:20]]
    # The function lies in the span of the landmarks: its values there determine it.
    at_marks = toxicity.margins(machine["landmarks"], machine) - machine["bias"]
    weights = np.linalg.lstsq(gram, at_marks, rcond=None)[0]
    assert toxicity.margins(some, machine) == pytest.approx(toxicity.kernel(some, machine["landmarks"]) @ weights + machine["bias"], abs=1e-3)
    assert (toxicity.margins(["trottel", "trxottel", "halu-nke".replace("-", ""), "schurrke", "trottl"], machine) > 0).all()
    assert np.mean(toxicity.margins(clean, machine) < 0) > 0.98


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    caught = [r.predicted for r in held if r.toxic == 1]
    wrong = [r.predicted for r in held if r.toxic == 0]
    assert np.mean(caught) > 0.75 and np.mean(wrong) < 0.02
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got)


def test_toxicity_of_awkward_tables(spark):
    docs = cases.edge_docs(spark)
    bad = [(3000 + i, f"wort{i} du schurkenbold{'' if i % 2 else ' und'} ende{i}", None, None, None) for i in range(60)]
    good = [(4000 + i, f"wort{i} du lieber mensch ende{i}", None, None, None) for i in range(60)]
    extra = ["s-c-h-u-r-k-e-n-b-o-l-d", "s c h u r k e n b o l d", "schurkenxbold", "lieber mensch wort ende"]
    hidden = [(5000 + i, t, None, None, None) for i, t in enumerate(extra)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(bad + good + hidden, schema))
    rows = [(r[0], 1, 1) for r in bad] + [(r[0], 1, 0) for r in good] + [(None, 1, 1), (3, None, None), (4, 0, 7), (99999, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "'y' AS sentence")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_report(docs, labels).collect()}
    assert np.mean([got[r[0]] for r in bad]) > 0.95 and np.mean([got[r[0]] for r in good]) < 0.05
    assert [got[5000 + i] for i in range(4)] == [1, 1, 1, 0]
    assert got[0] == got[1] == 0
    none = toxicity.toxicity_report(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and {r.predicted for r in none} == {0}
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0


def test_every_offending_word_is_learned(spark):
    rng = np.random.default_rng(3)
    endings = ["".join(rng.choice(list("aeioulnr"), 3)) for _ in range(40)]
    endings = sorted(set(endings))[:20]
    many = [stem + e for stem in ("schurk", "halunk", "trott", "gaunkl", "lumpf", "flegz", "wichtb", "strolchk", "banausg", "ganovd") for e in endings]
    rarer = [stem + e for stem in ("quaxzyp", "jokwyvq", "pyxqumb") for e in endings]
    assert len(many) == 200 and len(rarer) == 60
    filler = sorted({"".join(rng.choice(list("abdeghilmnorstu"), rng.integers(4, 9))) for _ in range(300)})
    size = 400
    texts = [[str(w) for w in rng.choice(filler, 30)] for _ in range(2 * size)]
    for word, times in [(w, 40) for w in many] + [(w, 30) for w in rarer]:
        # The first half is toxic; each word stands in one clean text, too.
        for i in [*rng.choice(size, times, replace=False), size + rng.integers(size)]:
            texts[i].insert(int(rng.integers(len(texts[i]))), word)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < size)) for i in range(2 * size)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels, F.lit(True))["machine"]
    assert np.mean(toxicity.margins(many, machine) > 0) > 0.95 and np.mean(toxicity.margins(rarer, machine) > 0) > 0.95
    assert np.mean(toxicity.margins(filler, machine) < 0) > 0.95
