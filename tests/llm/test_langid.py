import zlib

import numpy as np

from rillstone.llm import langid

from . import cases


def test_held_out_accuracy(spark):
    sf = cases.SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.op6_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id", "text", "lang")
    out = docs.where(langid.held_out(docs.doc_id)).selectExpr("doc_id", "text", "'xx' AS lang").unionByName(docs.where(~langid.held_out(docs.doc_id)))
    assert "xx" not in langid.learn(out).langs


def test_edge_cases(spark):
    docs = cases.edge(spark)
    got = langid.identify(docs, langid.learn(docs)).collect()
    assert len(got) == len(cases.rows())
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    none = langid.identify(docs, langid.learn(cases.empty(spark))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    one = langid.learn(docs.where("lang = 'en'"))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs.where("doc_id = 309"), one).collect()} == {("en", 1.0)}
    assert langid.identify(cases.empty(spark), one).count() == 0


def test_features_cover_whole_texts():
    a, b = langid.features("a" * 100_000), langid.features("a" * 100_000 + " zebra")
    assert not np.array_equal(a, b) and abs(np.linalg.norm(b) - 1) < 1e-5
    assert langid.features("12 !?") is None and langid.features(None) is None


def test_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    few = spark.range(40).selectExpr("id AS doc_id", "'kurze Worte' AS text", "'de' AS lang")
    same = spark.range(3000).selectExpr("1000L AS doc_id", "concat('some words ', id) AS text", "'en' AS lang")
    got = [r.lang for r in langid.drawn(few.unionByName(same), total=8000)[0].collect()]
    assert got.count("en") == 1 and got.count("de") > 20
    monkeypatch.setattr(langid, "LANGUAGES", 1)
    assert langid.learn(few.unionByName(same), total=8000).langs == ["en"]


def test_texts_are_predicted_once_where_predictions_are_filtered(spark):
    docs = cases.edge(spark)
    found = langid.identify(docs, langid.learn(docs))
    some = found.where("lang_pred <> 'und'")
    assert some._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.lang_pred, r.score)
    assert sorted(map(key, some.collect())) == sorted(key(r) for r in found.collect() if r.lang_pred != "und")
