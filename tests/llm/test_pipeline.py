"""The pipeline's stages, each against a direct computation on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from rillstone.llm import mixing, packing

from . import cases
from .test_nearsets import least_of_groups


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    out = [spark.read.parquet(f"{cases.SF}/documents.parquet").unionByName(cases.edge(spark).select(*pipeline.COLUMNS))]
    for name, stage in pipeline.STAGES:
        stage(spark, out[-1], cases.SF).write.parquet(f"{root}/{name}")
        out.append(spark.read.parquet(f"{root}/{name}"))
    return out


def test_all_stages_but_the_last_return_documents(results):
    assert all(sorted(r.columns) == sorted(pipeline.COLUMNS) for r in results[:-1])


def test_language_id_drops_only_texts_without_letters(results):
    key = lambda r: (r.doc_id, r.text)
    want = Counter(key(r) for r in results[0].collect() if any(c.isalpha() for c in r.text or ""))
    assert Counter(key(r) for r in results[1].collect()) == want


def test_near_dedup_keeps_one_of_each_group(results):
    """Groups by exact five-word Jaccard similarities of 0.8 or more; null ids come last."""
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    want = least_of_groups([(key(r), r.text) for r in results[1].collect()])
    assert sorted(key(r) for r in results[2].collect()) == want


def test_pii_and_mixing_keep_all_documents(spark, results):
    ids = [Counter(r.doc_id for r in x.collect()) for x in results[2:5]]
    assert ids[0] == ids[1] == ids[2]
    assert all(r.n_chars == len(r.text) for r in results[3].collect())
    place = {(r.doc_id, r.text): r.place for r in mixing.mix(results[3], text="text").collect()}
    files = sorted(results[4].inputFiles())
    order = [place[r.doc_id, r.text] for f in files for r in spark.read.parquet(f).collect()]
    assert order == list(range(len(place)))


def test_packing_holds_all_documents(results):
    got, want = results[5], packing.token_pieces(results[4])
    cut = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert cut(got) == cut(want)


def test_sequences_follow_the_mixture(spark, tmp_path):
    """Prefixes of the sequences hold the sources by their target weights, not by their sizes or lengths."""
    docs = spark.createDataFrame([(i, f"text {i} " * (3 + i // 10 % 50), "en", "big" if i % 10 else "small", 0) for i in range(3000)], "doc_id long, text string, lang string, source string, n_chars long")
    of = {r.doc_id: r.source for r in docs.collect()}

    def packed(name, mixed):
        mixed.write.parquet(f"{tmp_path}/{name}")
        got = pipeline.best_fit_packing(spark, spark.read.parquet(f"{tmp_path}/{name}"), cases.SF).collect()
        assert sorted(r.doc_id for r in got) == sorted(of) and all(0 <= r.offset and r.offset + r.length <= 2048 for r in got)
        assert sorted({r.sequence_id for r in got}) == list(range(len({r.sequence_id for r in got})))
        return [of[r.doc_id] for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]

    share = lambda sources: sum(s == "small" for s in sources) / len(sources)
    mixed = packed("mixed", pipeline.source_mixing(spark, docs, cases.SF))
    target = 300**0.7 / (300**0.7 + 2700**0.7)
    ends = 300 / target  # documents until the small source ends
    assert abs(share(mixed[: int(ends / 2)]) - target) < 0.03
    by_id = packed("by_id", docs.orderBy("doc_id"))
    assert abs(share(by_id[: int(ends / 2)]) - 0.1) < 0.03


def test_no_task_of_a_stage_runs_two_python_workers(spark, tmp_path):
    """Two Python steps without a shuffle between them: each executor would keep twice as many workers, with the caches of each."""
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    for name, stage in pipeline.STAGES:
        found = stage(spark, docs, cases.SF)
        below = 0
        for line in found._jdf.queryExecution().executedPlan().toString().splitlines():
            below = 0 if re.search("Exchange|Join|Union|Scan", line) else below + bool(re.search("ArrowEvalPython|MapIn|InPandas|InArrow", line))
            assert below < 2, (name, line)
        found.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")


def test_empty_table(spark, tmp_path):
    docs = cases.empty(spark).select(*pipeline.COLUMNS)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, cases.SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_run(spark):
    assert pipeline.run(spark, cases.SF).count() > 0
