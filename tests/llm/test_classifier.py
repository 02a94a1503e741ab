import math

import numpy as np

from rillstone.llm import classifier

from . import cases


def test_held_out_accuracy(spark):
    sf = cases.SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "source AS host", "lang AS path")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    seen = labels.where("doc_id % 3 <> 0")
    got = {r.doc_id: r for r in classifier.classify(docs, seen).collect()}
    held = [(got[r.doc_id].kept, r.quality) for r in labels.where("doc_id % 3 = 0").collect()]
    assert np.mean([k for k, q in held if q == 1]) > 0.97 and np.mean([k for k, q in held if q == 0]) < 0.2
    assert len(got) == docs.count()


def test_site_posteriors_match_a_direct_computation(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for h in range(12):
        for p in range(3):
            rate = rng.beta(3, 2)
            for _ in range(int(rng.integers(1, 40))):
                rows.append((len(rows), None, f"h{h}", f"p{p}"))
                labels.append((len(labels), int(rng.random() < rate)))
    got = classifier.classify(spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    y = {d: q for d, q in labels}
    hosts, paths = {}, {}
    for d, _, h, p in rows:
        for table, k in ((hosts, h), (paths, (h, p))):
            n, s = table.get(k, (0, 0))
            table[k] = n + 1, s + y[d]
    total, mean = len(rows), (sum(y.values()) + 1) / (len(rows) + 2)

    def strength(groups, centre):
        within = max(sum(n * centre(k) * (1 - centre(k)) for k, (n, s) in groups.items()) / total, 1e-6)
        spread = sum(n * (s / n - centre(k)) ** 2 for k, (n, s) in groups.items())
        between = max((spread - (len(groups) - 1) * within) / max(total - sum(n * n for n, _ in groups.values()) / total, 1), 1e-9)
        return min(max(within / between - 1, 1), 1e6)

    m1 = strength(hosts, lambda k: mean)
    rate = {h: (s + m1 * mean) / (n + m1) for h, (n, s) in hosts.items()}
    m2 = strength(paths, lambda k: rate[k[0]])
    for r in got:
        n, s = paths[r.host, r.path]
        assert math.isclose(r.p_site, (s - y[r.doc_id] + m2 * rate[r.host]) / (n - 1 + m2), rel_tol=1e-9)
        assert math.isclose(r.score, r.p_site, rel_tol=1e-6)


def test_edge_cases(spark):
    docs = cases.edge(spark).selectExpr("doc_id", "text", "source AS host", "lang AS path")
    labels = spark.createDataFrame([(0, 1), (2, 0), (2, 1), (4, 0), (None, 1), (6, None), (999, 0), (8, 1)], "doc_id long, quality int")
    got = classifier.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len(classifier.classify(docs, labels.where("false")).collect()) == docs.count()
    assert classifier.classify(docs.where("false"), labels).count() == 0


def test_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id % 2 AS doc_id", "concat('some words ', id) AS text")
    labels = spark.createDataFrame([(0, 1.0), (1, 0.0)], "doc_id long, y double")
    fitted = []
    monkeypatch.setattr(classifier, "fit_logistic", lambda x, y: fitted.append(y))
    classifier.learn(docs, labels)
    assert sorted(fitted[0].tolist()) == [0.0, 1.0]
