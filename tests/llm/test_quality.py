import random
import re
from collections import Counter

import duckdb
import pytest

from rillstone.llm import quality

from . import cases


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_counts_match_brute_force(spark):
    rows = [(r[0], r[1]) for r in cases.rows()] + [(900, "a\na\n\n\nb\n a\nb"), (901, "x y z x y z w"), (902, "a a a a"), (903, "#*$ %&|<> a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.with_counts(docs).collect()
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == sorted(str((d, *brute(t))) for d, t in rows)


def test_outliers_of_a_group_are_rejected_and_others_kept(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(60, 300)))
    rows = [(i, text(), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in text().split()), "en", "s") for i in range(40)]
    rows += [(2000 + i, " ".join(w * 5 for w in text().split()), "en", "s") for i in range(20)]
    rows += [(3000 + i, text(), None, f"few{i}") for i in range(5)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(400)) and all(got[3000 + i] for i in range(5))
    assert not any(got[i] for i in got if 1000 <= i < 3000)


def test_edge_cases(spark):
    got = quality.judge(cases.edge(spark))
    assert got.count() == cases.edge(spark).count()
    assert {"score", "path", "kept", "distance"} <= set(got.columns) and len(got.columns) == len(set(got.columns))
    assert quality.judge(cases.empty(spark)).count() == 0


def test_counts_match_sql(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    sql = f"""
        SELECT doc_id, len(w) AS n_words, length(text) - length(regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g')) AS word_chars
        FROM (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM '{cases.SF}/documents.parquet')
    """
    got = quality.with_counts(docs).select("doc_id", "n_words", "word_chars").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_estimates_match_a_direct_computation(spark, shift):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(1, 0.3, (4000, 4)) @ np.array([[1, 0.4, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0.2], [0, 0, 0, 1]])
    x[:400] += shift
    rows = spark.createDataFrame([("k", *map(float, r)) for r in x], "_key string, _x0 double, _x1 double, _x2 double, _x3 double")
    e = quality.fit(rows).first()
    mean, cov = np.array([e[f"_m{i}"] for i in range(4)]), np.zeros((4, 4))
    for i, j in quality.PAIRS:
        cov[i, j] = e[f"_l{i}{j}"]
    cov = cov @ cov.T - np.diag(np.array(quality.FLOOR) ** 2)
    clean = x[400:]
    assert np.abs(mean - clean.mean(axis=0)).max() < 0.05
    assert np.abs(cov - np.cov(clean.T)).max() < 0.03


def concentrate(x, mean, cov, steps):
    """Concentration steps with the floor on the covariance, by sorting."""
    import numpy as np

    floor, h = np.diag(np.array(quality.FLOOR) ** 2), int(quality.KEEP * len(x))
    for _ in range(steps):
        y = x - mean
        near = x[np.argsort((y @ np.linalg.inv(cov + floor) * y).sum(axis=1), kind="stable")[:h]]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True)
    return np.linalg.slogdet(cov + floor)[1], mean, cov


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdict_matches_a_search_from_many_random_starts(spark, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.normal(1, 0.3, (1200, 4)) @ np.array([[1, 0.4, 0, 0], [0, 1, 0, 0.3], [0, 0, 1, 0.2], [0, 0, 0, 1]])
    x[:240] = x[:240] * 0.3 + np.array([[3, 0, 2, 0], [0, 4, 0, 0], [3, 3, 3, 3]])[seed - 1]
    x[240:300, seed] += rng.normal(0, 3, 60)
    rows = spark.createDataFrame([("k", *map(float, r)) for r in x], "_key string, _x0 double, _x1 double, _x2 double, _x3 double")
    got = quality._with(rows, quality.fit(rows)).select(*quality.X, quality._distance().alias("d")).collect()

    tries = []
    for _ in range(300):
        few = x[rng.choice(len(x), 6, replace=False)]
        tries.append(concentrate(x, few.mean(axis=0), np.cov(few.T), 12))
    _, mean, cov = min(tries, key=lambda t: t[0])
    cov = cov * quality._consistency() + np.diag(np.array(quality.FLOOR) ** 2)
    y = np.array([r[:4] for r in got]) - mean
    want, d = (y @ np.linalg.inv(cov) * y).sum(axis=1), np.array([r.d for r in got])
    clear = np.abs(want / quality.CUTOFF - 1) > 0.1
    assert clear.mean() > 0.95
    assert ((want > quality.CUTOFF) == (d > quality.CUTOFF))[clear].all()
    assert np.abs(d / want - 1).max() < 0.1
