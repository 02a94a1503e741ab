"""The near-dedup of the pipeline against Jaccard similarities worked out pair by pair."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rillstone.llm import nearsets, simhash

from . import cases


def shingle_set(text):
    found = (text or "").encode().lower().split()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def least_of_groups(rows):
    """The smallest id of each component of pairs with a similarity of 0.8 or more."""
    sets = defaultdict(list)
    for i, t in rows:
        sets[shingle_set(t)].append(i)
    todo, out, at = list(sets), [], defaultdict(set)
    for s in todo:
        for x in s:
            at[x].add(s)
    left = set(todo)
    while left:
        queue = [left.pop()]
        own = list(queue)
        while queue:
            s = queue.pop()
            common = Counter(t for x in s for t in at[x] if t in left)
            near = {t for t, n in common.items() if 5 * n >= 4 * (len(s) + len(t) - n)}
            left -= near
            own += near
            queue += near
        out.append(min(i for s in own for i in sets[s]))
    return sorted(out)


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def test_edited_copies_go_and_others_stay(spark):
    rng, rows = random.Random(3), []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 400))]
        rows += [" ".join(base)] + [edited(rng, base, n) for n in (1, 2, 3, 5, 8)]
    base = [f"v{i}" for i in range(300)]
    rows += [edited(rng, base, 3) for _ in range(150)]  # a large group
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = least_of_groups(rows)
    assert sorted(r.doc_id for r in got) == want
    assert 60 < len(want) < len(rows) / 2


def test_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{cases.SF.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = pipeline.simhash_near_dedup(spark, docs, cases.SF)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == least_of_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_limit_is_exact():
    assert nearsets.similar(8, 9, 9) and not nearsets.similar(79, 90, 89) and nearsets.similar(0, 0, 0)


def test_common_counts_match_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30_000, n).astype("<u8")) for n in (0, 1, 5, 200, 20_000, 25_000, 3)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[2:]] for a in sets]
    assert nearsets.common(sets, sets[2:]).tolist() == want


def test_blocks_lose_no_link_and_make_no_row_for_a_pair(spark, monkeypatch):
    """F4, pipeline: a large group alike to about 0.8, in small blocks, by clusters and bucket by bucket; rows by blocks, not pairs."""
    rng, rows = random.Random(9), []
    base = [f"w{i}" for i in range(200)]
    rows += [edited(rng, base, rng.choice((2, 4, 6, 9))) for _ in range(200)]
    rows = list(enumerate(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = least_of_groups(rows)
    made, blocks = [], nearsets._blocks
    monkeypatch.setattr("rillstone.llm.nearsets._blocks", lambda *a: made.append(blocks(*a)) or made[-1])
    monkeypatch.setattr("rillstone.llm.nearsets.BLOCK", 40)
    for most in (64, 1):
        monkeypatch.setattr("rillstone.llm.nearsets.BLOCKS", most)
        assert sorted(r.doc_id for r in simhash.representatives(frame).collect()) == want
    assert 1 < len(want) < 200 and made[0].count() <= 200 * 10


def test_the_stage_goes_by_fingerprints_too(spark, monkeypatch):
    """without any bucket of MinHash, texts that differ within three bits of SimHash are found by covering LSH, and checked."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(50_000)}" for _ in range(6000)]
    rows = [(0, " ".join(base)), (1, edited(rng, base, 1)), (2, " ".join(f"v{i}" for i in range(300)))]
    assert 0 < (simhash.simhash(rows[0][1], 5) ^ simhash.simhash(rows[1][1], 5)).bit_count() <= 3
    whole = nearsets.with_sketch
    own = lambda docs, *a: whole(docs, *a).withColumn("buckets", F.array(F.xxhash64("digest")))
    monkeypatch.setattr("rillstone.llm.nearsets.with_sketch", own)
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
