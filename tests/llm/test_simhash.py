import re
from collections import Counter, defaultdict
from itertools import combinations

import xxhash

from rillstone.llm import simhash
from rillstone.llm.components import connected_components

from . import cases


def brute_fingerprint(text, words):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    left, out = set(values), {}
    while left:
        todo = [left.pop()]
        own = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            own |= near
            todo += near
        out |= dict.fromkeys(own, min(own))
    return out


def test_documents_match_brute_force(spark):
    for words in (3, 5):
        got = Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(cases.edge(spark), words).collect())
        own = [(r[0], brute_fingerprint(r[1], words)) for r in cases.rows()]
        group = brute_components({f for _, f in own})
        least = defaultdict(list)
        for d, f in own:
            least[group[f]] += [d] if d is not None else []
        assert got == Counter((d, f, min(least[group[f]], default=None)) for d, f in own)


def test_every_pair_within_the_radius_collides():
    masks = simhash.covering_masks(tuple(range(64)))
    assert len(masks) == 15
    for positions in combinations(range(0, 64, 3), 3):
        differing = sum(1 << p for p in positions)
        assert any(m & differing == 0 for m in masks)
    assert min(m.bit_count() for m in masks) >= 32


def test_large_buckets_lose_no_link(spark):
    import random

    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(2)]
    values = set(centres)
    for c in centres:  # many values within few bits, so that buckets must be split
        for _ in range(900):
            values.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fp long")
    for bucket in (256, 10_000):
        edges = simhash.links(frame, bucket)
        roots = {r.node % (1 << 64): r.root for r in connected_components(edges).collect()}
        want = brute_components(values)
        got = defaultdict(set)
        for v in values:
            got[roots.get(v, v)].add(v)
        expected = defaultdict(set)
        for v in values:
            expected[want[v]].add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_components_of_paths_and_repeated_edges(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (5, 4), (200, 300), (300, 200)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots == {i: 0 for i in range(41)} | {200: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_row_of_a_component_stays(spark):
    kept = simhash.representatives(cases.edge(spark))
    assert set(kept.columns) == set(cases.edge(spark).columns)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(0) == 1 and 401 not in ids
    assert {301, 303, 305} & set(ids) == {301}  # texts without words are alike


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


def test_few_edges_need_no_round_and_give_the_same(spark, monkeypatch):
    """pipeline on check_h: the rounds' many small files took its disk."""
    import random

    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(420)], "u long, v long")
    found = {}
    for few in (100_000, 0):
        monkeypatch.setattr("rillstone.llm.components.FEW", few)
        found[few] = connected_components(edges).collect()
    assert sorted(found[0]) == sorted(found[100_000])
    monkeypatch.setattr("rillstone.llm.components.FEW", 100_000)
    monkeypatch.setattr("rillstone.llm.components._state", lambda e: 1 / 0)
    connected_components(edges)


def test_links_take_no_python_workers_for_their_masks(spark, monkeypatch):
    """A table from a list of rows goes through an RDD in Python workers that the other steps do not use."""
    frame = spark.range(6).selectExpr("shiftleft(1L, CAST(id AS INT)) - 1 AS fp")

    def refused(*_, **__):
        raise AssertionError("parallelize was called")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    roots = connected_components(simhash.links(frame)).collect()
    assert len(roots) == 6 and {r.root for r in roots} == {0}
