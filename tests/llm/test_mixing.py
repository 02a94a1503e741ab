"""The mixture's schedule against exact shares and a slot-by-slot simulation."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from rillstone.llm import mixing

from . import cases


def by_simulation(blocks, weights):
    """Earliest deadline first, slot by slot, over all blocks of a phase."""
    left, order = list(blocks), []
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        active = [i for i in active if weights[i] > 0] or active
        parts = dict(zip(active, [Fraction(weights[i]) if weights[i] > 0 else Fraction(1) for i in active], strict=True))
        total, had, slot = sum(parts.values()), Counter(), 0
        while all(left[i] for i in active):
            free = [(-(-(had[i] + 1) * total // parts[i]), i) for i in active if had[i] * total // parts[i] <= slot]
            i = min(free, key=lambda x: (x[0], -parts[x[1]], x[1]))[1]
            had[i], left[i], slot = had[i] + 1, left[i] - 1, slot + 1
            order.append(i)
    return order


@pytest.mark.parametrize("n", [1, 2, 3, 5, 30])
def test_schedule_matches_a_simulation(n):
    rng = random.Random(n)
    for _ in range(5):
        weights = [rng.choice([rng.random(), 1.0, 0.01, 0.0]) for _ in range(n)]
        blocks = [rng.randint(0, 40) for _ in range(n)]
        assert mixing.schedule(blocks, weights).tolist() == by_simulation(blocks, weights)


def skewed(n, top):
    return [top] + [(1 - top) / (n - 1)] * (n - 1)


@pytest.mark.parametrize("weights", [[1.0], [3, 1], [0.7, 0.1, 0.1, 0.05, 0.05], [1 / k for k in range(1, 30)], [(1 / 3) ** 0.7] + [(1 / 30) ** 0.7] * 20, [1.0, 1e-5, 1e-3], skewed(500, 0.9), skewed(1000, 0.9), skewed(1000, 0.3)])
def test_deviation_from_the_given_weights_is_less_than_one_block(weights):
    total = sum(map(Fraction, weights))
    shares = [Fraction(w) / total for w in weights]
    blocks = [int(20_000 * s) + 2 for s in shares]
    order = mixing.schedule(blocks, weights)
    assert Counter(order.tolist()) == Counter({i: n for i, n in enumerate(blocks)})
    had, left = [0] * len(weights), list(blocks)
    size, check = 1 << 80, range(0, len(order), 1 + len(weights) // 30)
    scaled = [int(s * size) for s in shares]
    for slot, i in enumerate(order.tolist(), 1):
        had[i] += 1
        left[i] -= 1
        if slot in check:
            assert all(abs(n * size - slot * s) < size + slot for n, s in zip(had, scaled, strict=True))
        if not left[i]:
            break
    assert slot > 1000


def test_mixture_holds_all_documents_by_the_schedule(spark):
    sizes, weights = {"a": 403, "b": 95, "c": 31}, {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = [(i * 10 + j, s) for j, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = sorted((r.place, r.slot, r.source, r.doc_id) for r in mixing.mix(docs, weights, block=4).collect())
    assert [g[0] for g in got] == list(range(len(rows)))
    assert Counter(g[3] for g in got) == Counter(d for d, _ in rows)
    slots = defaultdict(set)
    for _, slot, source, _ in got:
        slots[slot].add(source)
    assert all(len(s) == 1 for s in slots.values()) and sorted(slots) == list(range(len(slots)))
    order = ["abc"[i] for i in by_simulation([-(-n // 4) for n in sizes.values()], list(weights.values()))]
    assert [next(iter(slots[i])) for i in range(len(slots))] == order


def test_blocks_grow_rather_than_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 20)
    docs = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(900)], "doc_id long, source string")
    got = mixing.mix(docs, {"a": 0.5, "b": 0.5}).orderBy("place").collect()
    assert [r.place for r in got] == list(range(900)) and got[-1].slot < 22
    assert abs(sum(r.source == "a" for r in got[:450]) - 225) <= 45


def test_edge_cases(spark):
    docs = cases.edge(spark)
    got = mixing.mix(docs, text="text", block=3)
    assert sorted(r.place for r in got.collect()) == list(range(docs.count()))
    assert set(docs.columns) <= set(got.columns)
    assert Counter(r.source for r in got.collect()) == Counter(r.source for r in docs.collect())
    assert mixing.mix(cases.empty(spark)).count() == 0
    last = mixing.mix(docs, {"a": 0.0, "b": 1.0, None: 1.0, "c": 1.0}, block=1).orderBy("place").collect()
    assert {r.source for r in last[-5:]} == {"a"}
