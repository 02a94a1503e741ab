import hashlib
from collections import Counter

import numpy as np
import pytest

from rillstone.llm import suffix

from . import cases


def brute(rows, length=400):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    count = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False]))))
        out.append((d, len(b), edge.tolist(), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize(("broadcast", "group"), [(suffix.BROADCAST, suffix.GROUP), (0, suffix.GROUP), (suffix.BROADCAST, 2), (0, 2)])
def test_spans_match_brute_force(spark, broadcast, group):
    rows = [r for r in cases.rows() if r[0] not in (201, 203)]
    docs = cases.edge(spark).where("doc_id IS NULL OR doc_id NOT IN (201, 203)")
    got = suffix.dedup(docs, broadcast=broadcast, group=group).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.spans or [], hashlib.sha256(r.kept).hexdigest())) for r in got) == brute(rows)


def test_long_texts(spark):
    got = {r.doc_id: r for r in suffix.dedup(cases.edge(spark)).collect()}
    assert got[201].n_bytes > 60_000 and len(got[201].kept) < 30_000


def test_empty_table(spark):
    assert suffix.dedup(cases.empty(spark)).count() == 0


def test_shared_prefixes_match_brute_force():
    rng = np.random.default_rng(4)
    for trial in range(30):
        parts = [rng.integers(97, 97 + 1 + trial % 3, rng.integers(1, 90)).astype(np.uint8).tobytes() for _ in range(12)]
        parts += [parts[0][:40] + p for p in parts[:4]] + parts[:2] + [parts[0] * 3, parts[0] * 3 + b"z", b""]
        data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        begins = ends - [len(p) for p in parts]
        groups = rng.integers(0, 2, len(parts))
        got = suffix.shared_prefixes(data, groups, begins, ends)
        for i, a in enumerate(parts):
            best = 0
            for j, b in enumerate(parts):
                if i != j and groups[i] == groups[j]:
                    n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                    best = max(best, n)
            assert got[i] == best, (trial, i)


def test_anchors_are_the_same_in_any_surrounding():
    rng = np.random.default_rng(9)
    inner = rng.integers(0, 256, 1500).astype(np.uint8).tobytes()
    a, b = rng.bytes(777) + inner + rng.bytes(300), rng.bytes(31) + inner
    of = lambda t, at: {(s - at, p - at) for p, _, f, last in zip(*suffix.anchors(t), strict=True) for s in range(f, last + 1) if at <= s <= at + len(inner) - 400}
    assert of(a, 777) == of(b, 31)
