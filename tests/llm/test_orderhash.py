import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from rillstone.llm import orderhash
from rillstone.llm.orderhash import BINS, CUT, TUPLE, K

from . import cases

MASK = (1 << 64) - 1


def of_long(x, seed=42):
    return xxhash.xxh64_intdigest((x & MASK).to_bytes(8, "little"), seed)


def of_int(x, seed):
    return xxhash.xxh64_intdigest(x.to_bytes(4, "little"), seed)


def chain(values):
    seed = 42
    for v in values:
        seed = of_long(v, seed)
    return seed


def brute(text):
    """Bin -> tuple hash, from the definition."""
    cut = re.sub(r"([^\x20\x09-\x0D]{%d})(?=[^\x20\x09-\x0D])" % CUT, r"\1 ", text)
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", cut)]
    if not h:
        return {}
    kmers = [chain(h[i : i + K]) for i in range(len(h) - K + 1)] if len(h) > K else [chain(h)]
    seen, circle = {}, []
    for at, x in enumerate(kmers):
        low = x & ((1 << 40) - 1)
        occurrence = seen.get(low, 0)
        seen[low] = occurrence + 1
        point = of_int(occurrence, of_long(low)) & ((1 << 40) - 1)
        circle.append((point - (1 << 40) if point >> 39 else point, at))
    circle.sort()
    out = {}
    for b in range(BINS):
        start = (b - BINS // 2) << 34
        first = next((i for i, (p, _) in enumerate(circle) if p >= start), 0)
        places = sorted(circle[(first + j) % len(circle)][1] for j in range(min(TUPLE, len(circle))))
        out[b] = chain(kmers[p] for p in places) & 0xFFFFFFFF
    return out


def test_fingerprints_match_brute_force(spark):
    got = orderhash.fingerprints(cases.edge(spark).select("doc_id", "text")).collect()
    for r in got:
        assert {x >> 32 & 0x3F: x & 0xFFFFFFFF for x in r.fingerprint} == brute(r.text or ""), r.doc_id


def test_query_matches_brute_force(spark, tmp_path):
    cases.edge(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = orderhash.op1_order_minhash(spark, str(tmp_path)).collect()
    h = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(t.encode(), 42))
    rows = sorted(((d if d is not None else -(1 << 63), h(t or ""), d, t or "") for d, t, *_ in cases.rows()))
    texts = [r[3] for r in rows]

    def like(a, b):
        a, b = brute(a), brute(b)
        either = a.keys() | b.keys()
        return sum(a.get(k) == b.get(k) for k in either) / len(either) if either else 1.0

    want = []
    for i, (_, _, d, t) in enumerate(rows):
        after, moved = texts[(i + 1) % len(texts)], len(t) // 4
        edited = t[: len(t) - moved] + after[:moved]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(t, edited), 9), round(like(t, after), 9)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))) for r in got)


@pytest.mark.parametrize("ranges", [2, 7, 2000])
def test_next_document_for_any_number_of_ranges(spark, ranges):
    ids = [5, -7, 1 << 60, 12, 13, 14, 99, 4000, None]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next for r in orderhash.with_next(docs, "text", ranges=ranges).select("doc_id", F.col("_next.text").alias("next")).collect()}
    order = sorted(ids, key=lambda x: (x is not None, x or 0))
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_order_counts(spark):
    words = [f"w{i}" for i in range(600)]
    turned = words[300:] + words[:300]
    frame = spark.createDataFrame([(1, " ".join(words), " ".join(turned)), (2, " ".join(words), " ".join(words[:299] + ["new"] + words[300:]))], "i int, a string, b string")
    got = dict(frame.select("i", orderhash.likeness(orderhash.fingerprint(F.col("a")), orderhash.fingerprint(F.col("b")))).collect())
    assert got[1] < 0.75 < 0.9 < got[2]  # the same k-mers but one, in another order


@pytest.mark.parametrize("n", [20, 60, 126, 127, 250, 510, 1000, 1498, 2046, 4000])
def test_likeness_is_continuous_in_length(spark, n):
    """A word more changes a text's fingerprint by no more than the few tuples it is in, at any length."""
    text = " ".join(f"w{i * i % 9973}" for i in range(n))[: n]
    frame = spark.createDataFrame([(text, text + " more", text[:-1])], "a string, b string, c string")
    of = lambda x: orderhash.fingerprint(F.col(x))
    got = frame.select(orderhash.likeness(of("a"), of("b")), orderhash.likeness(of("a"), of("c"))).first()
    assert min(got) >= max(0.9 - 20 / n, 0.3) if n < 250 else min(got) >= 0.9


def test_long_texts_are_handled_by_the_same_rule(spark, monkeypatch):
    docs = cases.edge(spark).select("doc_id", "text")
    want = sorted(map(str, orderhash.fingerprints(docs).collect()))
    monkeypatch.setattr(orderhash, "PLACES", 10)
    assert sorted(map(str, orderhash.fingerprints(docs).collect())) == want


def test_single_document_and_empty_table(spark, tmp_path):
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    assert orderhash.with_next(one, "text").first()["_next"].text == "a b c d e f g h"
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert orderhash.op1_order_minhash(spark, str(tmp_path)).count() == 0
