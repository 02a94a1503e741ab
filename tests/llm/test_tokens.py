import random
import tracemalloc
import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillstone.llm import packing, tokenfile
from rillstone.llm.tokens import PieceEncoder, encoder

from . import cases


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(plain, text, end):
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_encoder_gives_the_library_s_ids(plain):
    rng = random.Random(2)
    parts = [*" \n\t\r\x0b\x1c\x85　'stremvld.,!?#0129²Ⅷéß中文🙂_-aAbB", "<|endoftext|>", "'s", "'ll", " the", " word,", " ", " ", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    for text, got in zip(texts, encoder().encode(texts), strict=True):
        assert got.tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert encoder().encode([]) == []


def test_encoder_gives_the_library_s_ids_with_a_cache_that_overflows(plain):
    rng = random.Random(6)
    white = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u180e\u2000\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
    parts = [*white, *"'.!-<|>\x00\x7f5²éßжЖ中\u0301’“🙂ĠĊ", "'s", "'re", "endoftext", "<|endoftext|>", "word", "X", " ", " ", "\n"]
    small = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), 20)
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", " ", "\n", "x" * 500]
        rng.shuffle(texts)
        for text, got in zip(texts, small.encode(texts), strict=True):
            assert got.tolist() == plain.encode(text, add_special_tokens=False).ids, text
    small.encode([""])
    assert len(small.units.rows) <= 40


def test_encoder_keeps_words_and_not_what_stands_between_blanks():
    enc = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["".join(x) for x in combinations_with_replacement("abcdefgh", 3)]
    text = " ".join(f"{a}.\n{b}" for a in words for b in words)  # 14,400 chunks, 120 words
    enc.encode([" ".join(words)])
    tracemalloc.start()
    enc.encode([text])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 500_000


def test_packing_matches_brute_force(spark, plain):
    got = packing.pack(cases.edge(spark)).collect()
    want = []
    for d, text, *_ in cases.rows():
        ids = ids_of(plain, text, 0)
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    order = lambda x: (x[0] is None, x)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    del order
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 2048) + 2


def test_packed_ids_are_the_documents(spark, plain):
    docs = spark.createDataFrame([(1, "some words here " * 800), (2, "short")], "doc_id long, text string")
    for r in packing.pack(docs, with_ids=True).collect():
        text = docs.where(f"doc_id = {r.doc_id}").first().text
        assert r.ids == ids_of(plain, text, 0)[r.start : r.start + r.length].tolist()


def test_plan_uses_each_piece_once_and_is_near_the_bound():
    rng = np.random.default_rng(3)
    for n in (1, 7, 300, 20_000):
        lengths = np.clip(np.exp(rng.normal(6, 1.2, n)).astype(int), 1, 2048)
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        used = defaultdict(int)
        planned = packing.plan(counts)
        for own, m in planned:
            assert sum(own) <= 2048 and m > 0
            for x in own:
                used[x] += m
        assert used == counts
        large = int((lengths > 1024).sum())
        assert sum(m for _, m in planned) <= max(-(-int(lengths.sum()) // 2048), large) * 1.01 + 1
    assert packing.plan({1000: 2, 1048: 2, 2048: 3}) == [([2048], 3), ([1048, 1000], 2)]


def test_token_file_matches_brute_force(spark, plain):
    docs = cases.edge(spark)
    got = [tuple(r) for r in tokenfile.write_and_read(docs, shards=5).orderBy("start").collect()]
    rows = sorted(((d, t) for d, t, *_ in cases.rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want, start = [], 0
    for d, t in rows:
        ids = ids_of(plain, t, 2)
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert tokenfile.write_and_read(cases.empty(spark), shards=3).count() == 0


def test_lookup_by_key(spark, plain, tmp_path):
    docs = cases.edge(spark)
    manifest = tokenfile.write_shards(docs, f"file://{tmp_path}", 3).collect()
    shards = [tokenfile.Shard(r.path) for r in manifest]
    wanted = defaultdict(list)
    for d, t, *_ in cases.rows():
        wanted[d].append(ids_of(plain, t, 2).tolist())
    for d, texts in wanted.items():
        found = [x.tolist() for s in shards for x in s.lookup(d)]
        assert sorted(found) == sorted(texts)
    assert not any(s.lookup(987654321) for s in shards)
    broken = tmp_path / "broken.ids"
    broken.write_bytes(open(manifest[0].path.removeprefix("file://"), "rb").read()[:-3])
    with pytest.raises(ValueError):
        tokenfile.Shard(f"file://{broken}")


def test_lookup_in_the_corpus_reads_one_shard_and_little_of_it(spark, plain, tmp_path, monkeypatch):
    docs = spark.range(0, 6000, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    manifest = tokenfile.write_shards(docs, f"file://{tmp_path}", 8)
    opened = []
    init = tokenfile.Shard.__init__
    monkeypatch.setattr(tokenfile.Shard, "__init__", lambda self, path: (init(self, path), opened.append(self))[0])
    for key in (0, 2997, 5997):
        opened.clear()
        (found,) = tokenfile.lookup(manifest, key)
        assert found.tolist() == ids_of(plain, f"text of {key}", 2).tolist()
        assert len(opened) == 1 and opened[0].bytes_read < 2500
    opened.clear()
    assert tokenfile.lookup(manifest, 1) == [] and tokenfile.lookup(manifest, None) == [] and tokenfile.lookup(manifest, 10**9) == []
    assert len(opened) <= 1


def test_shards_are_read_by_many_tasks(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    found = tokenfile.write_and_read(docs, shards=8)
    assert found.select(F.spark_partition_id()).distinct().count() >= 6


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 30_000))
    made = tokenfile.PerfectHash.build(keys)
    assert sorted(made.find(keys).tolist()) == list(range(len(keys)))
    assert (made.find(np.arange(5000)) >= 0).sum() <= 1
    assert len(made.sizes) < 40


def test_index_of_sums_follows_the_counts():
    rng = np.random.default_rng(3)
    for _ in range(40):
        capacity = int(rng.integers(3, 30))
        counts = np.where(rng.random(capacity + 1) < 0.4, rng.integers(0, 5, capacity + 1), 0)
        counts[0] = 0
        index = packing.Sums(counts)
        for _ in range(15):
            index.set(int(rng.integers(1, capacity + 1)), int(rng.integers(0, 5)))
        found = {1: [0] * (capacity + 1), 2: [0] * (capacity + 1), 3: [0] * (capacity + 1)}
        for k, sums in found.items():
            for x in combinations_with_replacement(range(1, capacity + 1), k):
                if sum(x) <= capacity and all(index.count[y] >= x.count(y) for y in x):
                    sums[sum(x)] += 1
        assert index.pairs.tolist() == found[2] and index.triples.tolist() == found[3]
        for total in range(1, capacity + 1):
            got = index.exact(total)
            fewest = next((k for k in (1, 2, 3) if found[k][total]), None)
            assert (got and len(got)) == fewest
            assert got is None or (sum(got) == total and all(index.count[y] >= got.count(y) for y in got))
