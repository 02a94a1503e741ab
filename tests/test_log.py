import json
import random
import shutil
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rillstone import stat
from rillstone.sources.log import Batch, Log, Options
from rillstone.sources.manifest import CorruptSegmentError, LogError, Manifest, NotCommittedError, UnknownBatchError
from rillstone.streaming.log_stream import register

BATCHES = [[b"one", b"", b"\xff\x00\xfe"], [], [b"x" * 500], [b"b", b"a", b"b"]]


def replay(log, start=1):
    found = []
    log.for_each(start, lambda b: found.append((b.seq, list(b.records))))
    return found


@pytest.fixture
def log(spark, tmp_path):
    return Log.open(spark, str(tmp_path / "log"), Options(64, sync=True))


def test_append_commit_read_and_replay(log):
    assert [log.commit(log.append(b)) for b in BATCHES] == [1, 2, 3, 4]
    assert [log.records(i) for i in (1, 2, 3, 4)] == BATCHES
    assert replay(log) == list(enumerate(BATCHES, 1))
    assert replay(log, 3) == list(enumerate(BATCHES, 1))[2:]
    assert replay(log, 9) == []
    assert [(r.seq, r.ord, bytes(r.record)) for r in log.scan(3).collect()] == [(3, 0, b"x" * 500), (4, 0, b"b"), (4, 1, b"a"), (4, 2, b"b")]
    assert [tuple(r) for r in log.batches().orderBy("seq").select("seq", "n_records", "n_bytes").collect()] == [(1, 3, 6), (2, 0, 0), (3, 1, 500), (4, 3, 3)]


def test_errors(log, spark, tmp_path):
    with pytest.raises(NotCommittedError):
        log.read(1)
    with pytest.raises(TypeError):
        log.append([b"a", None])
    with pytest.raises(ValueError):
        Options(0)
    batch = log.append([b"a"])
    log.commit(batch)
    with pytest.raises(UnknownBatchError):
        log.commit(batch)
    other = Log.open(spark, str(tmp_path / "other"), Options(64))
    with pytest.raises(UnknownBatchError):
        other.commit(log.append([b"a"]))
    with pytest.raises(UnknownBatchError):
        log.commit(Batch(log.log_id, "elsewhere", 0, 0, 0))


def test_staged_batches_are_hidden_and_end_with_the_handle(log, spark):
    kept, dropped = log.append([b"kept"]), log.append([b"dropped"])
    assert replay(log) == []
    log.commit(kept)
    again = Log.open(spark, str(log.folder), Options(64))
    with pytest.raises(UnknownBatchError):
        again.commit(dropped)
    assert replay(again) == [(1, [b"kept"])]
    assert again.commit(again.append([b"next"])) == 2


def test_sequences_follow_commits_and_a_second_writer_fails(log, spark):
    first, second = log.append([b"first"]), log.append([b"second"])
    assert (log.commit(second), log.commit(first)) == (1, 2)
    assert replay(log) == [(1, [b"second"]), (2, [b"first"])]
    entry = log.manifest.entry(2)
    with pytest.raises(FileExistsError):
        log.manifest.publish(entry, False)


def test_failed_publication_leaves_the_replay_as_it_was(log, monkeypatch):
    log.commit(log.append([b"a"]))
    batch = log.append([b"b"])
    with monkeypatch.context() as m:
        m.setattr("os.link", lambda *a: (_ for _ in ()).throw(OSError("no space")))
        with pytest.raises(OSError):
            log.commit(batch)
    assert replay(log) == [(1, [b"a"])]
    assert log.commit(batch) == 2


def test_segments_roll_before_a_batch_that_exceeds_them(log):
    for n in (30, 30, 10, 100, 0, 64, 1):
        log.commit(log.append([b"x" * n]))
    assert [(s.segment_id, s.first_seq, s.last_seq) for s in log.segments()] == [(0, 1, 2), (1, 3, 3), (2, 4, 4), (3, 5, 6), (4, 7, 7)]
    assert log.stat() == {"segments": 5, "batches": 7, "first_seq": 1, "last_seq": 7}


def test_stat_command(log, capsys):
    log.commit(log.append([b"a"]))
    stat.main(["--dir", str(log.folder), "stat"])
    assert json.loads(capsys.readouterr().out) == {"segments": 1, "batches": 1, "first_seq": 1, "last_seq": 1}
    with pytest.raises(SystemExit):
        stat.main(["--dir", str(log.folder / "none"), "stat"])


@pytest.mark.parametrize("how", ["gone", "cut", "other"])
def test_corrupt_data_is_refused(log, spark, how):
    log.commit(log.append([b"good", b"data"]))
    log.commit(log.append([b"more"]))
    folder = log.folder / log.manifest.entry(2).path
    file = next(folder.glob("*.parquet"))
    if how == "gone":
        shutil.rmtree(folder)
    elif how == "cut":
        file.write_bytes(file.read_bytes()[:-20])
        (folder / f".{file.name}.crc").unlink(missing_ok=True)
    else:
        spark.createDataFrame([(0, bytearray(b"mere"))], "ord int, record binary").coalesce(1).write.mode("overwrite").parquet(str(folder))
    with pytest.raises(CorruptSegmentError):
        log.read(2)
    with pytest.raises(CorruptSegmentError):
        log.for_each(1, lambda b: None)
    assert log.records(1) == [b"good", b"data"]


def test_a_gap_in_the_manifest_is_refused(log):
    for _ in range(3):
        log.commit(log.append([b"a"]))
    (log.folder / "_commits" / f"{2:020d}.json").unlink()
    with pytest.raises(CorruptSegmentError):
        log.scan()


def test_callback_errors_end_the_scan(log):
    for _ in range(3):
        log.commit(log.append([b"a"]))
    seen = []

    def fail(batch):
        seen.append(batch.seq)
        if batch.seq == 2:
            raise KeyError("stop")

    with pytest.raises(KeyError):
        log.for_each(1, fail)
    assert seen == [1, 2]


def test_random_histories_match_a_list(spark, tmp_path):
    rng = random.Random(7)
    log, want, staged = Log.open(spark, str(tmp_path / "log"), Options(100)), [], []
    for _ in range(25):
        what = rng.random()
        if what < 0.5:
            records = [rng.randbytes(rng.randint(0, 30)) for _ in range(rng.randint(0, 4))]
            staged.append((log.append(records), records))
        elif what < 0.85 and staged:
            batch, records = staged.pop(rng.randrange(len(staged)))
            want.append(records)
            assert log.commit(batch) == len(want)
        elif what >= 0.85:
            log, staged = Log.open(spark, str(tmp_path / "log"), Options(100)), []
    assert replay(log) == list(enumerate(want, 1))


def test_append_all_stages_a_batch_for_each_value(log, spark):
    rows = [(b, o, bytearray(b"%d-%d" % (b, o))) for b in (7, 3) for o in (1, 0)]
    staged = log.append_all(spark.createDataFrame(rows, "batch long, ord int, record binary"))
    log.commit_all(staged[b] for b in sorted(staged))
    assert replay(log) == [(1, [b"3-0", b"3-1"]), (2, [b"7-0", b"7-1"])]
    assert log.append_all(spark.createDataFrame([], "batch long, ord int, record binary")) == {}
    with pytest.raises(ValueError):
        log.append_all(spark.createDataFrame([(1, 0, None)], "batch long, ord int, record binary"))


def test_stream_goes_on_where_it_stopped(log, spark, tmp_path):
    register(spark)

    def run():
        stream = spark.readStream.format("batch_log").option("path", str(log.folder)).load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted((r.seq, r.ord, bytes(r.record)) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for b in BATCHES[:2]:
        log.commit(log.append(b))
    log.append([b"staged"])
    assert run() == [(1, i, r) for i, r in enumerate(BATCHES[0])]
    for b in BATCHES[2:]:
        log.commit(log.append(b))
    assert run() == [(s, i, r) for s, b in enumerate(BATCHES, 1) for i, r in enumerate(b)]
    found = spark.read.format("batch_log").option("path", str(log.folder)).option("start", 3).load()
    assert found.count() == 4


def test_many_commits_at_once_are_one_publication(log, spark):
    staged = [log.append([b"%d" % i]) for i in range(3)]
    with pytest.raises(UnknownBatchError):
        log.commit_all([staged[0], staged[0]])
    assert log.commit_all(staged) == [1, 2, 3] and log.commit_all([]) == []
    assert len(list((log.folder / "_commits").iterdir())) == 1
    assert log.manifest.entry(2).seq == 2 and log.records(3) == [b"2"]
    assert replay(Log.open(spark, str(log.folder), Options(64)), 2) == [(2, [b"1"]), (3, [b"2"])]


def test_a_second_writer_is_refused_after_a_group(log, spark):
    other = Log.open(spark, str(log.folder), Options(64))
    late = other.append([b"late"])
    log.commit_all([log.append([b"a"]), log.append([b"b"])])
    with pytest.raises(LogError):
        other.commit(late)
    assert replay(log) == [(1, [b"a"]), (2, [b"b"])]


def test_a_commit_does_not_list_the_manifest(log, monkeypatch):
    log.commit(log.append([b"a"]))
    batch = log.append([b"b"])
    monkeypatch.setattr("os.listdir", lambda *a: pytest.fail("listed"))
    assert log.commit(batch) == 2
    assert log.manifest.entry(1).seq == 1


def test_stream_refuses_data_of_equal_length(log, spark, tmp_path):
    register(spark)
    batch = log.append([b"good"])
    log.commit(batch)
    spark.createDataFrame([(1, 0, bytearray(b"evil"))], "batch long, ord int, record binary").write.mode("overwrite").parquet(batch.path)
    with pytest.raises(Exception, match="differs"):
        spark.read.format("batch_log").option("path", str(log.folder)).load().collect()


def test_only_local_file_systems_hold_a_log(spark):
    with pytest.raises(LogError):
        Log.open(spark, "hdfs://host/dir", Options(64))


def test_manifest_rejects_sequences_beyond_bigint(tmp_path):
    log = Manifest(Path(tmp_path))
    with pytest.raises(LogError):
        log.publish(type("E", (), {"seq": 1 << 63})(), False)


def group_rows(spark, batches):
    return spark.createDataFrame([(b, o, bytearray(r)) for b, records in batches.items() for o, r in enumerate(records)], "batch long, ord int, record binary")


def test_groups_are_numbered_and_rolled_as_single_commits(spark, tmp_path, monkeypatch):
    """Many small chunks, sizes of zero and beyond the limit, single commits before, between and after, for several seeds."""
    monkeypatch.setattr("rillstone.sources.log.CHUNK_BATCHES", 5)
    for seed in range(3):
        rng = random.Random(seed)
        group, single = (Log.open(spark, str(tmp_path / f"{seed}-{x}"), Options(40)) for x in "gs")
        sizes = [rng.choice([0, 0, 1, 5, 20, 39, 40, 41, 90]) for _ in range(60)]
        batches = {3 * i: [b"x" * n] for i, n in enumerate(sizes)}
        for log in (group, single):
            log.commit(log.append([b"y" * 30]))
        staged = single.append_all(group_rows(spark, batches))
        even = [b for b in sorted(staged) if b % 2 == 0]
        single.commit_all(staged[b] for b in even)
        single.commit(single.append([b"z" * 15]))
        single.commit_all(staged[b] for b in sorted(staged) if b % 2)
        own = group.stage(group_rows(spark, batches))
        assert group.commit_group(own, F.col("batch") % 2 == 0) == (2, 31)
        assert group.scan().count() == 31  # the others stay staged
        group.commit(group.append([b"z" * 15]))
        assert group.commit_group(own) == (33, 62)
        with pytest.raises(UnknownBatchError):
            group.commit_group(own)
        facts = lambda log: [(e.seq, e.segment_id, e.n_records, e.n_bytes, e.checksum, e.segment_bytes, e.segment_first) for e in log.manifest.entries()]
        assert facts(group) == facts(single)
        assert group.segments() == single.segments() and group.stat() == single.stat() and replay(group) == replay(single)
        assert sorted(map(tuple, group.segments_frame().collect())) == sorted(map(tuple, single.segments_frame().collect()))
        assert group.records(17) == single.records(17) and group.manifest.entry(17).seq == 17
        with pytest.raises(NotCommittedError):
            group.read(63)


def test_a_group_keeps_no_entry_on_the_driver(log, spark, monkeypatch):
    """F1-F3, F5-F9: publication and scan of a group need neither handles nor entries of its batches; the rows are not broadcast."""
    staged = log.stage(group_rows(spark, {b: [b"%d" % b] * 3 for b in range(50)}))
    monkeypatch.setattr("rillstone.sources.log.Log.append_all", lambda *a: pytest.fail("handles"))
    monkeypatch.setattr("rillstone.sources.manifest.Manifest.entries", lambda *a: pytest.fail("entries"))
    monkeypatch.setattr("rillstone.sources.log.BROADCAST_ENTRIES", 10)
    assert log.commit_group(staged) == (1, 50)
    found = log.scan(4)
    assert found.count() == 47 * 3
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert log.stat()["batches"] == 50


def test_commit_all_asks_once_whether_a_batch_comes_twice(log, spark):
    """F5-F9: the check took the square of the number of batches."""
    n = 20_000
    staged = log.append_all(spark.range(n).selectExpr("id AS batch", "0 AS ord", "encode('a', 'utf-8') AS record"))
    began = time.time()
    assert log.commit_all(staged[b] for b in sorted(staged))[-1] == n
    assert time.time() - began < 20


@pytest.mark.parametrize("how", ["changed", "gone", "entries"])
def test_a_corrupt_group_is_refused(log, spark, how):
    register(spark)
    log.commit_group(log.stage(group_rows(spark, {1: [b"good"], 2: [b"more"]})))
    e = log.manifest.entry(2)
    if how == "entries":
        shutil.rmtree(next((log.folder / "entries").glob("*/chunk=0")))
    else:
        rows = {1: [b"good"]} | ({2: [b"mere"]} if how == "changed" else {})
        group_rows(spark, rows).write.mode("overwrite").parquet(str(log.folder / e.path))
    for call in (lambda: log.read(2), lambda: log.for_each(1, lambda b: None)):
        with pytest.raises(CorruptSegmentError):
            call()
    with pytest.raises(Exception, match="differs|can't be read"):
        spark.read.format("batch_log").option("path", str(log.folder)).load().collect()
    if how != "entries":
        assert log.records(1) == [b"good"]


def test_stream_reads_groups_and_single_commits(log, spark, monkeypatch):
    register(spark)
    monkeypatch.setattr("rillstone.sources.log.CHUNK_BATCHES", 3)
    log.commit(log.append([b"one"]))
    log.commit_group(log.stage(group_rows(spark, {b: [b"%d" % b, b""] for b in range(20)})), F.col("batch") % 3 == 0)
    log.commit(log.append([b"last"]))
    got = sorted((r.seq, r.ord, bytes(r.record)) for r in spark.read.format("batch_log").option("path", str(log.folder)).option("start", 3).load().collect())
    assert got == [(r.seq, r.ord, bytes(r.record)) for r in log.scan(3).collect()] and len(got) == 13
