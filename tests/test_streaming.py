"""Keyed result state, watched folders and polled snapshots."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.model import RESULTS
from tracelake.operators import verify
from tracelake.streaming import results as streams
from tracelake.streaming import state as S
from tracelake.streaming import watch as W


def _results(spark, rows):
    return spark.createDataFrame(rows, "measure_id string, case_key string, outcome string, verified_at string, source string, load_ord long").withColumn("verified_at", F.col("verified_at").cast("timestamp"))


def _set(df):
    return sorted(tuple(r) for r in df.select("measure_id", "case_key", "outcome", "verified_at", "source", "load_ord").collect())


def test_state_equals_the_batch_merge_through_compactions(spark, tmp_path):
    rng = random.Random(3)
    state = S.ResultState(spark, str(tmp_path / "s"), RESULTS, buckets=16, compact_every=3)
    all_rows = []
    for b in range(8):
        rows = [(f"M-{rng.randrange(12)}" + rng.choice(["", "~2"]), rng.choice([None, "", "c"]), rng.choice(["pass", "fail"]), f"2024-01-0{rng.randrange(1, 9)}" if rng.random() < 0.9 else None, rng.choice("xy"), len(all_rows) + k) for k in range(6)]
        all_rows += rows
        state.fold(_results(spark, rows), b)
        if b in (1, 2, 5):
            assert _set(state.read()) == _set(verify.latest(_results(spark, all_rows)))
            state.fold(_results(spark, rows), b)  # a batch that runs again
    want = verify.latest(_results(spark, all_rows))
    assert _set(state.read()) == _set(want)
    one = want.filter("measure_id = 'M-3'")
    assert _set(state.read(one.select("measure_id", "case_key"))) == _set(one)
    assert state._done("base") == [2, 5] and state._done("log") == [3, 4, 5, 6, 7]
    with pytest.raises(ValueError):
        S.ResultState(spark, str(tmp_path / "s"), RESULTS, buckets=32)


def test_a_small_batch_touches_few_files(spark, tmp_path):
    state = S.ResultState(spark, str(tmp_path / "s"), RESULTS, compact_every=100)
    many = spark.range(1_000_000).selectExpr("concat('M-', id) AS measure_id", "'' AS case_key", "'pass' AS outcome", "timestamp'2024-01-01' AS verified_at", "'s' AS source", "id AS load_ord")
    state.fold(many, 0)
    state.compact(0)
    before = state.files()
    state.fold(many.filter("id < 10").withColumn("outcome", F.lit("fail")).withColumn("verified_at", F.expr("timestamp'2024-02-01'")), 1)
    added = set(state.files()) - set(before)
    assert set(before) <= set(state.files()) and len(added) <= 10 and len(before) >= 1024
    assert 1 <= len(state.compact(1)) <= 10  # under 1 % of the buckets
    assert state.read(many.filter("id < 20").select("measure_id", "case_key")).groupBy("outcome").count().count() == 2


def test_upserts_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = lambda m, o, t, k: json.dumps({"measure_id": m, "case_key": "", "outcome": o, "verified_at": t, "source": "s", "load_ord": k}) + "\n"
    state = S.ResultState(spark, str(tmp_path / "state"), RESULTS, buckets=8, compact_every=2)
    for i, lines in enumerate(([row("A", "fail", "2024-01-02T00:00:00Z", 1), row("B", "pass", "2024-01-01T00:00:00Z", 2)], [row("A~1", "pass", "2024-01-01T00:00:00Z", 3), row("B", "fail", "2024-01-03T00:00:00Z", 4)])):
        (tmp_path / f"in/{i}.json").write_text("".join(lines))
        stream = spark.readStream.schema(RESULTS).json(str(tmp_path / "in"))
        S.upsert(stream, state, str(tmp_path / "offsets")).awaitTermination()
    assert {(r["measure_id"], r["outcome"]) for r in state.read().collect()} == {("A", "fail"), ("B", "fail")}


def test_watched_folders_reach_a_rebuild(spark, tmp_path):
    spec, res = tmp_path / "spec", tmp_path / "res"
    spec.mkdir(), res.mkdir()
    (spec / "a.md").write_text("# a")
    (res / "r.json").write_text("{}")
    folders = {"requirements": str(spec), "results": streams.watched_folders(str(res / "r.json"), False)[0]}
    seen = []

    def run():
        stream = W.watch(spark, folders, str(tmp_path / "state"))
        log = stream.writeStream.foreachBatch(lambda d, i: seen.append(sorted(tuple(r) for r in d.select("folder", F.element_at(F.split("path", "/"), -1), "op").collect()))).option("checkpointLocation", str(tmp_path / "log")).start()
        return log, streams.rebuild_on_change(stream, lambda s, i: s.range(1).select(F.lit(i).alias("batch")), "rebuilt", str(tmp_path / "ck"), "0 seconds")

    log, rebuilt = run()
    log.processAllAvailable(), rebuilt.processAllAvailable()
    assert seen == [[("requirements", "a.md", "add"), ("results", "r.json", "add")]] and spark.table("rebuilt").first()["batch"] == 0
    (spec / "a.md").write_text("# longer")
    (spec / "b.md").write_text("# b")
    (spec / "ignored.txt").write_text("x")
    (res / "r.json").unlink()
    log.processAllAvailable(), rebuilt.processAllAvailable()
    assert seen[1:] == [[("requirements", "a.md", "modify"), ("requirements", "b.md", "add"), ("results", "r.json", "delete")]] and spark.table("rebuilt").first()["batch"] == 1
    log.stop(), rebuilt.stop()
    (res / "r.json").write_text("{ }")
    (spec / "b.md").unlink()
    log, rebuilt = run()  # after a restart only what is new
    log.processAllAvailable(), rebuilt.processAllAvailable()
    log.stop(), rebuilt.stop()
    assert seen[2:] == [[("requirements", "b.md", "delete"), ("results", "r.json", "add")]]


def test_changes_of_polls_equal_the_batch_diffs(spark, tmp_path):
    rng = random.Random(7)
    snaps, now = [], {}
    for _ in range(5):
        for p in "abcdef":
            if rng.random() < 0.3:
                now.pop(p, None)
            elif rng.random() < 0.5:
                now[p] = now.get(p, 0) + 1 + rng.randrange(3)
        snaps.append(dict(now))
    want = []
    for old, new in zip([{}, *snaps], [*snaps]):
        frames = [spark.createDataFrame(list(x.items()), "path string, mtime long") for x in (old, new)]
        want += [tuple(r) for r in streams.snapshot_changes(*frames).collect()]
    (tmp_path / "in").mkdir()
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    stream = spark.readStream.schema("path string, mtime long, poll timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        W.changes(stream)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = W.changes(stream).writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
        for i, s in enumerate([*snaps, {}, {}, {}]):
            rows = [{"path": p, "mtime": m, "poll": f"2024-01-01T00:00:{i:02}Z"} for p, m in s.items()] + [{"path": "alive", "mtime": 1, "poll": f"2024-01-01T00:00:{i:02}Z"}]
            (tmp_path / f"in/{i}.json").write_text("\n".join(map(json.dumps, rows)) + "\n")
            q.processAllAvailable()
        got = [(r["path"], r["op"]) for r in spark.table("polled").collect() if r["path"] != "alive"]
        q.stop()
    finally:
        spark.conf.set(key, before)
    gone = [(p, "delete") for p in snaps[-1]]
    assert sorted(got) == sorted(want + gone)
