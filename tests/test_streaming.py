import json
import os

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.plans.storage import materialize, shared_dir
from skein.streaming import events

LOG = [
    (1, "2024-01-01 00:00:01", "add", "a/x", "1"), (2, "2024-01-01 00:00:02", "modify", "a/x", "2"), (3, "2024-01-01 00:00:03", "add", "b", "3"), (4, "2024-01-01 00:00:04", "read", "b", None),
    (5, "2024-01-01 00:00:05", "rmdir", "a", None), (6, "2024-01-01 00:00:06", "add", "a/y", "4"), (7, "2024-01-01 00:00:06", "remove", "b", None), (8, "2024-01-01 00:00:07", "add", "b", "5"),
]


def put(folder, k, text):
    """Files are read in the order of their times."""
    (folder / f"{k}.json").write_text(text)
    os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))


def test_replay_equals_batch(spark, tmp_path):
    schema = "seq long, ts string, op string, path string, content string"
    whole = spark.createDataFrame(LOG, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    base = spark.createDataFrame([("a/old", "0"), ("c", "c")], "path string, content string")
    want = {r["path"]: r["content"] for r in events.apply_events(base, whole).collect()}
    assert want == {"a/y": "4", "b": "5", "c": "c"}
    source, tables = tmp_path / "in", tmp_path / "t"
    source.mkdir()
    for k in range(0, len(LOG), 2):
        put(source, k, "\n".join(json.dumps(dict(zip(("seq", "ts", "op", "path", "content"), r, strict=True))) for r in LOG[k : k + 2]))
    base.write.parquet(str(tables / "v-1"))
    newest = [str(tables / "v-1")]

    def save(df, number):
        newest.append(str(tables / f"v{number}"))
        df.write.mode("overwrite").parquet(newest[-1])

    q = events.maintain(events.event_stream(spark, str(source)), lambda: spark.read.parquet(newest[-1]), save, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["path"]: r["content"] for r in spark.read.parquet(newest[-1]).collect()} == want


@given(st.lists(st.integers(0, 5000), max_size=30), st.integers(1, 5))
def test_cooldown_in_batches(seconds, k):
    times = sorted(s * 1_000_000 for s in seconds)
    whole = events.cooldown_fold(times, None)
    parts, last = [], None
    for i in range(0, len(times), k):
        new = events.cooldown_fold(times[i : i + k], last)
        parts += new
        last = new[-1] if new else last
    assert parts == whole and all(b - a >= 300_000_000 for a, b in zip(whole, whole[1:], strict=False))


@given(st.lists(st.sampled_from("abc"), max_size=20), st.integers(0, 20))
def test_runs_in_batches(picks, cut):
    assert events.run_fold(picks[cut:], events.run_fold(picks[:cut], None)) == events.run_fold(picks, None)


def test_accepted_batch_is_the_fold(spark):
    rows = [("a", s * 1_000_000) for s in (0, 100, 299, 300, 650, 900)] + [("b", 5)]
    got = {r["path"]: r["accepted"] for r in events.accepted_batch(spark.createDataFrame(rows, "path string, us long")).collect()}
    assert got == {"a": len(events.cooldown_fold([u for p, u in rows if p == "a"], None)), "b": 1}


def test_state_over_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, s in enumerate((0, 200, 400)):
        put(source, k, json.dumps({"path": "p", "ts": f"2024-01-01 00:0{s // 60}:{s % 60:02d}"}))
    stream = spark.readStream.schema("path string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
    q = events.accepted_accesses(stream).writeStream.outputMode("update").format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("accepted").agg(F.max("accepted")).first()[0] == 2


def test_pick_runs_over_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, f in enumerate("xyy"):
        put(source, k, json.dumps({"project": "p", "query": "q", "file_path": f, "us": k, "seq": k}))
    stream = spark.readStream.schema("project string, query string, file_path string, us long, seq long").option("maxFilesPerTrigger", 2).json(str(source))
    q = events.pick_runs(stream).writeStream.outputMode("update").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert ("y", 2) in {(r["file_path"], r["open_count"]) for r in spark.table("runs").collect()}


def test_rescan_rules(spark):
    df = lambda ps: spark.createDataFrame([(p,) for p in ps], "path string")
    assert events.needs_rescan(df(["a/.gitignore"])) and not events.needs_rescan(df(["a", "b"])) and events.needs_rescan(df(["a", "b", "c"]), 2)


def test_status_merge_and_prune(spark):
    files = spark.createDataFrame([("a", 0), ("b", 256)], "path string, git_status int")
    status = spark.createDataFrame([("a", 256), ("new", 128), ("gone", 512)], "path string, status int")
    assert {r["path"]: r["git_status"] for r in events.merge_status(files, status).collect()} == {"a": 256, "b": None, "new": 128}
    day = 86_400_000_000
    kept = events.prune_accesses(spark.createDataFrame([("a", i * day) for i in range(40)], "path string, us long"), 39 * day, 30, 5)
    assert sorted(r["us"] // day for r in kept.collect()) == [35, 36, 37, 38, 39]


def test_materialize_uses_the_shared_folder(spark):
    df = materialize(spark.range(3), "t")
    bare = lambda p: "/" + p.removeprefix("file:").lstrip("/")
    assert df.count() == 3 and bare(df.inputFiles()[0]).startswith(bare(shared_dir(spark)))
