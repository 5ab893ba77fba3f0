"""File events as streams: upserts into the file table, access cooldowns and pick runs as keyed state.

Batches are folded as they arrive; within one, events are ordered by ``(ts, seq)`` and the last write to a path wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FS_EVENT = "seq long, ts timestamp, op string, path string, content string"
MOST_PATHS = 1024
COOLDOWN_S = 300


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Events from JSON-lines files as they appear in a folder."""
    return spark.readStream.schema(FS_EVENT).option("maxFilesPerTrigger", per_trigger).json(folder)


def relevant(events: DataFrame) -> DataFrame:
    """Without reads; within a path only the last event counts."""
    w = W.partitionBy("path").orderBy(F.desc("ts"), F.desc("seq"))
    return events.where(F.col("op") != "read").withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def needs_rescan(events: DataFrame, most: int = MOST_PATHS) -> bool:
    """Too many paths, or an ignore file changed: the tree is read again instead."""
    paths = events.select("path").distinct()
    ignore = paths.where(F.col("path").rlike(r"(^|/)\.(git)?ignore$")).limit(1).count()
    return bool(ignore) or paths.limit(most + 1).count() > most


def apply_events(files: DataFrame, events: DataFrame) -> DataFrame:
    """``files(path, content)`` after a batch: removed paths and all below removed folders go, the rest takes its last content."""
    last = relevant(events)
    removed = last.where(F.col("op").isin("remove", "rmdir"))
    folders = removed.where(F.col("op") == "rmdir").select(F.col("path").alias("folder"))
    from skein.functions.paths import ancestors

    below = files.select("path", F.explode(ancestors(F.col("path"))).alias("folder")).join(folders, "folder", "left_semi").select("path")
    written = last.where(F.col("op").isin("add", "modify")).select("path", "content")
    # What was written in a folder after the folder went stays: those events are newer than the folder's.
    gone_at = last.where(F.col("op") == "rmdir").select(F.col("path").alias("folder"), F.struct("ts", "seq").alias("gone"))
    late = last.where(F.col("op").isin("add", "modify")).select("path", F.struct("ts", "seq").alias("at"), F.explode(ancestors(F.col("path"))).alias("folder"))
    lost = late.join(gone_at, "folder").where(F.col("at") < F.col("gone")).select("path").distinct()
    written = written.join(lost, "path", "left_anti")
    touched = removed.select("path").union(below).union(written.select("path")).union(lost).distinct()
    return files.select("path", "content").join(touched, "path", "left_anti").unionByName(written)


def maintain(stream: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str, rescan: Callable[[], DataFrame] | None = None):
    """A streaming query that folds each batch into the table; ``save`` gets the batch's number, so a repeated batch replaces itself."""

    def fold(batch: DataFrame, number: int) -> None:
        fresh = rescan() if rescan is not None and needs_rescan(batch) else apply_events(load(), batch)
        save(fresh, number)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


ACCEPTED = "path string, accepted_us array<long>, accepted long"


def cooldown_fold(times: list[int], last: int | None, gap_s: int = COOLDOWN_S) -> list[int]:
    """Accesses that are at least ``gap_s`` after the one accepted before."""
    out = []
    for t in sorted(times):
        if last is None or t - last >= gap_s * 1_000_000:
            out.append(t)
            last = t
    return out


def accepted_accesses(accesses: DataFrame, gap_s: int = COOLDOWN_S, watermark: str = "30 days") -> DataFrame:
    """``path, accepted_us, accepted``: accepted accesses per batch of ``accesses(path, ts)``, over a stream. State is the last accepted time and a count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n = state.get if state.exists else (None, 0)
        times = [int(t.value // 1000) if isinstance(t, pd.Timestamp) else int(t) for b in batches for t in b["ts"]]
        new = cooldown_fold(times, last, gap_s)
        if new:
            state.update((new[-1], n + len(new)))
        if state.exists:
            state.setTimeoutDuration(30 * 86400 * 1000)
        yield pd.DataFrame({"path": [key[0]], "accepted_us": [new], "accepted": [n + len(new)]})

    return accesses.groupBy("path").applyInPandasWithState(step, ACCEPTED, "last long, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


RUNS = "project string, query string, file_path string, open_count long"


def run_fold(picks: list[str], state: tuple[str, int] | None) -> tuple[str, int] | None:
    """The file picked last and how often in a row."""
    for p in picks:
        state = (p, state[1] + 1) if state and state[0] == p else (p, 1)
    return state


def pick_runs(completions: DataFrame) -> DataFrame:
    """The current run of picks for each project and query, over a stream of ``completions(project, query, file_path, us, seq)``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["us", "seq"])
        run = run_fold(list(rows["file_path"]), state.get if state.exists else None)
        state.update(run)
        yield pd.DataFrame({"project": [key[0]], "query": [key[1]], "file_path": [run[0]], "open_count": [run[1]]})

    c = completions.select(F.col("project").cast("string").alias("project"), F.col("query").cast("string").alias("query"), F.col("file_path").cast("string").alias("file_path"), "us", "seq")
    return c.groupBy("project", "query").applyInPandasWithState(step, RUNS, "file_path string, n long", "update", GroupStateTimeout.NoTimeout)


def accepted_batch(accesses: DataFrame, gap_s: int = COOLDOWN_S) -> DataFrame:
    """``path, accepted``: the same fold over a table of ``accesses(path, us)``, as a stream of sorted rows; only a path's last accepted time is held."""

    def run(batches):
        path, last, n, started = None, None, 0, False
        for b in batches:
            done: list[tuple[str, int]] = []
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not started or p != path:
                    if started:
                        done.append((path, n))
                    path, last, n, started = p, None, 0, True
                if last is None or t - last >= gap_s * 1_000_000:
                    last, n = t, n + 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "accepted"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([n], pa.int64())], names=["path", "accepted"])

    ordered = accesses.where(F.col("us").isNotNull()).select("path", "us").repartition("path").sortWithinPartitions("path", "us")
    return ordered.mapInArrow(run, "path string, accepted long")


def prune_accesses(accesses: DataFrame, now_us: int, days: int = 30, most: int = 128) -> DataFrame:
    """Accesses worth keeping: not older than ``days``, and the newest ``most`` of a path."""
    w = W.partitionBy("path").orderBy(F.desc("us"))
    fresh = accesses.where(F.col("us") >= now_us - days * 86_400_000_000)
    return fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def merge_status(files: DataFrame, status: DataFrame) -> DataFrame:
    """``files`` with the git state as it is now; files that git knows and the table doesn't are added without content."""
    kept = files.drop("git_status").join(status.select("path", F.col("status").alias("git_status")), "path", "left")
    new = status.join(files.select("path"), "path", "left_anti").where(F.col("status").bitwiseAND(F.lit(512 | 4)) == 0).select("path", F.col("status").alias("git_status"))
    return kept.unionByName(new, allowMissingColumns=True)
