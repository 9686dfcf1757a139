"""Change events to index jobs: scope, debounce, triage, and micro-batches that may be run again."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from graphloom.sources.corpus import CorpusConfig, in_corpus

EVENT = "corpus string, path string, kind string, ts timestamp"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change events from JSON files that appear in a folder."""
    return spark.readStream.schema(EVENT).json(folder)


def table_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """The events table as such a stream: users are corpora, event ids paths."""
    rows = spark.readStream.schema(schema).parquet(path)
    return as_changes(rows)


def as_changes(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_id").cast("string").alias("corpus"), F.col("event_id").cast("string").alias("path"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


def in_scope(rows: DataFrame, config: CorpusConfig) -> DataFrame:
    return rows.where(in_corpus(F.col("path"), config))


def caps(window: float, max_age: float | None) -> float | None:
    """The greatest age of a batch in seconds: ten windows unless set; 0 or less means none."""
    cap = 10 * window if max_age is None else max_age
    if cap <= 0:
        return None
    if cap < window:
        raise ValueError("max_age must not be below the window")
    return cap


def debounced(rows: DataFrame, window: float = 30.0, delay: str = "1 minute") -> DataFrame:
    """corpus, start, end and paths of bursts: events of a corpus that follow each other within the window.

    For a stream, late by at most `delay`; a burst is complete when the watermark passes its end.
    """
    timed = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    bursts = timed.groupBy("corpus", F.session_window("ts", f"{int(window * 1000)} milliseconds").alias("w")).agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count(F.lit(1)).alias("n_events"))
    return bursts.select("corpus", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "n_events")


def bursts(rows: DataFrame, window: float = 30.0, max_age: float | None = None) -> DataFrame:
    """As debounced(), for a table, where no burst grows older than max_age: a longer one is parted at its multiples.

    Gaps and islands by window functions: a burst begins where the event before it is further away than the window.
    """
    cap = caps(window, max_age)
    at = Window.partitionBy("corpus").orderBy("ts", "path")
    t = F.col("ts").cast("double")
    begun = rows.withColumn("_new", F.coalesce(t - F.lag(t).over(at) > window, F.lit(True)).cast("int"))
    island = begun.withColumn("_burst", F.sum("_new").over(at))
    if cap is not None:
        age = t - F.min(t).over(Window.partitionBy("corpus", "_burst"))
        island = island.withColumn("_part", F.floor(age / cap))
    else:
        island = island.withColumn("_part", F.lit(0))
    return island.groupBy("corpus", "_burst", "_part").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.countDistinct("path").alias("n_paths"), F.count(F.lit(1)).alias("n_events")).drop("_burst", "_part")


def debounced_by_age(rows: DataFrame, window: float = 30.0, max_age: float | None = None, delay: str = "1 minute") -> DataFrame:
    """The stream of bursts with a greatest age, by state per corpus: corpus, start, last, paths.

    An event further from the last one than the window, or from the first one than max_age, closes the burst; so does
    a watermark past the window.
    """
    cap = caps(window, max_age) or float("inf")

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, last, paths = state.get if state.exists else (None, None, "[]")
        held, out = set(json.loads(paths)), []
        if state.hasTimedOut:
            out.append((key[0], start, last, sorted(held)))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "path"])
            for ts, path in zip(rows["ts"], rows["path"], strict=True):
                now = ts.timestamp()
                if start is not None and (now - last > window or now - start >= cap):
                    out.append((key[0], start, last, sorted(held)))
                    start, held = None, set()
                start = now if start is None else start
                last = now
                held.add(path)
            state.update((start, last, json.dumps(sorted(held))))
            state.setTimeoutTimestamp(max(int((last + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(c, pd.Timestamp(a, unit="s"), pd.Timestamp(b, unit="s"), p) for c, a, b, p in out], columns=["corpus", "start", "last", "paths"])

    timed = rows.withWatermark("ts", delay)
    return timed.groupBy("corpus").applyInPandasWithState(step, "corpus string, start timestamp, last timestamp, paths array<string>", "start double, last double, paths string", "append", "EventTimeTimeout")


# digests


class DigestStore:
    """path and digest of what was indexed, as a Parquet table that each batch replaces whole."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)

    def read(self) -> DataFrame:
        pointer = self.folder / "current"
        if not pointer.exists():
            return self.spark.createDataFrame([], "path string, digest string")
        return self.spark.read.schema("path string, digest string").parquet(str(self.folder / pointer.read_text()))

    def _replace(self, df: DataFrame, batch: str) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        df.write.mode("overwrite").parquet(str(self.folder / batch))
        part = self.folder / "current.part"
        part.write_text(batch)
        os.replace(part, self.folder / "current")

    def mark(self, done: DataFrame, batch: str) -> None:
        """Write digests over; only after the batch has succeeded, and with those from before it ran."""
        done = done.select("path", "digest").dropDuplicates(["path"])
        self._replace(self.read().join(done, "path", "left_anti").unionByName(done), batch)

    def forget(self, paths: DataFrame, batch: str) -> None:
        self._replace(self.read().join(paths.select("path"), "path", "left_anti"), batch)


def triaged(changed: DataFrame, current: DataFrame, known: DataFrame) -> DataFrame:
    """path, digest, action of changed paths: gone ones and those with another digest, or none, are to be indexed."""
    rows = changed.select("path").distinct().join(current.select("path", "digest", F.lit(True).alias("_here")), "path", "left").join(known.select("path", F.col("digest").alias("_was")), "path", "left")
    same = F.coalesce(F.col("digest") == F.col("_was"), F.lit(False))
    return rows.select("path", "digest", F.when(F.col("_here").isNull(), "reap").when(same, "unchanged").otherwise("index").alias("action"))


def missing(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Paths that are there but not in the graph."""
    return current.select("path").distinct().join(indexed.select("path"), "path", "left_anti")


def replayed(current: DataFrame, since) -> DataFrame:
    """After a crash: files changed at or after the checkpointed one, and those whose time is unknown."""
    return current.where((F.col("modified") >= F.lit(since)) | F.col("modified").isNull())


def swept(units: DataFrame, elapsed: float, rate: float = 0.017, carried: float = 0.0) -> DataFrame:
    """Adds due to units (path, n_sections), those that a token bucket lets a sweep look at, in order of path.

    The bucket holds carried + elapsed * rate; each unit takes its sections, one at least, and may start while one is left.
    """
    cost = F.greatest(F.lit(1), F.col("n_sections"))
    budget = carried + elapsed * rate
    spent = F.coalesce(F.sum(cost).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return units.withColumn("due", budget - spent >= 1)


# running


def branch_allows(root: str, allowed: list[str] | None) -> bool:
    """Whether the repository at root is on an allowed branch; without a list always, and a detached head never with one."""
    if not allowed:
        return True
    git = Path(root) / ".git"
    if git.is_file():
        git = (git.parent / git.read_text().split(":", 1)[1].strip()).resolve()
    head = git / "HEAD"
    return head.exists() and head.read_text().strip().removeprefix("ref: refs/heads/") in allowed


def git_busy(root: str) -> bool:
    git = Path(root) / ".git"
    return any((git / x).exists() for x in ("index.lock", "MERGE_HEAD", "rebase-merge", "rebase-apply"))


def sync(changes: DataFrame, handle: Callable[[DataFrame, int], DataFrame], digests: DigestStore, current: Callable[[], DataFrame], checkpoint: str, failed: str, gate: Callable[[], bool] | None = None, **trigger) -> StreamingQuery:
    """Run handle on the paths of each micro-batch that need work.

    handle gets (path, digest, action) and gives path and ok; digests are marked for those that are, and the others are
    appended to `failed` and tried again with the next batch. Run twice, a batch changes nothing the second time.
    """

    def batch(df: DataFrame, number: int) -> None:
        if gate is not None and not gate():
            raise RuntimeError("the repository is busy or on another branch")
        spark = df.sparkSession
        paths = df.select("path")
        if Path(failed).exists():
            paths = paths.unionByName(spark.read.schema("path string").json(failed))
        work = triaged(paths, current(), digests.read()).where("action <> 'unchanged'").cache()
        if work.isEmpty():
            return
        done = handle(work, number).cache()
        good = work.join(done.where("ok").select("path"), "path", "left_semi")
        digests.forget(good.where("action = 'reap'"), f"b{number}-reaped")
        digests.mark(good.where("action = 'index'"), f"b{number}")
        work.join(done.where("ok").select("path"), "path", "left_anti").select("path").coalesce(1).write.mode("overwrite").json(failed)
        work.unpersist()
        done.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def control(query: StreamingQuery, command: str) -> dict:
    if command == "ping":
        return {"ok": True}
    if command == "status":
        return {"active": query.isActive, "batches": query.lastProgress["batchId"] + 1 if query.lastProgress else 0}
    if command == "stop":
        query.stop()
        return {"ok": True}
    raise ValueError(f"unknown command {command!r}")
