"""Streams of verification results, and full rebuilds on change."""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.functions import refs as R
from tracelake.model import cut

_log = logging.getLogger(__name__)
#: How often each listener has failed.
failures: Counter[str] = Counter()


def latest_stream(results: DataFrame) -> DataFrame:
    """Latest result of each (target, case) of a stream, for update mode.

    The state is one maximum of (time, source, outcome) for each key: a
    semilattice, so arrival order and late data don't matter and no watermark
    is needed. Of equal times the least source wins.
    """
    when = F.coalesce(F.unix_micros(F.col("verified_at").cast("timestamp")), F.lit(-(1 << 62)))
    best = F.min(F.struct((-when).alias("t"), F.col("source"), F.col("load_ord"), F.col("outcome"), F.col("verified_at"))).alias("b")
    g = results.groupBy(R.strip_pin(F.col("measure_id")).alias("measure_id"), F.coalesce("case_key", F.lit("")).alias("case_key")).agg(best)
    return g.select("measure_id", "case_key", "b.outcome", "b.verified_at", "b.source", "b.load_ord")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder below the shared checkpoint folder."""
    cut(spark.range(0))  # sets it
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"


def watched_folders(results_path: str, is_folder: bool) -> list[str]:
    """The folders to watch for results: the path itself, or the one that a single report lies in."""
    return [results_path.rstrip("/") if is_folder else results_path.rpartition("/")[0] or "."]


def notify(stream: DataFrame, listeners: list[Callable[[int], None]], checkpoint: str, interval: str = "500 milliseconds") -> StreamingQuery:
    """Tell every listener of each batch of changes; one that fails misses the message, which is logged and counted in ``failures``, and stops nobody else."""

    def send(batch: DataFrame, batch_id: int) -> None:
        if batch.limit(1).count():
            for f in listeners:
                try:
                    f(batch_id)
                except Exception:
                    failures[getattr(f, "__qualname__", repr(f))] += 1
                    _log.exception("listener failed on batch %s", batch_id)

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def quiet_periods(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """File events (path, ts) debounced: one row for each burst that a quiet ``gap`` ends."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.approx_count_distinct("path").alias("paths")).select("w.start", "w.end", "events", "paths")


def rebuild_on_change(stream: DataFrame, rebuild: Callable[[SparkSession, int], DataFrame], view: str, checkpoint: str, interval: str = "500 milliseconds") -> StreamingQuery:
    """Run ``rebuild`` in full for each batch of changes and swap the view once the new version stands."""

    def swap(batch: DataFrame, batch_id: int) -> None:
        if batch.limit(1).count():
            rebuild(stream.sparkSession, batch_id).createOrReplaceTempView(view)

    return stream.writeStream.foreachBatch(swap).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two snapshots (path, mtime): path, op (add, modify, delete). For a stream of them see ``watch.changes``."""
    x = before.select("path", F.col("mtime").alias("o")).join(after.select("path", F.col("mtime").alias("n")), "path", "full_outer").filter(~F.col("o").eqNullSafe(F.col("n")))
    return x.select("path", F.when(F.col("o").isNull(), "add").when(F.col("n").isNull(), "delete").otherwise("modify").alias("op"))
