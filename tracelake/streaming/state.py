"""Latest results as keyed state in files: a log of deltas by hash bucket, compacted bucket by bucket.

``<folder>/log/b<batch>/bucket=<k>/`` holds what a batch brought, and
``<folder>/base/b<batch>/bucket=<k>/`` buckets as they stood after it. The state
of a key is the latest of all its rows; taking the latest is associative and
idempotent, so a bucket's base together with deltas that it covers already
reads the same. A batch only adds files of its own keys' buckets. Every so many
batches the buckets touched since are compacted; what they cover goes one
compaction later, so that readers that have listed it may finish.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.functions import refs as R
from tracelake.operators import verify

BUCKETS = 1024
COMPACT_EVERY = 16


def bucket(measure_id: Column, case_key: Column, buckets: int) -> Column:
    """A key's bucket. The case counts, too, so that a target with very many cases is spread."""
    return F.pmod(F.xxhash64(R.strip_pin(measure_id), F.coalesce(case_key, F.lit(""))), F.lit(buckets)).cast("int")


class ResultState:
    """Latest-wins state of results under ``folder``, which all executors see."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY):
        """``schema`` of the results; ``buckets`` must be the same each time the folder is used."""
        self.spark, self.folder, self.schema, self.buckets, self.compact_every = spark, folder.rstrip("/"), schema, buckets, compact_every
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs: JavaObject = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        used = [n for n in self._list("") if n.startswith("buckets-")]
        if used and used != [f"buckets-{buckets}"]:
            raise ValueError(f"{folder} has {used[0]}, not {buckets}")
        if not used:
            self._fs.mkdirs(self._path(f"{self.folder}/buckets-{buckets}"))

    def _list(self, below: str) -> list[str]:
        path = self._path(f"{self.folder}/{below}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _done(self, kind: str) -> list[int]:
        """Batches whose log or base is written whole."""
        names = [n for n in self._list(kind) if n[1:].isdigit()]
        return sorted(int(n[1:]) for n in names if self._fs.exists(self._path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def _buckets(self, kind: str, batch: int) -> set[int]:
        return {int(n.partition("=")[2]) for n in self._list(f"{kind}/b{batch}") if n.startswith("bucket=")}

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        latest = verify.latest(rows).withColumn("bucket", bucket(F.col("measure_id"), F.col("case_key"), self.buckets))
        latest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{kind}/b{batch}")

    def _rows(self, only: set[int] | None = None, upto: int = 1 << 62) -> DataFrame:
        """All rows of finished batches up to ``upto``, of some buckets or of all."""
        parts = [f"{self.folder}/{kind}/b{b}" for kind in ("base", "log") for b in self._done(kind) if b <= upto]
        if not parts:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        rows = [self.spark.read.schema(f"{self.schema}, bucket int").parquet(p) for p in parts]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out if only is None else out.filter(F.col("bucket").isin(sorted(only)))

    def fold(self, rows: DataFrame, batch: int) -> None:
        """Add a batch; running it again writes the same files."""
        self._write(rows.select(*(c.split()[0] for c in self.schema.split(", "))), "log", batch)
        if (batch + 1) % self.compact_every == 0:
            self.compact(batch)

    def compact(self, batch: int) -> set[int]:
        """Bring the buckets touched since the last compaction up to ``batch``, and drop what the one before covered. The buckets rewritten."""
        before = [b for b in self._done("base") if b < batch]
        since = before[-1] if before else -1
        touched = {k for b in self._done("log") if since < b <= batch for k in self._buckets("log", b)}
        for b in self._done("log"):
            if b <= since:
                self._drop(f"log/b{b}")
        for i, b in enumerate(before[:-1]):  # of older bases, buckets that a later one has; not the ones that this run replaces
            later = set().union(*(self._buckets("base", x) for x in before[i + 1 :]))
            for k in self._buckets("base", b) & later:
                self._drop(f"base/b{b}/bucket={k}")
        if touched:
            self._write(self._rows(touched, batch).drop("bucket"), "base", batch)
        return touched

    def _drop(self, below: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{below}"), True)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The latest result of each target and case; of ``keys`` (measure_id, case_key) only their buckets are read."""
        if keys is None:
            return verify.latest(self._rows())
        wanted = keys.select(R.strip_pin(F.col("measure_id")).alias("measure_id"), F.coalesce("case_key", F.lit("")).alias("case_key")).distinct()
        at = {r[0] for r in wanted.select(bucket(F.col("measure_id"), F.col("case_key"), self.buckets)).distinct().collect()}  # at most as many as there are buckets
        return verify.latest(self._rows(at)).join(wanted, ["measure_id", "case_key"], "left_semi")

    def files(self) -> list[str]:
        """Every data file of the state."""
        found, it = [], self._fs.listFiles(self._path(self.folder), True)
        while it.hasNext():
            p = it.next().getPath().toString()
            if p.endswith(".parquet"):
                found.append(p)
        return sorted(found)


def upsert(results: DataFrame, state: ResultState, checkpoint: str) -> StreamingQuery:
    """Fold a stream of results into ``state`` batch by batch."""
    return results.writeStream.foreachBatch(state.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
