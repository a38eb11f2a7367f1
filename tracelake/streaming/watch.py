"""Watched folders as streams: a source that lists them, and changes from polled snapshots by keyed state."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "folder string, path string, mtime bigint, op string"


class _Share(InputPartition):
    def __init__(self, version: int, share: int, of: int):
        self.version, self.share, self.of = version, share, of


class FolderReader(DataSourceStreamReader):
    """Lists the folders when asked for the latest offset; a listing that differs from the last is kept as the next version.

    Offsets are version numbers and versions are kept below ``state``, so a
    batch that runs again, or a query that starts again, reads the same
    changes; versions that every batch has passed go.
    """

    def __init__(self, options: dict[str, str]):
        self.folders = json.loads(options["folders"])  # name: path or URI
        self.suffixes = tuple(x for x in options.get("suffixes", "").split(",") if x)
        self.state, self.shares = options["state"].rstrip("/"), int(options.get("shares", "8"))

    @staticmethod
    def _at(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)

    def _listing(self) -> dict[str, list]:
        from pyarrow import fs

        out = {}
        for name, path in self.folders.items():
            files, base = self._at(path)
            for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
                if f.type == fs.FileType.File and f.path.endswith(self.suffixes or ""):
                    out[f"{name}\t{f.path}"] = [f.mtime_ns // 1000, f.size]
        return out

    def _versions(self) -> list[int]:
        from pyarrow import fs

        files, base = self._at(self.state)
        found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(int(f.base_name[1:-5]) for f in found if f.base_name.startswith("v") and f.base_name.endswith(".json"))

    def _load(self, version: int) -> dict[str, list]:
        if version == 0:
            return {}
        files, base = self._at(self.state)
        with files.open_input_stream(f"{base}/v{version}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        last = max(self._versions(), default=0)
        now = self._listing()
        if now == self._load(last):
            return {"version": last}
        files, base = self._at(self.state)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/new-{last + 1}") as f:
            f.write(json.dumps(now).encode())
        files.move(f"{base}/new-{last + 1}", f"{base}/v{last + 1}.json")
        return {"version": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Share(v, k, self.shares) for v in range(start["version"] + 1, end["version"] + 1) for k in range(self.shares)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        """The changes from the version before to this one whose path falls to this share."""
        before, after = self._load(partition.version - 1), self._load(partition.version)
        for key in sorted(before.keys() | after.keys()):
            if int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % partition.of != partition.share or before.get(key) == after.get(key):
                continue
            folder, path = key.split("\t", 1)
            op = "add" if key not in before else "delete" if key not in after else "modify"
            yield folder, path, (after.get(key) or before[key])[0], op

    def commit(self, end: dict) -> None:
        files, base = self._at(self.state)
        for v in self._versions():
            if v < end["version"]:
                files.delete_file(f"{base}/v{v}.json")


class FolderWatch(DataSource):
    """``spark.readStream.format("folder_watch")`` with options ``folders`` (JSON: name to path), ``state`` (a folder that outlives the query) and ``suffixes``."""

    @classmethod
    def name(cls) -> str:
        return "folder_watch"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001
        return FolderReader(self.options)


def watch(spark: SparkSession, folders: dict[str, str], state: str, suffixes: tuple[str, ...] = (".md", ".yaml", ".json")) -> DataFrame:
    """A stream of changes (folder, path, mtime in microseconds, op: add, modify or delete) of the files below ``folders`` (name: path).

    The first batch adds every file that is there. ``folders`` names kinds, as
    in ``{"requirements": ..., "results": ...}``; see ``results.watched_folders``.
    """
    spark.dataSource.register(FolderWatch)
    return spark.readStream.format("folder_watch").option("folders", json.dumps(folders)).option("state", state).option("suffixes", ",".join(suffixes)).load()


# ------------------------------------------------------------ polled snapshots

POLLED = "path string, op string, mtime bigint, poll timestamp"


class _Changes(StatefulProcessor):
    """State of one path: its last mtime; a timer that a poll without the path lets run out."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "mtime bigint, poll_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N803
        seen = sorted(((int(r.value // 1_000_000), int(m)) for x in rows for r, m in zip(x["poll"], x["mtime"])), key=lambda v: v[0])
        old = self.last.get() if self.last.exists() else None
        mtime, at = (int(old[0]), int(old[1])) if old else (None, None)
        if at is not None:
            self.handle.deleteTimer(at + self.patience_ms)
        out = []
        for poll, m in seen:
            if mtime is not None and poll - at > self.patience_ms:  # gone and back before its timer ran out
                out.append((key[0], "delete", mtime, at))
                mtime = None
            if mtime is None or m != mtime:
                out.append((key[0], "add" if mtime is None else "modify", m, poll))
            mtime, at = m, max(poll, at or 0)
        self.last.update((mtime, at))
        self.handle.registerTimer(at + self.patience_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N803
        old = self.last.get() if self.last.exists() else None
        self.last.clear()
        yield _frame([(key[0], "delete", int(old[0]), int(old[1]))] if old else [])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["path", "op", "mtime", "poll"])
    return out.assign(poll=pd.to_datetime(out["poll"], unit="ms"), mtime=out["mtime"].astype("int64"))


def changes(polls: DataFrame, patience: int = 1_500) -> DataFrame:
    """Changes (path, op, mtime, poll) from a stream of polled snapshots (path, mtime, poll): every poll lists all that is there.

    Each path's last mtime is keyed state. A path that no poll has shown for
    ``patience`` milliseconds of poll time, which must exceed the time between
    polls, was deleted (poll: when it was seen last); so a change comes out
    once, however often it is polled. Needs RocksDB as the state store.
    """
    if polls.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass").rpartition(".")[2] != "RocksDBStateStoreProvider":
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to RocksDBStateStoreProvider")
    keyed = polls.select("path", "mtime", "poll").withWatermark("poll", "0 seconds").groupBy("path")
    return keyed.transformWithStateInPandas(_Changes(patience), POLLED, "Append", "EventTime")
