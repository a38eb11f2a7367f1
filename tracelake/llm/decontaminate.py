"""Benchmark decontamination by greedy string tiling.

Hashes of the benchmark's five-word runs are the seeds; a document that shares
one is tiled with that item (Wise's running Karp-Rabin greedy string tiling,
1993): the longest common run of words that no earlier tile uses is marked
again and again, down to five words. The share of the item's words that the
tiles cover decides, so reordered passages count in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, shingles, SIGNS, table, words

LEAST_RUN = 5
COVERAGE = 0.8
SLICE_BYTES = 8 << 20  # of benchmark text held and broadcast at once; a larger benchmark goes in slices, each over all documents


def tile(doc: np.ndarray, item: np.ndarray, at_doc: np.ndarray, at_item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (first in doc, first in item, words) from the places where ``least`` words agree.

    Longest first; of equal ones the first in the item, then in the document.
    """
    order = np.lexsort((at_doc, at_doc - at_item))
    p, q = at_doc[order], at_item[order]
    new = np.r_[True, (p[1:] - p[:-1] != 1) | (q[1:] - q[:-1] != 1)]
    first = np.flatnonzero(new)
    runs = np.diff(np.r_[first, len(p)]) + least - 1
    todo = [(int(n), int(a), int(b)) for n, a, b in zip(runs, p[first], q[first])]
    used_doc, used_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    by_length: dict[int, list[tuple[int, int]]] = {}
    for n, a, b in todo:
        by_length.setdefault(n, []).append((b, a))
    while by_length:
        n = max(by_length)
        for b, a in sorted(by_length.pop(n)):
            free = ~(used_doc[a : a + n] | used_item[b : b + n])
            if free.all():
                out.append((a, b, n))
                used_doc[a : a + n] = used_item[b : b + n] = True
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if e - s >= least:
                    by_length.setdefault(e - s, []).append((b + s, a + s))
    return out


@dataclass
class Index:
    """One slice of the benchmark: words of all items and the seeds of their runs."""

    ids: list
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # run length -> sorted hashes, item, place

    def __post_init__(self):
        self.maybe = {}
        for k, (h, _, _) in self.seeds.items():
            bits = np.zeros(1 << 20, bool)
            bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.maybe[k] = bits

    def matches(self, text: str | None, coverage: float) -> list[tuple[int, int, list[tuple[int, int, int]], np.ndarray, np.ndarray]]:
        """(item, words covered, tiles, word starts, word ends) of each item of which at least ``coverage`` is covered."""
        doc, start, end = words(text, separator=SIGNS)
        hits: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for k, (seed, own, place) in self.seeds.items():
            if len(doc) < k:
                continue
            h = shingles(doc, k)
            near = np.flatnonzero(self.maybe[k][(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            low, high = np.searchsorted(seed, h[near]), np.searchsorted(seed, h[near], side="right")
            near, low, high = (x[high > low] for x in (near, low, high))
            if not len(near):
                continue
            n = high - low
            at = np.repeat(near, n)
            pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            item = own[pick]
            order = np.argsort(item, kind="stable")
            at, pick, item = at[order], pick[order], item[order]
            edge = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
            for a, b in zip(edge, np.r_[edge[1:], len(item)]):
                hits.setdefault(int(item[a]), []).append((at[a:b], place[pick[a:b]], k))
        out = []
        for i, parts in sorted(hits.items()):
            at_doc, at_item, k = parts[0]
            tiles = tile(doc, self.words[i], at_doc, at_item, k)
            covered = sum(n for *_, n in tiles)
            if covered >= coverage * len(self.words[i]):
                out.append((i, covered, tiles, start, end))
        return out


def _index(rows: list) -> Index:
    ids, own, seeds = [], [], {}
    for r in rows:
        w = words(r["text"], separator=SIGNS)[0]
        if len(w):
            k = min(LEAST_RUN, len(w))
            h = shingles(w, k)
            seeds.setdefault(k, []).append((h, np.full(len(h), len(ids)), np.arange(len(h))))
            ids.append(r["item_id"])
            own.append(w)
    packed = {}
    for k, parts in seeds.items():
        h, i, p = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        packed[k] = (h[order], i[order], p[order])
    return Index(ids, own, packed)


def _slices(benchmark: DataFrame, text: str, item_id: str, most: int) -> Iterator[Index]:
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / most))
    for k in range(n):
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield _index(own.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per pair of a document and a benchmark item of which it holds at least ``coverage``.

    Columns doc_id, item_id, covered, item_words, coverage, tiles (start and
    end in the document's UTF-8 bytes, first word in the item, words). Words
    are runs of letters and digits, A-Z as a-z. Items of fewer than five words
    are matched whole; empty or null texts match nothing. Repeated rows give
    repeated pairs; an empty table on either side gives no rows.
    """
    tile_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))
    schema = "doc_id long, item_id long, covered long, item_words long, coverage double, tiles array<struct<start: long, end: long, item_word: long, words: long>>"
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in _slices(benchmark, text, item_id, slice_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            give_back()
            x = shared.value
            for batch in batches:
                rows = [(d, x.ids[i], c, len(x.words[i]), c / len(x.words[i]), [{"start": int(s[a]), "end": int(e[a + n - 1]), "item_word": b, "words": n} for a, b, n in tiles])
                        for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for i, c, tiles, s, e in x.matches(t, coverage)]
                cols = list(zip(*rows)) or [()] * 6
                types = [pa.int64()] * 4 + [pa.float64(), tile_type]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, types)], names=["doc_id", "item_id", "covered", "item_words", "coverage", "tiles"])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", item_id: str = "item_id", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents that hold no benchmark item to ``coverage``, with all their columns; decided row by row."""
    place, out = docs.columns.index(text), docs
    for index in _slices(benchmark, text, item_id, slice_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.matches(t, coverage) for t in batch.column(place).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with the items they hold."""
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "item_words", "coverage")
