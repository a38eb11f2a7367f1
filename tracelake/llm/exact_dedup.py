"""Exact dedup by two-pass Bloom filtering.

Pass one sets, for each text's hash, two bits of a blocked Bloom filter that
keeps apart "set once" and "set again"; a hash that occurs twice has set all
its bits again, so the "again" bitmap never misses a repeat. Pass two probes
it: rows that can't be repeats pass straight through, and only the others are
shuffled and compared by their SHA-256.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, free_name, table

BLOCK_BITS = 1 << 20  # bits of a block of the filter; both bits of a hash lie in one block
BITS_A_ROW = 16
MAX_FILTER_BYTES = 64 << 20  # broadcast at once; a larger filter is probed in slices of this size


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = h.view(np.uint64)
    low = np.uint64(BLOCK_BITS - 1)
    return ((h >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64), (h & low).astype(np.int64), ((h >> np.uint64(20)) & low).astype(np.int64)


def _set_bits(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, p, q = _places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), blocks)
            twin = p == q  # such a hash sets one bit only, once
            at, n = np.unique(np.concatenate([block * BLOCK_BITS + p, (block * BLOCK_BITS + q)[~twin]]), return_counts=True)
            own = at // BLOCK_BITS
            edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(at) else np.array([], int)
            ends = np.r_[edge[1:], len(at)] if len(at) else edge
            bits, again = (at % BLOCK_BITS).astype("<u4"), n > 1
            yield pa.record_batch({
                "block": pa.array([int(own[a]) for a in edge], pa.int64()),
                "bits": pa.array([bits[a:b].tobytes() for a, b in zip(edge, ends)], pa.binary()),
                "again": pa.array([bits[a:b][again[a:b]].tobytes() for a, b in zip(edge, ends)], pa.binary()),
            })

    return run


def _merge(key, parts):
    """A block's bit lists together: at most BITS_A_ROW bits a row, so a block's share is bounded."""
    once, again = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
    for bits, more in zip(parts.column("bits").to_pylist(), parts.column("again").to_pylist()):
        x = np.frombuffer(bits, "<u4")
        again[x[once[x]]] = True
        once[x] = True
        again[np.frombuffer(more, "<u4")] = True
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "again": pa.array([np.packbits(again).tobytes()], pa.binary())})


def probed(hashes: DataFrame, column: str, rows: int, flag: str, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Adds the boolean ``flag`` to ``hashes``: whether the 64-bit ``column`` (not null) may occur more than once; true for all that do.

    The filter has BITS_A_ROW bits a row. Within ``max_filter_bytes`` it is
    broadcast; beyond, slices of its blocks of that size are broadcast one
    after the other, each probed with the rows of its own slice only.
    """
    spark = hashes.sparkSession
    blocks = max(1, math.ceil(rows * BITS_A_ROW / BLOCK_BITS))
    per = max(1, max_filter_bytes * 8 // BLOCK_BITS)
    bits = hashes.select(column).mapInArrow(_set_bits(blocks), "block long, bits binary, again binary")
    merged = cut(bits.groupBy("block").applyInArrow(_merge, "block long, again binary"))
    schema, out = hashes.withColumn(flag, F.lit(True)).schema, None
    for first in range(0, blocks, per):
        last = min(first + per, blocks)
        held = {r["block"]: np.frombuffer(r["again"], np.uint8) for r in merged.filter(F.col("block").between(first, last - 1)).collect()}
        bitmap = np.zeros((last - first, BLOCK_BITS // 8), np.uint8)
        for k, v in held.items():
            bitmap[k - first] = v
        shared = spark.sparkContext.broadcast(bitmap)

        def probe(batches: Iterator[pa.RecordBatch], first=first, last=last, shared=shared) -> Iterator[pa.RecordBatch]:
            flat = shared.value.reshape(-1)
            for batch in batches:
                block, p, q = _places(batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64), blocks)
                mine = (block >= first) & (block < last)
                at = np.where(mine, block - first, 0) * BLOCK_BITS
                hit = lambda x: (flat[(at + x) >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1  # noqa: B023, E731
                yield batch.append_column(flag, pa.array((hit(p) & hit(q)).astype(bool))).filter(pa.array(mine))

        part = hashes.mapInArrow(probe, schema)
        part = cut(part) if blocks > per else part
        out = part if out is None else out.unionByName(part)
        if blocks > per:
            shared.unpersist()
    return out


def possible_repeats(hashes: DataFrame, column: str, rows: int, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The rows of ``hashes`` that ``probed`` flags."""
    flag = free_name(hashes, "maybe")
    return probed(hashes, column, rows, flag, max_filter_bytes).filter(flag).drop(flag)


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_filter_bytes: int = MAX_FILTER_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, repeated): a row (doc_id, sha, h, maybe) for each document, ``maybe`` if the filter can't clear it; (sha, keep_id, group_size) for each text found more than once."""
    sha = F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256))
    rows = docs.select(F.col(doc_id).alias("doc_id"), sha.alias("sha"))
    rows = cut(rows.withColumn("h", F.xxhash64("sha")))
    rows = probed(rows, "h", rows.count(), "maybe", max_filter_bytes)
    repeated = rows.filter("maybe").groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    return rows, cut(repeated)


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty; of equal texts the
    row with the largest doc_id stays (null ids rank lowest). Rows repeated
    with one doc_id and text are one document: all of them say ``kept``, and
    ``dedup`` returns one. No document gives no row.
    """
    rows, repeated = groups(docs, text, doc_id, max_filter_bytes)
    maybe = rows.filter("maybe").select("doc_id", "sha")
    size, keep = F.lit(None).cast("long"), F.lit(None).cast(rows.schema["doc_id"].dataType)
    cleared = rows.filter("NOT maybe").select("doc_id", "sha", keep.alias("keep_id"), size.alias("group_size"))
    seen = cleared.unionByName(attach(maybe, repeated, "sha", "group_size", maybe.count()).select(*cleared.columns))
    one = F.col("group_size").isNull()
    return seen.select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (one | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The documents with all their columns, one of each text: that with the largest doc_id (null ids last).

    Of rows repeated with one doc_id and text the least by the hash of the
    whole row stays. The repeated texts are looked up where the documents lie
    if they fit MAX_FILTER_BYTES; beyond, documents that the filter clears pass
    straight through and the others are joined by hash.
    """
    _, repeated = groups(docs, text, doc_id, max_filter_bytes)
    k = {c: free_name(docs, f"dedup_{c}") for c in ("sha", "keep", "n", "row")}
    tagged = docs.withColumn(k["sha"], F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)))
    known = repeated.select(F.col("sha").alias(k["sha"]), F.col("keep_id").alias(k["keep"]), F.col("group_size").alias(k["n"]))
    count = known.count()
    if count * 64 <= max_filter_bytes:
        seen = tagged.join(F.broadcast(known), k["sha"], "left")
    else:
        hashed, mark = tagged.withColumn(k["row"], F.xxhash64(k["sha"])), free_name(docs, "dedup_maybe")
        flagged = probed(hashed, k["row"], docs.count(), mark, max_filter_bytes).drop(k["row"])
        maybe, none = flagged.filter(mark).drop(mark), {c: F.lit(None).cast(known.schema[c].dataType) for c in (k["keep"], k["n"])}
        seen = attach(maybe, known, k["sha"], k["n"], maybe.count())
        seen = seen.unionByName(flagged.filter(~F.col(mark)).drop(mark).withColumns(none))
    once = seen.filter(F.col(k["n"]).isNull()).select(*docs.columns)
    left = seen.filter(F.col(k["n"]).isNotNull() & F.col(doc_id).eqNullSafe(F.col(k["keep"])))
    best = left.groupBy(k["sha"]).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(k["row"]))
    return once.unionByName(best.select(f"{k['row']}.*"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
