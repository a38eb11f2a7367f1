"""Ranked lexical search over document shards with precomputed integer impacts.

Documents are gathered in shards. Each shard holds its postings as compressed
sparse rows: sorted term hashes, where each term's postings end, document
places and impacts. An impact is all of a term's score in a document but the
term's weight: it needs the corpus' document and token counts, so these are
taken first. A query works through its terms one at a time, adding weight
times impact to one dense accumulator a shard; the best of each shard are
chosen by argpartition, with ties at the border settled by document id, and
the shards' best are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SIGNS, cut, give_back, rows_of, table, words

SHARD_BYTES = 1 << 23  # a shard ends once its texts hold so many bytes
BLOCK_PAIRS = 1 << 18  # pairs of a query and a term searched with at once
MERGE = 256  # groups of shards merged before the last merge
TOP = 10

_SHARD = "shard long, doc_ids array<long>, postings long, terms binary, ends binary, places binary, impacts binary"


@dataclass(frozen=True)
class Index:
    shards: DataFrame
    documents: int  # with at least one term
    tokens: int


def _squeeze(x: np.ndarray, kind: str) -> bytes:
    return pa.compress(x.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _array(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _terms(text: str | None) -> np.ndarray:
    return words(text, separator=SIGNS)[0]


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """The integer share of a term's score that its weight multiplies; ``length``: terms of the document with repeats."""
    norm = 100 - 90 + (90 * length * documents) // max(tokens, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _shard(number: int, ids: list, texts: list, documents: int, tokens: int) -> dict:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    term, tf, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    length = np.zeros(len(ids), np.int64)
    for at, i in enumerate(order):
        found, n = np.unique(_terms(texts[i]), return_counts=True)
        term.append(found)
        tf.append(n)
        place.append(np.full(len(found), at))
        length[at] = n.sum()
    term, tf, place = map(np.concatenate, (term, tf, place))
    by = np.argsort(term, kind="stable")
    term, place, impact = term[by], place[by], impacts(tf, length[place], documents, tokens)[by]
    last = np.flatnonzero(np.append(term[1:] != term[:-1], True)) if len(term) else np.zeros(0, np.int64)
    return {
        "shard": number, "doc_ids": [ids[i] for i in order], "postings": len(term), "terms": term[last].astype("<u8").tobytes(), "ends": (last + 1).astype("<u4").tobytes(),
        "places": _squeeze(place, "<u4"), "impacts": _squeeze(impact, "<u4"),
    }


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index every row and whole text; the shards are written once to the shared checkpoint folder.

    Terms are runs of ASCII letters and digits and of all characters outside
    ASCII, A-Z as a-z, told apart by 64-bit hashes. Null texts and texts
    without terms are never found. Rows repeated or with a null id are
    documents of their own.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = tokens = 0
        for (t,) in rows_of(batches, "text"):
            n = len(_terms(t))
            documents += n > 0
            tokens += n
        yield pa.record_batch({"documents": pa.array([documents], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    sums = src.select("text").mapInArrow(count, "documents long, tokens long").agg(F.sum("documents"), F.sum("tokens")).first()
    documents, tokens = (x or 0 for x in sums)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal made, ids, texts, held
            row = _shard((part << 33) + made, ids, texts, documents, tokens)
            made += 1
            ids, texts, held = [], [], 0
            types = {"shard": pa.int64(), "doc_ids": pa.list_(pa.int64()), "postings": pa.int64()}
            return pa.record_batch({k: pa.array([v], types.get(k, pa.binary())) for k, v in row.items()})

        for doc, t in rows_of(batches, "doc_id", "text"):
            ids.append(doc)
            texts.append(t)
            held += len(t or "") + 16
            if held >= shard_bytes:
                yield emit()
        if ids:
            yield emit()

    return Index(cut(src.mapInArrow(shards, _SHARD)), documents, tokens)


def _blocks(queries: DataFrame, text: str, item_id: str, most: int) -> Iterator[list[tuple]]:
    """(item_id, sorted distinct term hashes) of the queries that have terms, in blocks of about ``most`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, t in rows_of(batches, "item_id", "text"):
            yield pa.record_batch({"terms": pa.array([np.unique(_terms(t)).astype("<u8").tobytes()], pa.binary()), "item_id": pa.array([item], pa.int64())})

    own = cut(queries.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct().mapInArrow(run, "terms binary, item_id long"))
    n = max(1, math.ceil((own.agg(F.sum(F.octet_length("terms"))).first()[0] or 0) / 8 / most))
    for k in range(n):
        found: dict = {}
        for r in own.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect():
            found.setdefault(r["item_id"], []).append(np.frombuffer(r["terms"], "<u8"))
        yield [(i, terms) for i, parts in found.items() if len(terms := np.unique(np.concatenate(parts)))]


def _frequencies(index: Index, asked: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the asked terms, of those that any holds."""
    shared = index.shards.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value), np.int64)
        for terms, ends in rows_of(batches, "terms", "ends"):
            own, end = np.frombuffer(terms, "<u8"), np.frombuffer(ends, "<u4").astype(np.int64)
            at = np.searchsorted(shared.value, own)
            hit = np.flatnonzero(shared.value[np.minimum(at, len(df) - 1)] == own)
            df[at[hit]] += np.diff(end, prepend=0)[hit]
        use = np.flatnonzero(df)
        yield pa.record_batch({"at": pa.array(use, pa.int64()), "df": pa.array(df[use], pa.int64())})

    found = index.shards.select("terms", "ends").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect()
    return {int(asked[r["at"]]): r["df"] for r in found}


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0; at the border the first places win."""
    hit = np.flatnonzero(score > 0)
    if len(hit) <= k:
        return hit
    own = score[hit]
    border = own[np.argpartition(-own, k - 1)[k - 1]]
    above = hit[own > border]
    return np.concatenate([above, hit[own == border][: k - len(above)]])


def _best_of(found: DataFrame, k: int, *also: str) -> DataFrame:
    order = Window.partitionBy("item", *also).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = TOP, text: str = "text", item_id: str = "item_id", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``k`` best documents, equal scores by ascending doc_id, null ids last.

    A query's terms count once each; query rows with one id (also a null one)
    are one query. Queries without terms, or whose terms no document holds,
    give no rows. Queries go in blocks of bounded size, each against all shards.
    """
    spark = index.shards.sparkSession
    out = None
    for block in _blocks(queries, text, item_id, block_pairs):
        asked = np.unique(np.concatenate([t for _, t in block])) if block else np.zeros(0, np.uint64)
        df = _frequencies(index, asked) if len(asked) else {}
        weights = {t: weight(index.documents, n) for t, n in df.items()}
        items = [(i, [(t, weights[t]) for t in map(int, terms) if t in weights]) for i, terms in block]
        shared = spark.sparkContext.broadcast([(np.array([t for t, _ in q], "<u8"), [w for _, w in q]) for _, q in items])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for shard, ids, n, terms, ends, places, impact in rows_of(batches, "shard", "doc_ids", "postings", "terms", "ends", "places", "impacts"):
                own, end = np.frombuffer(terms, "<u8"), np.append(0, np.frombuffer(ends, "<u4").astype(np.int64))
                place, impact = _array(places, n, "<u4"), _array(impact, n, "<u4").astype(np.int64)
                got: list[tuple] = []
                for item, (q, w) in enumerate(shared.value):
                    score, at = np.zeros(len(ids), np.int64), np.searchsorted(own, q)
                    for j, x in enumerate(at):
                        if x < len(own) and own[x] == q[j]:
                            a, b = end[x], end[x + 1]
                            score[place[a:b]] += w[j] * impact[a:b]
                    got += [(item, ids[x], int(score[x])) for x in best(score, k)]
                cols = list(zip(*got)) or [()] * 3
                yield pa.record_batch({"shard": pa.array([shard] * len(got), pa.int64())} | {c: pa.array(v, pa.int64()) for c, v in zip(("item", "doc_id", "score"), cols)})

        found = index.shards.mapInArrow(run, "shard long, item long, doc_id long, score long").withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(MERGE)))
        found = _best_of(_best_of(found, k, "group"), k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item long, item_id long")  # one row a query of the block
        part = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    give_back()
    return out


_SQL_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
OP12_SQL = f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_SQL_TERMS} FROM documents) GROUP BY doc_id, term),
length AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM length),
item AS (SELECT DISTINCT item_id, {_SQL_TERMS} FROM benchmark),
weight AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus WHERE term IN (SELECT term FROM item)
),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // tokens)))) AS BIGINT) AS score
    FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN length USING (doc_id), corpus GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))
