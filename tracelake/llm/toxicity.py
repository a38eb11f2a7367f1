"""Toxicity by maximum-scoring segments.

Tokens score by their log-odds between toxic and other labelled documents with
an informative Dirichlet prior (Monroe, Colaresi, Quinn, 2008), less SOFT
standard errors. Prefixes of a token have log-odds too, so that compounds of
one stem share evidence, and the one that stands out most counts; a token of
which none does scores a small negative drift. A linear-time scan
(Ruzzo and Tompa, 1999) finds every maximal-scoring segment of a text. Segment
scores are normalised by the extreme-value law of Karlin and Altschul, fitted
on the scores of non-toxic tokens, and a logistic map turns the text's best
normalised score and its number of significant segments into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, BASE, SIGNS, bounded_sample, cut, give_back, held_out, mix, rows_of, shingles, table, words

MAX_TRAIN = 20_000  # labelled documents that the model is fitted on at most, about
PRIOR = 1.0  # weight of the Dirichlet prior, as a share of the toxic texts' tokens
DRIFT = -0.05
SOFT = 2.0  # standard errors that log-odds are shrunk by towards nought
PREFIXES = (4, 5, 6, 7, 8, 9, 10, 12)  # bytes; of tokens longer than that
NOTHING_KNOWN = -5.0  # log-odds of a text for a model that saw no labels
SIGNIFICANT = 0.01  # chance that a clean text of this length has such a segment


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) of a sequence, in order; linear time.

    Non-positive scores are summed between positive ones first.
    """
    good = np.flatnonzero(scores > 0)
    if not len(good):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # [first, end, sum before, sum after, earlier segment with a smaller sum before]
    for i in good.tolist():
        seg = [i, i + 1, total[i], total[i + 1], -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j = stack[j][4]
            seg[4] = j
            if j < 0 or stack[j][3] >= seg[3]:
                stack.append(seg)
                break
            seg = [stack[j][0], seg[1], stack[j][2], seg[3], -1]
            del stack[j:]
    return [(a, b, float(r - l)) for a, b, l, r, _ in stack]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of hashes for each token, of itself and its PREFIXES (0 where it is no longer than that), with its first byte and end byte."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    h, start, end = words(raw, separator=SIGNS)
    out = np.zeros((len(h), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = h
    data = _LOWER[np.frombuffer(raw, np.uint8)].astype(np.uint64)
    rows, x = np.arange(len(h)), np.zeros(len(h), np.uint64)
    for j in range(max(PREFIXES)):
        more = end[rows] - start[rows] > j + 1
        rows, x = rows[more], x[more]
        x = (x + data[start[rows] + j] + np.uint64(1)) * np.uint64(BASE)
        if j + 1 in PREFIXES:
            out[rows, 1 + PREFIXES.index(j + 1)] = mix(x)
    return out, start, end


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes of tokens and prefixes
    odds: np.ndarray
    strength: np.ndarray  # standard errors between the log-odds and nought
    rate: float  # lambda and K of the extreme-value law
    k: float
    weights: tuple[float, float, float]  # logistic: offset, best normalised score, significant segments

    def values(self, h: np.ndarray) -> np.ndarray:
        """For each row of ``features`` the place of its strongest one in ``tokens``, or -1."""
        at = np.searchsorted(self.tokens, h)
        at[at == len(self.tokens)] = 0
        known = self.tokens[at] == h
        best = np.where(known, self.strength[at], 0).argmax(axis=1)
        rows = np.arange(len(h))
        return np.where(known[rows, best], at[rows, best], -1)

    def scan(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], float, int]:
        """Segments (first byte, end byte, score, chance), the best normalised score, and the number that are significant."""
        h, start, end = features(text)
        if not len(h) or not len(self.tokens):
            return [], 0.0, 0
        at = self.values(h)
        found = segments(np.where(at >= 0, self.odds[at], DRIFT))
        if not found:
            return [], 0.0, 0
        size = math.log(max(self.k * len(h), 1e-9))
        out = [(int(start[a]), int(end[b - 1]), s, -math.expm1(-math.exp(min(50.0, size - self.rate * s)))) for a, b, s in found]
        return out, max(0.0, self.rate * max(s for *_, s in found) - size), sum(p <= SIGNIFICANT for *_, p in out)

    def probability(self, best: float, many: int) -> float:
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * min(best, 30.0) + c * min(many, 10)))))


def _key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a hash of three min-hashes of the five-word shingles, which most near copies share."""
    give_back()
    for batch in batches:
        low = [int(mix(np.array([sum(int(mix(s ^ np.uint64(m)).min()) for m in (0, 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)) % (1 << 64)], np.uint64)).view(np.int64)[0]) if len(s := shingles(words(t)[0], 5)) else 0 for t in batch.column("t").to_pylist()]
        yield pa.record_batch({"t": batch.column("t"), "y": batch.column("y"), "key": pa.array(low, pa.int64())})


def _distinct(rows: pa.Table) -> pa.Table:
    """Of the rows of one key and label, in the order of their texts, those that are no near copy (five words, similarity 0.8) of an earlier one: copies are one observation."""
    kept, sets = [], []
    for t in sorted({t or "" for t in rows.column("t").to_pylist()}):
        s = np.unique(shingles(words(t)[0], 5))
        if not any(5 * (n := len(np.intersect1d(s, x, assume_unique=True))) >= 4 * (len(s) + len(x) - n) for x in sets):
            kept.append(t)
            sets.append(s)
    return pa.table({"t": pa.array(kept, pa.string()), "y": pa.array([rows.column("y")[0].as_py()] * len(kept), pa.int32())})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token or prefix, toxic documents with it, other documents with it) of this part, and the numbers of documents at token 0."""
    seen: list[list[np.ndarray]] = [[], []]
    for text, y in rows_of(batches, "t", "y"):
        seen[y].append(np.setdiff1d(features(text)[0], np.zeros(1, np.uint64)))
    got = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint64), np.zeros(0, int)) for x in seen]
    token = np.union1d(got[0][0], got[1][0])
    n = [np.zeros(len(token) + 1, np.int64) for _ in got]
    for (h, c), out in zip(got, n):
        out[np.searchsorted(token, h)] = c
    n[0][-1], n[1][-1] = len(seen[0]), len(seen[1])
    yield pa.record_batch({"token": pa.array(np.r_[token, np.uint64(0)].astype(np.int64), pa.int64()), "clean": pa.array(n[0], pa.int64()), "toxic": pa.array(n[1], pa.int64())})


def karlin_altschul(odds: np.ndarray, chance: np.ndarray) -> float:
    """The positive root of sum(chance * exp(rate * odds)) = 1; the expected score must be negative."""
    low, high = 1e-6, 1.0
    f = lambda x: float(chance @ np.exp(np.minimum(x * odds, 700))) - 1
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MAX_TRAIN) -> Model:
    """Fit on about ``most`` labelled documents (``labels``: doc_id, toxic 0/1), chosen by a hash of doc_id.

    Null labels count for nothing, several of one id by their largest. Without
    both labels the model knows no token and scores every text alike, near 0:
    there is nothing to reject a text for.
    """
    y = bounded_sample(labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")), "doc_id", most)
    use = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).join(F.broadcast(y), "doc_id").select("t", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))
    use = cut(use.mapInArrow(_key, "t string, y int, key long").groupBy("key", "y").applyInArrow(_distinct, "t string, y int"))
    counts = use.mapInArrow(_count, "token long, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = cut(counts)
    docs_of = counts.filter("token = 0").select("clean", "toxic").first()
    n0, n1 = counts.filter("token <> 0").agg(F.sum("clean"), F.sum("toxic")).first()
    if not docs_of or not docs_of[0] or not docs_of[1] or not n0 or not n1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 1.0, 1.0, (NOTHING_KNOWN, 0.0, 0.0))
    weight = PRIOR * n1
    prior = weight * (F.col("clean") + F.col("toxic")) / (n0 + n1)
    a1, a0 = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a1 / (n1 + weight - a1)) - F.log(a0 / (n0 + weight - a0))
    scored = counts.filter("token <> 0").select("token", odds.alias("odds"), (odds / F.sqrt(1 / a1 + 1 / a0)).alias("z"))
    kept = scored.filter(F.abs("z") > SOFT).toArrow()  # of the tokens of about ``most`` documents
    tokens = kept.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    tokens, strength = tokens[order], np.abs(kept.column("z").to_numpy()[order])
    values = kept.column("odds").to_numpy()[order] * (1 - SOFT / strength)
    model = Model(tokens, values, strength, 1.0, 1.0, (0.0, 1.0, 0.0))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(tokens) + 1, np.int64)
        for text, y in rows_of(batches, "t", "y"):
            if not y and len(tokens):
                n += np.bincount(model.values(features(text)[0]) + 1, minlength=len(n))
        yield pa.record_batch({"at": pa.array(np.flatnonzero(n) - 1, pa.int64()), "n": pa.array(n[n > 0], pa.int64())})

    clean = np.zeros(len(tokens) + 1)
    for r in use.mapInArrow(tally, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        clean[r["at"]] = r["n"]  # the last place is that of tokens that score the drift
    if (values > 0).any():
        model.rate = karlin_altschul(np.r_[values, DRIFT], clean / max(clean.sum(), 1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.scan(t)[1:] for t in batch.column("t").to_pylist()]
            yield pa.record_batch({"best": pa.array([g[0] for g in got], pa.float64()), "many": pa.array([g[1] for g in got], pa.int64()), "y": batch.column("y")})

    # K: the law's mean over the clean texts that have a segment is Euler's constant
    seen = cut(use.mapInArrow(scan, "best double, many long, y int"))
    shift = seen.filter("y = 0 AND best > 0").agg(F.percentile_approx("best", 0.5)).first()[0]
    model.k = math.exp(max(-20.0, min(20.0, (shift or 0.3665) - 0.3665)))
    rows = use.mapInArrow(scan, "best double, many long, y int").groupBy(F.round(F.least("best", F.lit(30.0)), 1).alias("best"), F.least("many", F.lit(10)).alias("many")).agg(F.sum(F.col("y")).alias("y"), F.count("*").alias("n")).collect()
    x = np.array([[1.0, r["best"], r["many"]] for r in rows for _ in (0, 1)])
    y = np.array([t for _ in rows for t in (0.0, 1.0)])
    w = np.array([c for r in rows for c in (r["n"] - r["y"], r["y"])], float)
    model.weights = tuple(_logistic(x, y, w))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic regression of rows that stand for n cases each."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + 1e-1 * np.eye(x.shape[1]), x.T @ (n * (y - p)) - 1e-1 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, score, predicted (1 if score >= threshold), passages.

    ``passages`` are the significant segments (start, end in code points, the
    segment's score and chance). Whole texts of any length; null and empty
    texts score as a text without any toxic token. Repeated rows get equal
    answers; no documents give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, passages = [], []
            for t in batch.column("text").to_pylist():
                found, best, many = m.scan(t)
                scores.append(m.probability(best, many))
                raw = t.encode("utf-8", "surrogatepass") if many else b""
                place = lambda i: len(raw[:i].decode("utf-8", "replace"))  # noqa: B023, E731
                passages.append([{"start": place(a), "end": place(b), "score": s, "chance": p} for a, b, s, p in found if many and p <= SIGNIFICANT])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32()), "passages": pa.array(passages, passage)})

    schema = "doc_id long, score double, predicted int, passages array<struct<start: long, end: long, score: double, chance: double>>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents below ``threshold``, with all their columns; decided row by row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([m.probability(*m.scan(t)[1:]) < threshold for t in batch.column(place).to_pylist()], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id")).select("doc_id", "toxic")
    return score(docs, train(docs, labels)).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
