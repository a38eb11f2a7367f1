"""Packing tokenised documents into fixed-length sequences as a cutting-stock problem.

Documents are cut at multiples of the capacity, and the rest at half of it;
what remains are items. Item lengths form a histogram of a few hundred classes. A linear program over
patterns (how many items of each class share a sequence) minimises the number
of sequences; its columns are generated by a knapsack dynamic program that
prices patterns with the dual values (Gilmore and Gomory, 1961). Patterns are
rounded down, what is left is packed first-fit decreasing, and the ranked
items of each class are dealt to the patterns. The driver only ever holds the
histogram and the patterns, whose size depends on the capacity alone.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHES, batches_of, cut, give_back, rows_of, table

CAPACITY = 2048
END_ID = 1
JOINED = 1_000  # words encoded as one text
BATCH_ROWS = 1_000  # documents that Python holds at once
RANK_CHUNK = 2_000  # items ranked in one window
GAP = 0.002  # the linear program stops within this share of its bound

# ------------------------------------------------------------------ tokens

_PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])  # in Latin-1
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


class WordCache:
    """Ids of texts by a lower-casing word BPE tokenizer, word by word where that is the same thing.

    Texts of Latin-1 letters, digits and signs are split as the tokenizer's own
    pre-tokenizer splits them and each distinct word is encoded once (the first
    ``most`` words stay for later calls); any other
    text, or one with a special token's opening, goes to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.ids, self.most = Tokenizer.from_file(path), {}, most

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        pack = lambda e: array("I", e.ids).tobytes()
        lists = [_WORD.findall(t.lower()) if _plain(t) else None for t in texts]
        new = list(set().union(*(x for x in lists if x)).difference(self.ids))
        for i in range(0, len(new), JOINED):
            some = new[i : i + JOINED]
            self.ids.update(zip(some, self._each(some)))
        out = [b"".join(map(self.ids.__getitem__, x)) if x is not None else pack(self.tokenizer.encode(t, add_special_tokens=False)) for x, t in zip(lists, texts)]
        if len(self.ids) > self.most:
            for w in new:
                del self.ids[w]
        return out

    def _each(self, words: list[str]) -> list[bytes]:
        """Ids of each word: of all as one text, cut where the tokenizer's own words end; one by one if those aren't these."""
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        at = e.word_ids
        if None in at or len(set(at)) != len(words):
            return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ids, ends = array("I", e.ids).tobytes(), (4 * np.searchsorted(np.array(at), np.arange(len(words)), side="right")).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


_caches: dict[str, WordCache] = CACHES.setdefault("packing", {})


def _cache(path: str) -> WordCache:
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Each document's ids with END_ID after them, cut at multiples of ``capacity``.

    What remains is cut once more at half the capacity if it is longer, so
    that every item has partners. Null text counts as empty (one piece: END_ID). Columns doc_id, start,
    length, ids_crc32, doc_tokens and, if asked for, ids (little-endian
    unsigned 32-bit).
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back("packing")
        cache, end = _cache(tokenizer or default_tokenizer()), array("I", [END_ID]).tobytes()

        def emit(held: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            for (doc, _), ids in zip(held, cache.encode([t for _, t in held])):
                ids += end
                last = len(ids) // 4 % capacity
                half = [len(ids) - 4 * last + 4 * (capacity // 2)] if last > capacity // 2 else []
                bounds = [*range(0, len(ids), 4 * capacity), *half, len(ids)]
                for a, b in zip(bounds, bounds[1:]):
                    part = ids[a:b]
                    out.append((doc, a // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part)[: 5 + keep_ids])
            cols = list(zip(*out, strict=True))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep_ids]
            return pa.record_batch({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in zip(names, cols)})

        held, size = [], 0
        for doc, t in rows_of(batches, "doc_id", "text"):
            held.append((doc, t or ""))
            size += len(t or "")
            if size > 1 << 20 or len(held) >= 2000:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


# ------------------------------------------------------------------ the plan


def size_classes(capacity: int) -> list[int]:
    """Upper ends of the length classes: a 512th of the capacity apart."""
    step = max(1, capacity // 512)
    return [min(x, capacity) for x in range(step, capacity + step, step)]


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of any number of each item within capacity, and how many of each."""
    unit = int(np.gcd.reduce([*sizes, capacity]))
    sizes, capacity = sizes // unit, capacity // unit
    use = np.flatnonzero(values > 1e-12)
    s, v = sizes[use], values[use]
    order = np.argsort(s, kind="stable")
    use, s, v = use[order], s[order], v[order]
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            x = v[:k] + best[c - s[:k]]
            j = x.argmax()
            if x[j] > best[c] + 1e-12:
                best[c], pick[c] = x[j], j
    count, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            count[use[pick[c]]] += 1
            c -= s[pick[c]]
    return float(best[capacity]), count


def cutting_stock(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; together they hold exactly ``demand`` items."""
    s, d = np.array(sizes), np.array(demand, float)
    m = len(s)
    if not m:
        return []
    columns = np.diag(capacity // s).astype(float)
    inverse, x = np.diag(1.0 / np.diag(columns)), d / np.diag(columns)
    for _ in range(20 * m + 200):
        y = inverse.sum(axis=0)
        value, a = knapsack(s, y, capacity)
        total = x.sum()
        if value <= 1 + 1e-9 or total - total / value < max(GAP * total, 0.5):
            break  # total / value bounds the optimum from below (Farley)
        w = inverse @ a
        ratio = np.where(w > 1e-9, x / np.where(w > 1e-9, w, 1), np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        x = np.maximum(x - step * w, 0)
        x[r] = step
        inverse[r] /= w[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(w[others], inverse[r])
        columns[:, r] = a
    left = np.array(demand, int)
    used: list[tuple[np.ndarray, int]] = []
    for j in np.argsort(-x, kind="stable"):
        a = columns[:, j].astype(int)
        n = int(min([x[j] + 1e-9, *(left[a > 0] // a[a > 0])])) if a.any() else 0
        if n > 0:
            used.append((a, n))
            left = left - n * a
    open_: list[list] = []  # first-fit decreasing by whole runs of equal sequences
    while left.any():
        room, a = capacity, np.zeros(m, int)
        for b in np.argsort(-s, kind="stable"):
            k = min(int(left[b]), room // s[b])
            a[b] = k
            room -= k * s[b]
        n = int(min(left[a > 0] // a[a > 0]))
        open_.append([a, n])
        left = left - n * a
    return used + [(a, n) for a, n in open_]


def _deal(ends: list[int], used: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, items a sequence, first sequence) of each pattern's share of each class."""
    at, out, sequence = dict.fromkeys(range(len(ends)), 0), [], 0
    for a, n in used:
        for b in np.flatnonzero(a):
            out.append((int(ends[b]), at[b], at[b] + n * int(a[b]), int(a[b]), sequence))
            at[b] += n * int(a[b])
        sequence += n
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset.

    Every id of every document (null text: empty, so END_ID alone) lies in one
    piece, no sequence exceeds ``capacity``, offsets are gapless from 0. Rows
    repeated or with a null id are packed like any other. No documents give no
    rows.
    """
    spark = docs.sparkSession
    ends = size_classes(capacity)
    with batches_of(spark, BATCH_ROWS):
        items = cut(pieces(docs, capacity, tokenizer, text, doc_id, keep_ids))
    step = ends[0]
    up = F.least(F.ceil(F.col("length") / step) * step, F.lit(capacity))
    items = items.withColumn("class", up.cast("long"))
    histogram = {r["class"]: r["n"] for r in items.groupBy("class").agg(F.count("*").alias("n")).collect()}
    sizes = sorted(k for k in histogram if k < capacity)
    used = cutting_stock(sizes, [histogram[k] for k in sizes], capacity)
    shares = _deal(sizes, used)
    if capacity in histogram:
        shares.append((capacity, 0, histogram[capacity], 1, sum(n for _, n in used)))
    chunks = spark.createDataFrame([(k, max(1, n // RANK_CHUNK)) for k, n in histogram.items()], "class long, chunks long")
    items = items.join(F.broadcast(chunks), "class").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start"), F.col("chunks"))).drop("chunks")
    counts = items.groupBy("class", "chunk").agg(F.count("*").alias("n"))
    before = cut(counts.select("class", "chunk", (F.sum("n").over(Window.partitionBy("class").orderBy("chunk")) - F.col("n")).alias("before")))
    own = F.row_number().over(Window.partitionBy("class", "chunk").orderBy("doc_id", "start")) - 1
    ranked = items.withColumn("own", own).join(before, ["class", "chunk"]).withColumn("rank", F.col("own") + F.col("before"))
    deal = spark.createDataFrame(shares, "class long, first long, last long, each long, sequence long")
    placed = ranked.join(F.broadcast(deal), (ranked["class"] == deal["class"]) & (ranked["rank"] >= deal["first"]) & (ranked["rank"] < deal["last"]))
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("each")).cast("long"))
    w = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids, "sequence_id", (F.sum("length").over(w) - F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence in order, from ``pack(keep_ids=True)``; at most the capacity each."""
    part = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(part.alias("p")).select("sequence_id", F.expr("aggregate(p, X'', (x, y) -> concat(x, y.ids))").alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)
