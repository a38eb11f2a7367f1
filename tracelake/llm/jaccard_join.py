"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct n-word shingles. Sizes fall into bands
[l, r] with r = floor(l / t), so that sets of similarity >= t lie in the same
or in neighbouring bands; sets of such a pair of bands differ in at most
k = floor(r (1 - t) / t) features. PartEnum (Arasu, Ganti, Kaushik, VLDB 2006)
splits the feature domain into n1 = ceil((k + 1) / 2) parts, of which one has
at most one difference, and each part into three, of which two then agree: a
set signs every choice of two of three in every part, and two sets within k
differences share a signature, always. Two thirds without a feature would be
signed alike by unrelated sets; so there are a few parts more than that proof
needs, and a set signs such thirds only if it has more parts with them than
that surplus (one of its other parts meets every similar set otherwise).

Equal sets become one class first. A first pass turns shared signatures into
few pairs per document, verified exactly; links give components. A second pass
over the documents of these pairs finds each signature that still spans two
components, and verifies every pair across them, so no link between components
is lost; documents of a signature that many share must have one of their rarest
features in common, too. Signatures are combined per task before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, attach, batches_of, bounded_sample, cut, give_back, min_label, mix, release, rows_of, shingles, table, words

FLUSH = 1 << 19  # signatures combined in a task at once
A_BUCKET = 1_000_000  # signatures a reduce group gets on average
SKETCH = 256
SMALL = 16  # documents of a signature whose pairs the second pass forms one by one
GROUP_DOCS = 256  # documents of a larger one that a task compares with as many, on average
LEAST = 16  # of a document's signatures by which a pair is told to have met before
SLOTS = 1 << 21  # counters that tell common features from rare ones
RANKED = 20_000  # documents that these are counted over, about
BATCH_ROWS = 500  # documents or pairs of sets that Python holds at once
BROADCAST_BYTES = 32 << 20
_SIG_BYTES = 6  # a signature is cut to 48 bits; a chance meeting is verified like any other


def feature_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(shingles(words(text)[0], n))


def sketch(features: np.ndarray) -> np.ndarray:
    """How many features fall in each of SKETCH classes (255 at most): sums of differences bound the sets' difference from below."""
    return np.minimum(np.bincount(((features >> np.uint64(8)) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8)


class PartEnum:
    """Bands and signatures for Jaccard similarity >= num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ends = [1]
        self._grow(1 << 20)

    def _grow(self, size: int) -> None:
        while self.ends[-1] < size:
            self.ends.append((self.ends[-1] + 1) * self.den // self.num)

    def per_feature(self) -> float:
        """Signatures for each feature of a large set, about."""
        return 2 * 1.5 * (self.den - self.num) / self.num

    def signatures(self, features: np.ndarray) -> np.ndarray:
        self._grow(len(features))
        band = int(np.searchsorted(self.ends, len(features)))
        g = (features * np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)
        third = (features & np.uint64(0xFFFF)) % np.uint64(3)
        out = []
        for i in (band - 1, band):
            k = self.ends[i] * (self.den - self.num) // self.num if i >= 0 else 0
            if not k:
                continue  # only equal sets link
            n1 = (k + 2) // 2
            spare = n1 // 16
            n1 += spare  # so in at least 1 + spare parts two similar sets differ once at most
            cells = np.zeros(3 * n1, np.uint64)
            np.add.at(cells, (((g * np.uint64(n1)) >> np.uint64(32)) * np.uint64(3) + third).astype(np.int64), features)
            cells = cells.reshape(n1, 3)
            bare = (cells != 0).sum(axis=1) < 2  # some choice of two thirds holds no feature
            mute = bare if bare.sum() <= spare else None
            tag = np.arange(n1, dtype=np.uint64) * np.uint64(3) + np.uint64((i << 32) + 1)
            for drop, (a, b) in enumerate(((1, 2), (0, 2), (0, 1))):
                sig = mix(mix(cells[:, a] + np.uint64(1)) * np.uint64(3) + mix(cells[:, b] + np.uint64(2)) + mix(tag + np.uint64(drop)))
                out.append(sig if mute is None else sig[(cells[:, a] != 0) | (cells[:, b] != 0)])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def possible(self, size: int, sketch: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> np.ndarray:
        """Whether sets can be similar by their sizes and sketches; never false for sets that are."""
        fits = self.den * np.minimum(size, sizes) >= self.num * np.maximum(size, sizes)
        apart = np.abs(sketches.astype(np.int16) - sketch.astype(np.int16)).sum(axis=-1, dtype=np.int64)
        return fits & ((self.den + self.num) * apart <= (self.den - self.num) * (size + sizes))

    def rarest(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The first ``len - ceil(t len) + 1`` features in the order of their slots' counts: linked sets have one of these in common, whatever the counts (the prefix filter)."""
        first = len(features) - -(-self.num * len(features) // self.den) + 1
        return features[np.lexsort((features, counts[features % np.uint64(len(counts))]))[:first]]

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if self.den * min(len(a), len(b)) < self.num * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)


def _short(sig: np.ndarray) -> bytes:
    return np.ascontiguousarray(sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SIG_BYTES]).tobytes()


def _long(parts: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, _SIG_BYTES)
    full = np.zeros((len(x), 8), np.uint8)
    full[:, :_SIG_BYTES] = x
    return full.reshape(-1).view("<u8").astype(np.uint64)


_CUT = np.uint64((1 << (8 * _SIG_BYTES)) - 1)


def _dealt(sig: np.ndarray, values: list[np.ndarray], buckets: int):
    """Rows (bucket, signatures, values...) of sorted signatures, one for each bucket."""
    bucket = (mix(sig) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(edges, [*edges[1:], len(bucket)]):
        yield int(bucket[a]), _short(sig[order[a:b]]), *(v[order[a:b]].astype("<i8").tobytes() for v in values)


def _pairs_in(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of equal signatures: neighbours by id as pairs, with counts; and (signature, least id) of each."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    same = (sig[1:] == sig[:-1]) & (ids[1:] != ids[:-1])
    a, b = ids[1:][same], ids[:-1][same]
    first = np.r_[True, sig[1:] != sig[:-1]] if len(sig) else np.zeros(0, bool)
    if len(a):
        pairs, n = np.unique(np.stack([a, b], 1), axis=0, return_counts=True)
    else:
        pairs, n = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    return pairs, n, sig[first], ids[first]


def _sign(pe: PartEnum, n: int, buckets: int):
    """Map side of the first pass: id, text -> blobs of (signature, least id here) and pairs found here."""

    def flush(sigs, ids):
        pairs, count, sig, low = _pairs_in(np.concatenate(sigs) & _CUT, np.concatenate(ids))
        rows = [(k, s, v, None, None, None) for k, s, v in _dealt(sig, [low], buckets)]
        if len(pairs):
            rows.append((int(pairs[0, 0]) % buckets, None, None, *(x.astype("<i8").tobytes() for x in (pairs[:, 0], pairs[:, 1], count))))
        cols = list(zip(*rows, strict=True))
        return pa.record_batch({"bucket": pa.array(cols[0], pa.int64())} | {k: pa.array(v, pa.binary()) for k, v in zip(("sig", "low", "a", "b", "n"), cols[1:])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids, held = [], [], 0
        for doc, text in rows_of(batches, "id", "text"):
            s = pe.signatures(feature_set(text, n))
            if not len(s):
                continue
            sigs.append(s)
            ids.append(np.full(len(s), doc, np.int64))
            held += len(s)
            if held >= FLUSH:
                yield flush(sigs, ids)
                sigs, ids, held = [], [], 0
        if held:
            yield flush(sigs, ids)

    return run


def _meet(t):
    """Reduce side of the first pass: pairs (a, b, n) of one bucket."""
    got = [(s, v) for s, v in zip(t.column("sig").to_pylist(), t.column("low").to_pylist()) if s]
    out = [[np.frombuffer(x, "<i8") for x in row] for row in zip(*(t.column(c).to_pylist() for c in "abn")) if row[0]]
    if got:
        pairs, n, _, _ = _pairs_in(_long([s for s, _ in got]), np.frombuffer(b"".join(v for _, v in got), "<i8"))
        out.append([pairs[:, 0], pairs[:, 1], n])
    a, b, n = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ())))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def _spread(sign, buckets: int):
    """Map side of the second pass: (set, component) -> blobs of (signature, least and greatest component here); ``sign`` gives a set's signatures."""

    def flush(sigs, comps):
        sig, comp = np.concatenate(sigs) & _CUT, np.concatenate(comps)
        order = np.lexsort((comp, sig))
        sig, comp = sig[order], comp[order]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        last = np.r_[first[1:], len(sig)] - 1
        cols = list(zip(*_dealt(sig[first], [comp[first], comp[last]], buckets), strict=True))
        return pa.record_batch({"bucket": pa.array(cols[0], pa.int64())} | {k: pa.array(v, pa.binary()) for k, v in zip(("sig", "low", "high"), cols[1:])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, comps, held = [], [], 0
        for blob, comp in rows_of(batches, "features", "component"):
            s = sign(np.frombuffer(blob, np.uint64))
            if not len(s):
                continue
            sigs.append(s)
            comps.append(np.full(len(s), comp, np.int64))
            held += len(s)
            if held >= FLUSH:
                yield flush(sigs, comps)
                sigs, comps, held = [], [], 0
        if held:
            yield flush(sigs, comps)

    return run


def _mixed(t):
    """Signatures of one bucket that more than one component has."""
    sig = _long(t.column("sig").to_pylist())
    low, high = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<i8") for c in ("low", "high"))
    order = np.argsort(sig, kind="stable")
    sig, low, high = sig[order], low[order], high[order]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, int)
    bad = np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first) if len(sig) else np.zeros(0, bool)
    return pa.table({"sig": pa.array(sig[first][bad].astype(np.int64), pa.int64())})


def _held(own: DataFrame, sign, buckets: int) -> DataFrame | None:
    """(sig, id, component) of the signatures that more than one component of ``own`` (id, component, features) has; None if there are none."""
    spark = own.sparkSession
    blobs = own.select("features", "component").mapInArrow(_spread(sign, buckets), "bucket long, sig binary, low binary, high binary")
    mixed = cut(blobs.groupBy("bucket").applyInArrow(_mixed, "sig long"))
    release(spark)
    spanning = mixed.count()
    if not spanning:
        return None
    small = spanning * 8 <= BROADCAST_BYTES // 4
    wanted = spark.sparkContext.broadcast(np.sort(mixed.toArrow().column("sig").to_numpy()) if small else None)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, comp, blob in rows_of(batches, "id", "component", "features"):
            s = np.unique(sign(np.frombuffer(blob, np.uint64)) & _CUT).astype(np.int64)
            if wanted.value is not None:
                at = np.minimum(np.searchsorted(wanted.value, s), len(wanted.value) - 1)
                s = s[wanted.value[at] == s]
            yield pa.record_batch({"sig": pa.array(s, pa.int64()), "id": pa.array(np.full(len(s), doc), pa.int64()), "component": pa.array(np.full(len(s), comp), pa.int64())})

    held = own.select("id", "component", "features").mapInArrow(explode, "sig long, id long, component long")
    held = cut(held if small else held.join(mixed, "sig", "left_semi"))
    release(spark)
    return held


def _rare_first(pe: PartEnum, own: DataFrame):
    """``pe.rarest`` by how many of RANKED documents of ``own`` have a feature.

    What unrelated documents share, a passage or a line, is so left out unless
    a set has little else. Counts decide the order alone, never a link, so a
    sample will do and slots may be shared.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for (blob,) in rows_of(batches, "features"):
            np.add.at(n, (np.frombuffer(blob, np.uint64) % np.uint64(SLOTS)).astype(np.int64), 1)
        yield pa.record_batch({"n": pa.array([np.minimum(n, 65535).astype("<u2").tobytes()], pa.binary())})

    some = bounded_sample(own.select("id", "features"), "id", RANKED).select("features").repartition(4)
    counts = sum((np.frombuffer(r["n"], "<u2").astype(np.uint32) for r in some.mapInArrow(count, "n binary").collect()), np.zeros(SLOTS, np.uint32))
    common = own.sparkSession.sparkContext.broadcast(np.minimum(counts, 65535).astype(np.uint16))

    return lambda features: pe.rarest(features, common.value)


def _verify(pe: PartEnum):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("fa", "fb"))
            ok = [pe.linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "ok": pa.array(ok, pa.bool_())})
        give_back()

    return run


def _prune(pe: PartEnum):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.array(batch.column(c).to_pylist(), np.int64) for c in ("na", "nb")]
            s = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sa", "sb")]
            yield batch.filter(pa.array(pe.possible(n[0], s[0], n[1], s[1]), pa.bool_())).select([x for x in batch.schema.names if x not in ("na", "nb", "sa", "sb")])

    return run


def _possible(pe: PartEnum, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, ...) whose sizes and sketches allow a link."""
    left = sets.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("sb"))
    schema = ", ".join(f"{n} {t}" for n, t in pairs.dtypes)
    return pairs.join(left, "a").join(right, "b").select(*pairs.columns, "na", "sa", "nb", "sb").mapInArrow(_prune(pe), schema)


def _with_sizes(held: DataFrame, some: DataFrame) -> DataFrame:
    """The rows of ``held`` whose signature is in ``some`` (sig, docs), with ``docs``."""
    return attach(held, some, "sig", "docs", held.count()).filter("docs IS NOT NULL")


def _across(pe: PartEnum, held: DataFrame, sets: DataFrame, own: DataFrame, buckets: int) -> DataFrame:
    """Pairs (a, b) across components that share a signature of ``held`` (sig, id, component) and that sketches allow.

    Signatures of few documents give their pairs one by one. The documents of
    larger ones (of ``own``: id, component, features) are signed once more, by
    their rarest features, so that those which merely share a common passage
    don't meet; see ``_within_groups``.
    """
    size = cut(held.groupBy("sig").agg(F.count("*").alias("docs"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("sig", "docs"))
    few = held.join(size.filter(F.col("docs") <= SMALL).select("sig"), "sig")
    x, y = (few.select("sig", F.col("id").alias(i), F.col("component").alias(c)) for i, c in (("p", "cp"), ("q", "cq")))
    pairs = x.join(y, (x["sig"] == y["sig"]) & (x["cp"] < y["cq"])).select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()
    out = _possible(pe, pairs, sets)
    big = size.filter(F.col("docs") > SMALL)
    if not big.limit(1).count():
        return out
    ids = cut(_with_sizes(held, big).select("id").distinct())
    docs = cut(within(own, ids, ids.count(), "id"))
    rare = _held(docs, _rare_first(pe, docs), buckets)
    return out if rare is None else out.unionByName(_within_groups(pe, rare, sets)).distinct()


def _within_groups(pe: PartEnum, held: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) across components of the signatures of ``held`` (sig, id, component) that sketches allow.

    The documents of a signature are split into groups of about GROUP_DOCS,
    and each pair of groups, or one group by itself, is a row of its own, so a
    very large signature is dealt out over tasks. A task compares the sketches
    of a row's documents where they are, without a row for each pair. Similar
    documents share many signatures; a pair counts only where no lesser one is
    among the LEAST least of both, so it comes for its least common one always,
    and hardly ever again.
    """
    size = cut(held.groupBy("sig").agg(F.count("*").alias("docs")))
    placed = _with_sizes(held, size).withColumn("groups", F.ceil(F.col("docs") / GROUP_DOCS).cast("int"))
    placed = placed.select("sig", "id", "component", "groups", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("own"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    cells = each.select("sig", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "component")
    least = held.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("sig")), 1, LEAST).alias("least"))
    docs = F.collect_list(F.struct("own", "id", "component", "size", "sketch", "least")).alias("docs")
    rows = cells.join(sets.select("id", "size", "sketch").join(least, "id"), "id").groupBy("sig", "p", "q").agg(docs, F.min("component").alias("low"), F.max("component").alias("high"))
    rows = rows.filter("low <> high").select("sig", "p", "q", "docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1) for b in batches for i in range(len(b))):
            (sig, p, q), v = (batch.column(c)[0].as_py() for c in ("sig", "p", "q")), batch.column("docs").flatten()
            part, ids, comp, n = (v.field(c).to_numpy(zero_copy_only=False) for c in ("own", "id", "component", "size"))
            sk = np.frombuffer(b"".join(v.field("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            before = np.full((len(ids), LEAST), -1, np.int64)
            for i, x in enumerate(v.field("least").to_pylist()):
                x = [y for y in x if y < sig]
                before[i, : len(x)] = x
            order = np.lexsort((n, part))
            part, ids, comp, n, sk, before = part[order], ids[order], comp[order], n[order], sk[order], before[order]
            right = np.flatnonzero(part == q)
            found = []
            for i in np.flatnonzero(part == p):
                a = right if p < q else right[right > i]
                lo, hi = np.searchsorted(n[a], (-(-pe.num * n[i] // pe.den), pe.den * n[i] // pe.num + 1))
                j = a[lo:hi]
                j = j[(comp[j] != comp[i]) & (ids[j] != ids[i])]
                if len(j):
                    j = j[pe.possible(n[i], sk[i], n[j], sk[j])]
                    met = before[i][before[i] >= 0]
                    j = j[~np.isin(before[j], met).any(axis=1)]
                    found.append(np.stack([np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])]))
            if found:
                a, b = np.concatenate(found, axis=1)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        give_back()

    with batches_of(held.sparkSession, 16):
        return cut(rows.mapInArrow(run, "a long, b long"))


def without(docs: DataFrame, ids: DataFrame, count: int, column: str) -> DataFrame:
    """Documents whose id isn't in ``ids``: looked up where they lie if the ids are small, else by a shuffle."""
    return docs.join(F.broadcast(ids) if count * 16 <= BROADCAST_BYTES else ids, column, "left_anti")


def within(docs: DataFrame, ids: DataFrame, count: int, column: str) -> DataFrame:
    return docs.join(F.broadcast(ids) if count * 16 <= BROADCAST_BYTES else ids, column, "left_semi")


def components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: id, n_shingles, component (least id reachable by links).

    Two documents link when den * |A n B| >= num * |A u B| for their sets of
    n-word shingles; one with fewer words has its whole sequence as its only
    shingle; one without words is linked with nothing. Null text counts as
    empty; a row with a null id gets itself (null). Rows repeated with one id
    are one document if their sets are equal. No documents give no rows.
    """
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _components(docs, n, num, den, text, doc_id)


def _components(docs: DataFrame, n: int, num: int, den: int, text: str, doc_id: str) -> DataFrame:
    spark = docs.sparkSession
    pe = PartEnum(num, den)
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            size, x, y = [], [], []
            for t in batch.column("text").to_pylist():
                f = feature_set(t, n)
                size.append(len(f))
                x.append(int(mix(f).sum(dtype=np.uint64).view(np.int64)) if len(f) else 0)
                y.append(int(mix(f ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(f) else 0)
            yield pa.record_batch({"id": batch.column("id"), "n_shingles": pa.array(size, pa.int64()), "x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})
        give_back()

    measured = cut(src.mapInArrow(measure, "id long, n_shingles long, x long, y long"))
    full = measured.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = cut(full.groupBy("x", "y").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("size")))
    total, reps, features = classes.agg(F.sum("copies"), F.count("*"), F.sum("size")).first()
    if not total:
        return measured.select("id", "n_shingles", F.col("id").alias("component"))
    repeated = classes.filter("copies > 1").select("x", "y", "rep", "copies").withColumn("key", F.struct("x", "y"))
    repeated = cut(repeated.select("key", "rep", "copies"))
    keyed = measured.withColumn("key", F.when(F.col("n_shingles") > 0, F.struct("x", "y")))
    member = cut(attach(keyed, repeated, "key", "copies", total).select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")))
    spare = member.filter("id <> rep OR n_shingles = 0").select("id").distinct()
    distinct = without(src.filter("id IS NOT NULL"), spare, total - reps + 1, "id")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, math.ceil(features * pe.per_feature() / A_BUCKET))
    blobs = distinct.mapInArrow(_sign(pe, n, buckets), "bucket long, sig binary, low binary, a binary, b binary, n binary")
    pairs = cut(blobs.groupBy("bucket").applyInArrow(_meet, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    near = ends.count()
    if not near:
        return member.select("id", "n_shingles", F.col("rep").alias("component"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [feature_set(t, n) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"id": batch.column("id"), "size": pa.array([len(x) for x in f], pa.int64()), "features": pa.array([x.tobytes() for x in f], pa.binary()), "sketch": pa.array([sketch(x).tobytes() for x in f], pa.binary())})
        give_back()

    release(spark)
    sets = cut(within(distinct, ends, near, "id").mapInArrow(pack, "id long, size long, features binary, sketch binary").dropDuplicates(["id"]))
    release(spark)
    likely = cut(_possible(pe, pairs, sets))
    release(spark)

    def verified(some: DataFrame) -> DataFrame:
        some = some.select("a", "b")
        ids = some.select(F.col("a").alias("id")).union(some.select("b")).distinct()
        own = within(sets.select("id", "features"), ids, 2 * some.count(), "id")
        left = own.select(F.col("id").alias("a"), F.col("features").alias("fa"))
        right = own.select(F.col("id").alias("b"), F.col("features").alias("fb"))
        out = cut(some.join(left, "a").join(right, "b").select("a", "b", "fa", "fb").mapInArrow(_verify(pe), "a long, b long, ok boolean"))
        release(spark)
        return out

    def labels(links: DataFrame) -> DataFrame:
        found = min_label(links)
        return cut(ends.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))

    def across(some: DataFrame, label: DataFrame) -> DataFrame:
        x = label.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        y = label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        return some.join(x, "a").join(y, "b").filter("ca <> cb")

    best = cut(likely.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")))
    done = verified(best)
    links = done.filter("ok")
    label = labels(links)
    rest = cut(across(likely, label).join(done, ["a", "b"], "left_anti").groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")))
    if rest.count():
        links = links.unionByName(verified(rest).filter("ok"))
        label = labels(links)

    release(spark)
    own = sets.join(label, "id")
    held = _held(own, pe.signatures, buckets)
    if held is not None:
        more = verified(cut(_across(pe, held, sets, own, buckets).join(done, ["a", "b"], "left_anti")))
        if more.filter("ok").count():
            label = labels(links.unionByName(more.filter("ok")))
    joined = cut(label.filter("id <> component"))
    low = F.coalesce("component", "rep").alias("component")
    sizes = cut(classes.groupBy("rep").agg(F.sum("copies").alias("copies")))
    moved = joined.withColumnRenamed("id", "rep").join(sizes, "rep").select("rep", "component", "copies")
    large = sizes.filter(F.col("copies") > total // HOT_KEYS).join(moved.select("rep"), "rep", "left_anti")  # few; else their rows would meet in the join
    return attach(member, moved.unionByName(large.select("rep", F.col("rep").alias("component"), "copies")), "rep", "copies", total).select("id", "n_shingles", low)


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with all their columns, of each component the one with the least id.

    Rows with a null id are kept, as are all rows of a kept id.
    """
    found = cut(components(docs, n, num, den, text, doc_id).filter("id <> component").select(F.col("id").alias(doc_id)).distinct())
    return without(docs, found, found.count(), doc_id).select(*docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, num=90, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
