"""Secret scan: fixed patterns, and a character convolutional network over candidates.

Three patterns give the base findings. Every run of token characters with a
digit, or with a capital after a small letter, is a candidate; a convolutional
network in numpy reads all of the candidate, in windows, and its surroundings;
the window that looks most like a secret counts. It is trained on labelled findings (candidates that the
patterns mark against all others), its output calibrated by Platt's method on
candidates held back, and the threshold is one half, or less where the wanted
recall of held-back findings needs it. Candidates over it that touch no base span are
added as kind ``model``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, rows_of, table

KINDS = ("assign", "access", "hex", "model")
BEFORE, CORE, AFTER = 24, 56, 8  # characters of a window: before, of the candidate, after
WIDTHS, FILTERS, EMBED = (3, 5), 12, 8
LEAST = 12  # characters of a candidate
MAX_TRAIN_DOCS, MAX_TRAIN = 20_000, 20_000  # documents scanned and candidates fitted on at most, about
RECALL = 0.99

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]*")
_BACK = re.compile(r"[A-Za-z+/_.=-]*\Z")
_MARK = re.compile(r"[0-9]|[a-z][A-Z]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), sorted; code points, end exclusive."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Every maximal run of at least LEAST token characters with a digit, or a capital after a small letter, in it."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        low = m.start()
        while low > at and _BACK.match(text[low - 1]):
            low -= 1
        at = _TOKEN.match(text, m.start()).end()
        if at - low >= LEAST:
            out.append((low, at))
    return out


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Parts of a candidate of at most CORE characters that cover it; the last one ends with it."""
    if b - a <= CORE:
        return [(a, b)]
    return [(i, i + CORE) for i in [*range(a, b - CORE, CORE), b - CORE]]


def _view(text: str, a: int, b: int) -> bytes:
    """The fixed-length view of a window: 0 where there is no character, 127 for any outside ASCII."""
    code = lambda s: bytes(min(ord(c), 127) for c in s)
    return code(text[max(0, a - BEFORE) : a]).rjust(BEFORE, b"\0") + code(text[a:b]).ljust(CORE, b"\0") + code(text[b : b + AFTER]).ljust(AFTER, b"\0")


class CharConv:
    """Embedding, filters of two widths, max pooling, a logistic output with Platt's calibration and a threshold."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        f = FILTERS * len(WIDTHS)
        self.live = np.zeros((max(WIDTHS), 1, f), np.float32)
        for i, w in enumerate(WIDTHS):
            self.live[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        p = {"emb": rng.normal(0, 0.5, (128, EMBED)), "conv": rng.normal(0, 0.25, (max(WIDTHS), EMBED, f)) * self.live, "bias": np.zeros(f), "out": rng.normal(0, 0.2, f), "off": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.platt, self.threshold = (1.0, 0.0), 2.0  # adds nothing until fitted

    def _forward(self, x: np.ndarray):
        e = self.p["emb"][np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))]
        n = x.shape[1]
        z = sum(e[:, j : j + n] @ self.p["conv"][j] for j in range(max(WIDTHS))) + self.p["bias"]
        return e, z

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = [np.maximum(self._forward(x[a : a + 256])[1].max(axis=1), 0) @ self.p["out"] + self.p["off"] for a in range(0, len(x), 256)]
        return np.concatenate(out) if out else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logit(x) + b, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, recall: float = RECALL) -> CharConv:
        """Adam on four fifths of the rows; calibration and threshold on the rest."""
        rng = np.random.default_rng(2)
        order = rng.permutation(len(x))
        held, own = order[: len(x) // 5], order[len(x) // 5 :]
        if not 0 < y[own].sum() < len(own) or not 0 < y[held].sum() < len(held):
            return self
        weight = np.where(y == 1, len(own) / (2 * y[own].sum()), len(own) / (2 * (len(own) - y[own].sum()))).clip(0, 10)
        p = self.p
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        step = 0
        for _ in range(max(epochs, -(-100 * batch // len(own)))):
            own = rng.permutation(own)
            for s in range(0, len(own), batch):
                i = own[s : s + batch]
                e, z = self._forward(x[i])
                at = z.argmax(axis=1)
                top = np.take_along_axis(z, at[:, None], 1)[:, 0]
                h = np.maximum(top, 0)
                q = 1 / (1 + np.exp(-np.clip(h @ p["out"] + p["off"], -30, 30)))
                d = ((q - y[i]) * weight[i] / len(i)).astype(np.float32)
                dh = d[:, None] * p["out"] * (top > 0)
                g = {"out": h.T @ d, "off": d.sum(keepdims=True), "bias": dh.sum(axis=0), "conv": np.zeros_like(p["conv"]), "emb": np.zeros_like(p["emb"])}
                padded, n = np.pad(x[i], ((0, 0), (0, max(WIDTHS) - 1))), np.arange(len(i))[:, None]
                for j in range(max(WIDTHS)):
                    c = padded[n, at + j]
                    g["conv"][j] = np.einsum("nf,nfd->df", dh, p["emb"][c])
                    np.add.at(g["emb"], c, dh[..., None] * p["conv"][j].T[None])
                g["conv"] *= self.live
                step += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        z, t = self.logit(x[held]), y[held]
        a, b, pos = 1.0, 0.0, t.sum()
        goal = np.where(t == 1, (pos + 1) / (pos + 2), 1 / (len(t) - pos + 2))
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            r, w = q - goal, q * (1 - q) + 1e-6
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            da, db = np.linalg.solve(hess, [(r * z).sum(), r.sum()])
            a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        self.platt = (float(a), float(b))
        found = np.sort(self.probability(x[held])[t == 1])
        self.threshold = min(0.5, float(found[int(np.floor((1 - recall) * len(found)))]))
        return self


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most_docs: int = MAX_TRAIN_DOCS, most: int = MAX_TRAIN) -> CharConv:
    """Fit on the candidates of about ``most_docs`` documents chosen by a hash of doc_id, ``most`` of each label at most."""

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for (t,) in rows_of(batches, "t"):
            spans = base_spans(t)
            got += [(_view(t, a, b), int(any(s < b and a < e for s, e, _ in spans))) for c in candidates(t) for a, b in windows(*c)]
        yield pa.record_batch({"x": pa.array([x for x, _ in got], pa.binary()), "y": pa.array([y for _, y in got], pa.int32())})

    use = bounded_sample(docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("k"), F.col(text).alias("t")), "k", most_docs).select("t")
    seen = use.mapInArrow(views, "x binary, y int").distinct()
    rows = sorted((r["x"], r["y"]) for y in (0, 1) for r in seen.filter(F.col("y") == y).orderBy(F.xxhash64("x"), "x").limit(most).collect())
    net = CharConv()
    if not rows:
        return net
    width = BEFORE + CORE + AFTER
    return net.fit(np.frombuffer(b"".join(x for x, _ in rows), np.uint8).reshape(-1, width), np.array([y for _, y in rows]))


def scan(docs: DataFrame, net: CharConv, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, findings (kind, start, end; by start, then kind).

    Code points, ends exclusive; whole texts of any length; null counts as
    empty and has no findings. Repeated rows get equal answers; no documents
    give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    finding = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            spans = [base_spans(t) for t in texts]
            more = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t) if not any(s < b and a < e for s, e, _ in spans[i])]
            if more:
                seen = [windows(a, b) for _, a, b in more]
                x = np.frombuffer(b"".join(_view(texts[i], *w) for (i, _, _), ws in zip(more, seen) for w in ws), np.uint8).reshape(-1, BEFORE + CORE + AFTER)
                size = np.array([len(ws) for ws in seen])
                for (i, a, b), p in zip(more, np.maximum.reduceat(m.probability(x), np.cumsum(size) - size)):
                    if p >= m.threshold:
                        spans[i].append((a, b, 3))
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in sorted(s, key=lambda s: (s[0], s[2]))] for s in spans]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "findings": pa.array(rows, finding)})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, findings array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from ``scan``'s rows."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    many = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda s: s["kind"] != "model")
    return found.select("doc_id", many("assign"), many("access"), many("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def redact(text: str, findings: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with every finding replaced; overlapping ones together."""
    out, at = [], 0
    for a, b in sorted(findings):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan(docs, train(docs)))
