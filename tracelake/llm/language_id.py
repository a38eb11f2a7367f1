"""Language identification by a byte convolutional network in numpy.

Bytes are embedded; filters of several widths slide over fixed-length windows;
each filter's largest response in the window (max pooling) goes to a softmax.
A text is cut into consecutive windows, all of it, and its language is the one
of the largest probability, averaged over the windows by their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, held_out, table

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 8, 8
MAX_TRAIN = 1000  # documents of each language that the network is fitted on at most, about
WINDOWS_EACH, EPOCHS, BATCH, RATE = 2, 8, 64, 0.02
_WORD = re.compile(r"[^\W\d_]")  # letters, and numbers such as fractions


def windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of the bytes as rows of WINDOW, the last padded with 0, and their lengths; three zero bytes follow each row."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros((n, WINDOW + 3), np.uint8)
    full = len(data) // WINDOW
    out[:full, :WINDOW] = data[: full * WINDOW].reshape(full, WINDOW)
    size = np.full(n, WINDOW)
    if full < n:
        rest = data[full * WINDOW :]
        out[full, : len(rest)] = rest
        size[full] = len(rest)
    return out, size


def has_letter(text: str) -> bool:
    """Whether any character is a letter (category L)."""
    return any(m[0].isalpha() for m in _WORD.finditer(text))


def _bytes(text: str) -> np.ndarray:
    return _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]


class ByteConv:
    """Embedding, filters of each width, max pooling over the window, softmax."""

    def __init__(self, classes: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.classes = classes
        f = FILTERS * len(WIDTHS)
        self.p = {
            "emb": rng.normal(0, 0.5, (256, EMBED)),
            "conv": rng.normal(0, 0.25, (max(WIDTHS), EMBED, f)),  # a filter's taps beyond its width stay 0
            "bias": np.zeros(f),
            "out": rng.normal(0, 0.1, (f, len(classes))),
            "off": np.zeros(len(classes)),
        }
        self.live = np.zeros((max(WIDTHS), 1, f))
        for i, w in enumerate(WIDTHS):
            self.live[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.p["conv"] *= self.live
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self._tables = None

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of every byte pair to each filter's first two and last two taps: the same convolution by look-up."""
        if self._tables is None:
            taps = [self.p["emb"] @ self.p["conv"][j] for j in range(4)]
            self._tables = tuple((taps[j][:, None] + taps[j + 1][None] + (self.p["bias"] if j == 0 else 0)).reshape(65536, -1).astype(np.float32) for j in (0, 2))
        return self._tables

    def probabilities(self, rows: np.ndarray, block: int = 512) -> np.ndarray:
        first, last = self.tables()
        out = np.empty((len(rows), len(self.classes)), np.float32)
        for a in range(0, len(rows), block):
            x = rows[a : a + block].astype(np.int32)
            pair = (x[:, :-1] << 8) + x[:, 1:]
            z = first[pair[:, :WINDOW]]
            z += last[pair[:, 2 : WINDOW + 2]]
            logit = np.maximum(z.max(axis=1), 0) @ self.p["out"] + self.p["off"]
            e = np.exp(logit - logit.max(axis=1, keepdims=True))
            out[a : a + block] = e / e.sum(axis=1, keepdims=True)
        return out

    def fit(self, rows: np.ndarray, labels: np.ndarray, seed: int = 2) -> ByteConv:
        """Adam on the cross entropy; max pooling sends each gradient to one place of the window."""
        rng, p = np.random.default_rng(seed), self.p
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        step = 0
        for _ in range(max(EPOCHS, -(-200 * BATCH // max(1, len(rows))))):
            order = rng.permutation(len(rows))
            for a in range(0, len(rows), BATCH):
                x, y = rows[order[a : a + BATCH]], labels[order[a : a + BATCH]]
                e = p["emb"][x]
                z = sum(e[:, j : j + WINDOW] @ p["conv"][j] for j in range(4)) + p["bias"]
                at = z.argmax(axis=1)
                top = np.take_along_axis(z, at[:, None], 1)[:, 0]
                h = np.maximum(top, 0)
                logit = h @ p["out"] + p["off"]
                q = np.exp(logit - logit.max(axis=1, keepdims=True))
                q /= q.sum(axis=1, keepdims=True)
                q[np.arange(len(y)), y] -= 1
                q /= len(y)
                g = {"out": h.T @ q, "off": q.sum(axis=0), "conv": np.zeros_like(p["conv"]), "emb": np.zeros_like(p["emb"])}
                dh = (q @ p["out"].T) * (top > 0)
                g["bias"] = dh.sum(axis=0)
                n = np.arange(len(y))[:, None]
                for j in range(4):
                    c = x[n, at + j]
                    g["conv"][j] = np.einsum("nf,nfd->df", dh, p["emb"][c])
                    np.add.at(g["emb"], c, dh[..., None] * p["conv"][j].T[None])
                g["conv"] *= self.live
                step += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self._tables = None
        return self

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of each whole text; ("und", 0) without a letter."""
        out: list = [("und", 0.0)] * len(texts)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            prob = self.probabilities(np.concatenate([r for _, r, _ in held]))
            at = 0
            for i, r, n in held:
                q = n @ prob[at : at + len(r)] / n.sum()
                at += len(r)
                k = int(q.argmax())
                out[i] = (self.classes[k], float(min(1.0, q[k])))

        for i, t in enumerate(texts):
            if t and has_letter(t) and self.classes:
                held.append((i, *windows(_bytes(t))))
                size += len(held[-1][1])
                if size > 4096:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return out


def train(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", most: int = MAX_TRAIN) -> ByteConv:
    """Fit on all labelled rows of a language, or on about ``most`` of them chosen by a hash of ``key``; WINDOWS_EACH windows of each."""
    use = rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("y"))

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for k, t, y in zip(*(batch.column(c).to_pylist() for c in "kty")):
                w, _ = windows(_bytes(t))
                at = sorted({(hash((k, j)) if k is not None else j) % len(w) for j in range(WINDOWS_EACH)})
                got += [(w[i].tobytes(), y) for i in at if has_letter(t)]
            yield pa.record_batch({"w": pa.array([w for w, _ in got], pa.binary()), "y": pa.array([y for _, y in got], pa.string())})

    share = use.groupBy("y").agg(F.count("*").alias("n")).collect()
    near = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 20))
    kept = [F.lit(False)] + [(F.col("y") == r["y"]) & (F.lit(r["n"] <= most) | (near < F.lit(most * (1 << 20) // r["n"]))) for r in share]
    use = use.filter(reduce(or_, kept))
    found = sorted((r["w"], r["y"]) for r in use.mapInArrow(cut_windows, "w binary, y string").collect())
    classes = sorted({y for _, y in found})
    net = ByteConv(classes)
    if len(classes) > 1:
        x = np.frombuffer(b"".join(w for w, _ in found), np.uint8).reshape(-1, WINDOW + 3)
        net.fit(x, np.array([classes.index(y) for _, y in found]))
    return net


def identify(docs: DataFrame, net: ByteConv, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    Whole texts of any length; ``und`` with score 0 for a null text or one
    without a letter, or if no language was learned. Repeated rows get equal
    answers; no documents give no rows.
    """
    net.tables()
    shared = docs.sparkSession.sparkContext.broadcast(net.p)
    classes = net.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteConv(classes)
        own.p = shared.value
        for batch in batches:
            got = own.predict(batch.column("text").to_pylist())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array([g[0] for g in got]), "score": pa.array([g[1] for g in got], pa.float64())})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs.filter(~held_out("doc_id")).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
