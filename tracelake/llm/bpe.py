"""BPE encoding and decoding through tables of distinct words and distinct ids.

Texts are split into words in Spark and gathered in chunks: each chunk holds
its distinct words once and, for every position, the place of its word among
them. All chunks' words are dealt out and sorted by word, so that a run of equal
words is one entry of the distributed table of distinct words: it is encoded
once, and its ids go back to each chunk by position, packed. Nothing larger
than a chunk is ever collected.
Decoding asks for a chunk's distinct ids by a join
with the id-to-piece table, which is as large as the vocabulary and broadcast.
A word lies at most once in a chunk, so however often it occurs, it holds only
as many rows as there are chunks.
"""

from __future__ import annotations

import json
import os
import pickle
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, give_back, rows_of, table
from .packing import _WORD, _plain, default_tokenizer

CHUNK_CHARS = 1 << 24  # a chunk of texts ends once it holds so many characters,
CHUNK_IDS = 1 << 21  # one of ids once it holds so many ids,
CHUNK_ROWS = 50_000  # and either at so many rows
BATCH_IDS = 1 << 18  # ids of an Arrow batch that a chunk is given back in, but for a longer text
PACK_BATCHES = 64  # Arrow batches of words whose ids are packed together


class Words:
    """What a worker needs of a tokenizer file: texts to words, words to ids, ids to pieces.

    The file must hold a BPE model that sees one word of the first, splitting
    pre-tokenizer at a time, and neither a decoder nor a post-processor that
    rewrites ids: the two hold for word tokenizers. Anything else is an error.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        odd = [a["content"] for a in spec["added_tokens"] if a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]]
        if steps != ["Split", "ByteLevel"] or spec["decoder"] or odd:
            raise ValueError(f"{path}: not a word BPE file (pre-tokenizers {steps}, decoder {spec['decoder']}, added tokens {odd})")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.added = {a: self.tokenizer.token_to_id(a) for a in added}
        self.marks = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.split, self.to_bytes = self.tokenizer.pre_tokenizer[0], self.tokenizer.pre_tokenizer[1]

    def of(self, text: str) -> list[str]:
        """The words of a text in order; special tokens written out in it are words of their own."""
        if _plain(text):
            return _WORD.findall(text.lower())
        out: list[str] = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.added:
                out.append(part)
            elif part:
                out += [w for w, _ in self.split.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))]
        return out

    def ids(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Words are normalised already: only those that this can't change go the short way."""
        short = [w for w in words if w.isascii() and w not in self.added]
        known = dict(zip(short, (e.ids for e in self.tokenizer.encode_batch_fast(short, add_special_tokens=False))))
        model = self.tokenizer.model
        for w in words:
            if w not in known:
                known[w] = [self.added[w]] if w in self.added else [t.id for p, _ in self.to_bytes.pre_tokenize_str(w) for t in model.tokenize(p)]
        return [known[w] for w in words]


_words: dict[str, Words] = CACHES.setdefault("bpe", {})


def _tokenizer(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def _planes(codes: np.ndarray) -> bytes:
    """Codes byte by byte, all lowest bytes first: most of the others are 0."""
    return pa.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _codes(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _body(ids: list, lengths: list[int], codes: np.ndarray, entries: np.ndarray | None = None) -> bytes:
    return pickle.dumps((ids, np.array(lengths, np.int64), len(codes), _planes(codes), entries))


def _open(body: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray | None]:
    """Of a chunk: doc_id of each row, where its codes begin (and the last ones end), the codes, the entries."""
    ids, lengths, n, codes, entries = pickle.loads(body)
    return ids, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), _codes(codes, n), entries


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text) row by row; few texts at a time become Python texts."""
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part = batch.slice(a, 200)
            yield from zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)


def _chunks(rows: Iterator[tuple], size: Callable, most: int) -> Iterator[tuple[int, list, list]]:
    """(chunk, doc_ids, values) of consecutive rows (doc_id, value); a chunk's number is unique among all partitions."""
    chunk = TaskContext.get().partitionId() << 33
    ids, values, held = [], [], 0
    for doc, value in rows:
        ids.append(doc)
        values.append(value)
        held += size(value)
        if held >= most or len(ids) >= CHUNK_ROWS:
            yield chunk, ids, values
            chunk, ids, values, held = chunk + 1, [], [], 0
    if ids:
        yield chunk, ids, values


@dataclass(frozen=True)
class _Answered:
    ids: list  # doc_id of each row
    bounds: np.ndarray  # where each row's codes begin, and the last ones end
    codes: np.ndarray
    ends: np.ndarray  # where the answers begin in ``data``, and the last one ends
    data: bytes
    entries: np.ndarray | None


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[_Answered]:
    """The chunks in a stream of rows (at, data): a chunk's body (at -1), then the answers to its entries in order; none is null data."""
    body, ends, parts, held, place = None, [], [], 0, 0

    def done() -> _Answered:
        ids, bounds, codes, entries = _open(body)
        return _Answered(ids, bounds, codes, np.concatenate([[0], *ends]).astype(np.int64), b"".join(parts), entries)

    for batch in batches:
        at, data = batch.column("at").to_numpy(), batch.column("data")
        cuts = np.unique([0, *np.flatnonzero(at == -1), len(at)]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            if at[a] == -1:
                if body is not None:
                    yield done()
                body, ends, parts, held, place = data[a].as_py(), [], [], 0, 0
                a += 1
            if b > a:
                if not (at[a:b] == np.arange(place, place + b - a)).all():
                    raise RuntimeError("answers to a chunk are out of order")
                own = data.slice(a, b - a)
                after = held + np.cumsum(pc.fill_null(pc.binary_length(own), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
                ends.append(after)
                parts.append(b"".join(own.drop_null().to_pylist()))
                held, place = int(after[-1]), place + b - a
    if body is not None:
        yield done()


def _dump(words: list[str]) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.record_batch({"entry": pa.array(words, pa.string())})
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write(batch)
    return out.getvalue().to_pybytes()


def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... (n of them) of each run, one run after the other."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def _arrays(lists: pa.Array) -> Iterator[np.ndarray]:
    """Lists of integers as arrays, null as an empty one."""
    for x in lists:
        yield x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)


def _spans(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows a to b that hold at most ``most`` of what ``bounds`` counts together, or one row that holds more."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, side="right")) - 1)
        yield a, b
        a = b


def _lists_batch(ids: list, bounds: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))})


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and the place of each id among them."""
    if not len(ids) or ids.min() < 0 or ids.max() >= 1 << 22:
        return np.unique(ids, return_inverse=True)
    seen = np.zeros(ids.max() + 1, bool)
    seen[ids] = True
    return np.flatnonzero(seen).astype(np.int32), (np.cumsum(seen, dtype=np.uint32) - 1)[ids]


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, as the tokenizer itself gives them without special tokens of its own.

    Null and empty texts have no ids. Rows repeated or with a null doc_id are
    rows like any other; no documents give no rows. The rows of a partition
    must come in the same order each time, as scans give them.
    """
    path = tokenizer or default_tokenizer()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunk = _tokenizer(path), TaskContext.get().partitionId() << 33
        place: dict[str, int] = {}
        ids, lengths, codes, chars = [], [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal chunk, chars
            flat = np.concatenate(codes)
            order = np.argsort(-np.bincount(flat, minlength=len(place)), kind="stable")  # common words get small codes
            rank = np.empty(len(place), np.uint32)
            rank[order] = np.arange(len(place))
            known = list(place)
            data = pickle.dumps((_body(ids, lengths, rank[flat]), _dump([known[i] for i in order])))
            out = pa.record_batch({"chunk": [chunk], "data": pa.array([data], pa.binary())})
            chunk, chars = chunk + 1, 0
            for x in (place, ids, lengths, codes):
                x.clear()
            return out

        for doc, t in _rows(batches):  # only codes are kept, not texts
            found = words.of(t) if t else []
            ids.append(doc)
            lengths.append(len(found))
            codes.append(np.fromiter((place.setdefault(w, len(place)) for w in found), np.uint32, len(found)))
            chars += len(t or "")
            if chars >= CHUNK_CHARS or len(ids) >= CHUNK_ROWS:
                yield emit()
        if ids:
            yield emit()
        give_back("bpe")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, data in rows_of(batches, "chunk", "data"):
            words = pa.ipc.open_stream(pickle.loads(data)[1]).read_all().column("entry").combine_chunks()
            order = pc.sort_indices(words)  # like words together, which packs better
            for a in range(0, len(words), 10_000):
                at = order.slice(a, 10_000)
                yield pa.record_batch({"entry": words.take(at), "chunk": pa.array([chunk] * len(at), pa.int64()), "at": at.cast(pa.int32())})

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of their word: a run of equal words is encoded once, and its ids go to each place; packed by chunk."""
        words, held, last, ids = _tokenizer(path), [], None, []

        def emit() -> pa.RecordBatch:
            chunk, at, n, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((at, chunk))
            start = np.cumsum(n) - n
            head = np.flatnonzero(np.diff(chunk[order], prepend=-1))
            packs = []
            for a, b in zip(head, [*head[1:], len(order)]):
                own = order[a:b]
                packs.append(pickle.dumps((b - a, _planes(np.diff(at[own], prepend=0)), _planes(n[own]), int(n[own].sum()), _planes(flat[_ragged(start[own], n[own])]))))
            held.clear()
            return pa.record_batch({"chunk": pa.array(chunk[order[head]], pa.int64()), "data": pa.array(packs, pa.binary())})

        for batch in batches:
            entry = batch.column("entry").to_pylist()
            new = [k for k, w in enumerate(entry) if w != (entry[k - 1] if k else last)]
            found = [ids, *words.ids([entry[k] for k in new])]
            last, ids = entry[-1], found[-1]
            own = np.zeros(len(entry), np.int64)
            own[new] = 1
            own = np.cumsum(own)
            n = np.array([len(x) for x in found])
            flat = np.array([i for x in found for i in x], np.int64)
            held.append((batch.column("chunk").to_numpy(), batch.column("at").to_numpy().astype(np.int64), n[own], flat[_ragged((np.cumsum(n) - n)[own], n[own])]))
            if len(held) >= PACK_BATCHES:
                yield emit()
        if held:
            yield emit()
        give_back("bpe")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(body: bytes, packs: list[bytes]) -> Iterator[pa.RecordBatch]:
            ids, bounds, codes, _ = _open(body)
            parts = [(np.cumsum(_codes(at, k), dtype=np.int64), _codes(n, k), _codes(flat, total)) for k, at, n, total, flat in map(pickle.loads, packs)]
            at, n, flat = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ((), (), ())))
            n = n.astype(np.int64)
            if not np.array_equal(np.sort(at), np.arange(codes.max() + 1 if len(codes) else 0)):
                raise RuntimeError("a chunk's words and their ids don't match")
            start, length = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            start[at], length[at] = np.cumsum(n) - n, n
            for a, b in _spans(bounds, BATCH_IDS):  # a batch of a whole chunk would be held by Python and the JVM at once
                own = codes[bounds[a] : bounds[b]]
                n = length[own]
                yield _lists_batch(ids[a:b], np.concatenate([[0], np.cumsum(n)])[bounds[a : b + 1] - bounds[a]], flat[_ragged(start[own], n)])

        for data, packs in rows_of(batches, "data", "packs"):
            yield from chunk(pickle.loads(data)[0], packs or [])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = src.mapInArrow(split, "chunk long, data binary").repartition("chunk")  # one exchange, read twice
    asked = held.mapInArrow(ask, "entry string, chunk long, at int")
    found = asked.repartition("entry").sortWithinPartitions("entry").mapInArrow(lookup, "chunk long, data binary")
    packs = found.groupBy("chunk").agg(F.collect_list("data").alias("packs"))  # of a chunk's own words: as bounded as the chunk
    return held.join(packs, "chunk", "left").select("data", "packs").mapInArrow(spell, "doc_id long, ids array<int>")


def pieces(spark: SparkSession, tokenizer: str | None = None) -> DataFrame:
    """(id, piece) of the whole vocabulary with its added tokens: as many rows as the tokenizer has ids, tens of thousands."""
    vocabulary = _tokenizer(tokenizer or default_tokenizer()).tokenizer.get_vocab(with_added_tokens=True)
    return spark.createDataFrame(sorted((i, p) for p, i in vocabulary.items()), "id int, piece string")


def decode(encoded: DataFrame, tokenizer: str | None = None, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids, text): the text that the tokenizer decodes each list of ids to, special tokens included.

    Pieces stand with one space between them, as the tokenizer, which has no
    decoder, writes them; ids outside the vocabulary stand for nothing. Null
    and empty lists give the empty text.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column("doc_id").to_pylist(), _arrays(batch.column("ids")), strict=True))
        for _, docs, lists in _chunks(rows, len, CHUNK_IDS):
            entries, codes = _distinct(np.concatenate(lists))
            body = _body(docs, [len(x) for x in lists], codes, entries)
            yield pa.record_batch({"at": pa.array([-1], pa.int32()), "entry": pa.array([None], pa.int32()), "data": pa.array([body], pa.binary())})
            for a in range(0, len(entries), 10_000):
                own = entries[a : a + 10_000]
                yield pa.record_batch({"at": pa.array(range(a, a + len(own)), pa.int32()), "entry": pa.array(own, pa.int32()), "data": pa.nulls(len(own), pa.binary())})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _answered(batches):
            known = np.diff(x.ends) > 0
            word = np.array([*(x.data[a:b].decode() for a, b in zip(x.ends, x.ends[1:])), None], object)
            whole = known.all()
            for a, b in _spans(x.bounds, BATCH_IDS):
                own = x.bounds[a : b + 1]
                texts = [" ".join(word[c if whole else c[known[c]]]) for p, q in zip(own, own[1:]) for c in (x.codes[p:q],)]
                ids = _lists_batch(x.ids[a:b], own - own[0], x.entries[x.codes[own[0] : own[-1]]])
                yield pa.record_batch({"doc_id": ids.column("doc_id"), "ids": ids.column("ids"), "text": pa.array(texts, pa.string())})
        give_back()

    src = encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    asked = src.mapInArrow(split, "at int, entry int, data binary")
    table_ = pieces(encoded.sparkSession, tokenizer).select(F.col("id").alias("entry"), F.encode("piece", "UTF-8").alias("piece"))
    answered = asked.join(F.broadcast(table_), "entry", "left")  # leaves rows where and in the order they are; _answered makes sure of it
    return answered.select("at", F.coalesce("data", "piece").alias("data")).mapInArrow(join, "doc_id long, ids array<int>, text string")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256")
    )
