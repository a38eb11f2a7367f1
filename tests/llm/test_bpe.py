"""BPE by tables of words and ids: equal to the tokenizer itself on every text."""

import hashlib
from functools import cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import bpe as B

ODD = [
    None, "", "   ", "\n\t", "Hello World's don't 12½² ab<|endoftext|>cd", "<|startoftext|><|startoftext|>", "<|ENDOFTEXT|> <|", "İstanbul ΣΑΣ ﬁ 힣 각", "İ̖x J̌",
    "Ünï-CÖDE don't\x1c x\xa0y\x00z\x85", "日本語のテキスト 😀👩‍👩‍👧 ''s \"'s", "a" * 5000, "word " * 60_000, "Ⅷ ١٢٣ x​y z", "é ̖́ ẞ",
]


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(B.default_tokenizer())


def whole(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_query_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {r["doc_id"]: (len(ids := whole(r["text"])), sha(" ".join(map(str, ids))), sha(library().decode(ids, skip_special_tokens=False))) for r in docs}
    got = B.op13_bpe(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_odd_texts_round_trip(spark, monkeypatch):
    monkeypatch.setattr(B, "CHUNK_ROWS", 3)
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a null id", "x"), (3, "one id again", "y"), (3, "one id again", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a clashing name
    got = B.decode(B.encode(docs)).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    want = [(i, tuple(whole(t)), library().decode(whole(t), skip_special_tokens=False)) for i, t, _ in rows]
    assert sorted(((r["doc_id"], tuple(r["ids"]), r["text"]) for r in got), key=key) == sorted(want, key=key)


def test_empty_tables_and_odd_lists(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert B.encode(none).count() == 0 and B.decode(B.encode(none)).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [320, 999_999, 49407])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in B.decode(lists).collect()} == {1: "", 2: "", 3: "a</w> <|endoftext|>"}
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in B.encode(blank).collect()} == {1: [], 2: []}


def test_a_chunk_comes_back_in_bounded_batches(spark):
    for sizes in ([], [0, 0, 0], [3, 1, 0, 2, 9, 0, 0, 4], [7], [9, 9]):
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        spans = list(B._spans(bounds, 5))
        assert [i for a, b in spans for i in range(a, b)] == list(range(len(sizes)))
        assert all(b - a == 1 or bounds[b] - bounds[a] <= 5 for a, b in spans)
    rows = [(i, f"word {i} " * 8000) for i in range(20)] + [(20, ""), (21, "end")]  # some 900,000 ids of one chunk
    got = B.decode(B.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))).collect()
    assert {r["doc_id"]: (r["ids"], r["text"]) for r in got} == {i: (whole(t), library().decode(whole(t), skip_special_tokens=False)) for i, t in rows}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text("aJİΣ's<|endoftext|>½̖̇̌́ \n", max_size=30))
def test_words_give_the_ids(text):
    words = B._tokenizer(B.default_tokenizer())
    assert [i for ids in words.ids(words.of(text)) for i in ids] == whole(text)
