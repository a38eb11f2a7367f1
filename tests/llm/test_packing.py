"""Packing: exact round trip, little padding, and the parts of the plan."""

import zlib
from array import array
from functools import cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import packing as P


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.default_tokenizer())


def whole(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, docs):
    ids = {d: whole(t) for d, t in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(array("I", part).tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert by_doc.keys() == ids.keys()
    for d, rs in by_doc.items():
        at = 0
        for r in sorted(rs, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[d])
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= P.CAPACITY
    return sum(map(len, ids.values())) / (len(by_seq) * P.CAPACITY)


def test_round_trip(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    docs += [(-1, None), (-2, ""), (-3, "İstanbul ΣΑΣ <|endoftext|> it's ½²"), (-4, "Ünï-CÖDE don't\x1c x\xa0y"), (-5, "a " * 50_000)]
    rows = P.op3_packing(spark, "/root/testdata/sf0.01").collect()
    assert check(rows, docs[:-5]) > 0.97
    df = spark.createDataFrame(docs, "doc_id long, text string")
    packed = P.pack(df)
    assert check(packed.collect(), docs) > 0.97
    total = sum(len(r["ids"]) // 4 for r in P.sequences(packed).collect())
    assert total == sum(len(whole(t)) for _, t in docs)


def test_no_documents_and_repeats(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = P.pack(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")).collect()
    assert sorted((r["sequence_id"], r["offset"]) for r in rows) == [(0, 0), (0, 2), (0, 4)]


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 500), min_size=1, max_size=12))
def test_cutting_stock_meets_demand(items):
    sizes, demand = zip(*sorted(items.items()))
    used = P.cutting_stock(list(sizes), list(demand), 100)
    assert (sum(n * a for a, n in used) == np.array(demand)).all()
    assert all((a * np.array(sizes)).sum() <= 100 for a, _ in used)
    bound = sum(s * d for s, d in items.items()) / 100
    assert sum(n for _, n in used) <= max(1.7 * bound, bound + len(items) + 1) or max(sizes) > 50


def test_knapsack_is_optimal():
    rng = np.random.default_rng(1)
    s, v = np.array([3, 5, 7]), rng.random(3)
    best = max(a * v[0] + b * v[1] + c * v[2] for a in range(8) for b in range(6) for c in range(4) if 3 * a + 5 * b + 7 * c <= 23)
    value, n = P.knapsack(s, v, 23)
    assert abs(value - best) < 1e-9 and abs(n @ v - best) < 1e-9 and n @ s <= 23


def test_words_encoded_as_one_text():
    words = ["a", "'s", "s", "''", "ab'", "naïve", "7", "...", "zq" * 40, "ÿþ", "l", "'ll", "the"]
    words = [w for w in words if P._WORD.fullmatch(w)]
    cache = P.WordCache(P.default_tokenizer())
    want = [array("I", tokenizer().encode(w, add_special_tokens=False).ids).tobytes() for w in words]
    assert len(words) > 8 and cache._each(words) == want
    assert cache._each(["ab cd", "e"])[0] == array("I", tokenizer().encode("ab cd", add_special_tokens=False).ids).tobytes()
