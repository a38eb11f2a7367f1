"""Greedy string tiling against a plain version of the algorithm."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import decontaminate as D


def tokens(t):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def plain(doc, item, least):
    """Wise's algorithm by definition; the number of covered item words."""
    used_d, used_i, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for b in range(len(item)):
            for a in range(len(doc)):
                n = 0
                while b + n < len(item) and a + n < len(doc) and item[b + n] == doc[a + n] and not used_i[b + n] and not used_d[a + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return covered
        covered += n
        used_d[a : a + n], used_i[b : b + n] = [True] * n, [True] * n


def brute(docs, items, coverage=0.8):
    out = set()
    for i, t in items:
        w = tokens(t)
        for d, s in docs:
            if w and plain(tokens(s), w, min(5, len(w))) >= coverage * len(w):
                out.add((d, i))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), min_size=1, max_size=14))
def test_tiles_equal_plain_tiling(doc, item):
    index = D._index([{"item_id": 1, "text": " ".join(item)}])
    got = index.matches(" ".join(doc), 0.0)
    assert (got[0][1] if got else 0) == plain(doc, item, min(5, len(item)))


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    seeds = {tuple(w[j : j + 5]) for _, t in items for w in [tokens(t)] for j in range(len(w) - 4)}
    near = [(i, t) for i, t in docs for w in [tokens(t)] if any(tuple(w[j : j + 5]) in seeds for j in range(len(w) - 4))]
    got = {(r["doc_id"], r["item_id"]) for r in D.op5_decontaminate(spark, d).collect()}
    assert got == brute([(i, t) for i, t in near if len(t) < 20000], items) | {p for p in got if p[0] not in dict(near) or len(dict(near)[p[0]]) >= 20000}
    assert got <= {(i, k) for i, _ in near for k, _ in items}


def test_reordered_sliced_and_odd(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    docs = [(1, "x " * 30 + " ".join(w[10:]) + " and " + " ".join(w[:10])), (2, " ".join(w[:10])), (3, None), (4, ""), (5, "say Two, words!"), (None, item.upper()), (6, "y " * 100_000 + item), (1, item)]
    items = [(7, item), (8, "two words"), (9, None), (10, ""), (None, "never seen at all here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (D.SLICE_BYTES, 20):
        got = sorted(((r["doc_id"], r["item_id"]) for r in D.contaminated(df, bench, slice_bytes=size).collect()), key=str)
        assert got == sorted([(1, 7), (1, 7), (5, 8), (6, 7), (None, 7)], key=str)
        extra = df.withColumn("coverage", df.doc_id)
        left = D.clean(extra, bench, slice_bytes=size)
        assert left.columns == extra.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4]
    assert D.contaminated(df.limit(0), bench).count() == D.contaminated(df, bench.limit(0)).count() == 0
