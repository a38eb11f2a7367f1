"""Ranked search: equal to a plain version that scores every document for every item."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    N, L = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * N) // max(L, 1)
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in q if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, n + 1, d, -s) for n, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_the_plain_version(spark):
    path = "/root/testdata/sf0.01/"
    docs = [tuple(r) for r in spark.read.parquet(path + "documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(path + "benchmark.parquet").select("item_id", "text").collect()]
    got = R.op12_ranked_search(spark, path)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert rows(got) == sorted(plain(docs, items), key=str)


def test_ties_nulls_repeats_blocks_and_shards(spark):
    docs = [(d, "same words twice") for d in range(40, 0, -1)] + [(None, "same words twice"), (None, None), (7, "same words twice"), (50, ""), (51, "été ÉTÉ Été_x"), (52, "a-B a1 " * 4000), (53, "!!! ...")]
    items = [(1, "Same, same WORDS?"), (2, "été"), (3, None), (4, "absent"), (5, "a1 b twice"), (1, "Same, same WORDS?"), (None, "x"), (6, "words"), (6, "b")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    want = sorted(plain(docs, items), key=str)
    assert rows(R.search(R.build(frame), asked)) == want
    assert rows(R.search(R.build(frame, shard_bytes=100), asked, block_pairs=2)) == want
    assert rows(R.search(R.build(frame, shard_bytes=100), asked, k=3)) == sorted(plain(docs, items, 3), key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert R.search(R.build(docs.limit(0)), items).count() == 0
    assert R.search(R.build(docs), items.limit(0)).count() == 0
    assert rows(R.search(R.build(docs), items)) == [(1, 1, 1, plain([(1, "a b")], [(1, "a")])[0][3])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-2, 6), max_size=30), st.integers(1, 8))
def test_ties_at_the_border_go_to_the_first(scores, k):
    want = sorted((i for i, s in enumerate(scores) if s > 0), key=lambda i: (-scores[i], i))[:k]
    assert sorted(R.best(np.array(scores, np.int64), k).tolist()) == sorted(want)
