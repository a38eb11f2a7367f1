"""Sharding: even sizes, gapless slots, groups together wherever they fit."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracelake.llm import sharding as S


def check(rows, docs, shards, law):
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in docs)
    text = dict(docs)
    by = defaultdict(list)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert r["law"] == law and r["grown_shard"] is None
        if sum(d == r["doc_id"] for d, _ in docs) == 1:
            assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards))
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    if law == "rows":
        n = [len(by[s]) for s in range(shards)]
        assert max(n) - min(n) <= 1
    else:
        n = [sum(r["size"] for r in by[s]) for s in range(shards)]
        assert max(n) - min(n) <= 2 * max(r["size"] for r in rows)
    spread = defaultdict(set)
    for r in rows:
        spread[text[r["doc_id"]] or ""].add(r["shard"])
    return spread


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    spread = check(S.op8_sharding(spark, d).collect(), docs, 40, "rows")
    many = Counter(t or "" for _, t in docs)
    groups = [t for t, n in many.items() if n > 1]
    assert sum(len(spread[t]) == 1 for t in groups) >= 0.9 * len(groups)


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_hot_group_and_odd_rows(spark, law):
    docs = [(i, "hot") for i in range(300)] + [(i, f"pair {i // 2}") for i in range(300, 600)] + [(i, f"single {i}") for i in range(600, 900)] + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spread = check(S.shard(df, 10, law).collect(), docs, 10, law)
    assert len(spread["hot"]) <= 6
    assert sum(len(s) == 1 for t, s in spread.items() if t.startswith("pair")) >= 140
    placed = S.shard(df, 10, law).join(df.fillna("", ["text"]).dropDuplicates(["doc_id"]), "doc_id")
    random = placed.withColumn("at", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)))
    assert S.cut_links(placed, ["text"], "shard") < S.cut_links(random, ["text"], "at")
    odd = [(None, "a"), (1, "b"), (1, "b"), (2, None)]
    rows = S.shard(spark.createDataFrame(odd, "doc_id long, text string"), 2, law).collect()
    assert len(rows) == 4
    assert S.shard(df.limit(0), 3, law).count() == 0
    assert {r["shard"] for r in S.shard(df, 1, law).collect()} == {0}


def test_labels_follow_neighbours_under_capacity(spark):
    """Ten groups of twelve whose members start anywhere, no shard with room for more than two: all are united."""
    cells = spark.createDataFrame([(g, (g * 7 + 3 * i) % 8, 1, 1) for g in range(10) for i in range(12)], "key int, start int, w long, n long").groupBy("key", "start").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    got, load = S.propagate(cells, 8, 30)
    rows = got.collect()
    assert max(load) <= 30 and sum(load) == sum(r["w"] for r in rows if r["now"] is not None)
    at = defaultdict(set)
    for r in rows:
        at[r["key"]].add(r["now"])
    assert sum(len(s) == 1 and None not in s for s in at.values()) >= 9


def test_running_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_ROWS", 20)
    df = spark.range(500).selectExpr("id % 3 AS k", "id", "id % 7 AS v")
    for by in ([], ["k"]):
        rows = sorted(S.running(df, by, F.xxhash64("id"), "v", 500, [F.col("id")]).withColumn("o", F.xxhash64("id")).collect(), key=lambda r: r["o"])
        total = Counter()
        for r in rows:
            k = r["k"] if by else 0
            assert r["before"] == total[k]
            total[k] += r["v"]
