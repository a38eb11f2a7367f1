"""Exact dedup: report and filter against plain grouping, odd rows, filters in slices."""

import hashlib

import pytest

from tracelake.llm import exact_dedup as X


def plain(rows):
    last, n = {}, {}
    for d, t in rows:
        k = t or ""
        n[k] = n.get(k, 0) + 1
        last[k] = max((x for x in (d, last.get(k)) if x is not None), default=None)
    return sorted((d if d is not None else -1, last[t or ""], n[t or ""], d == last[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)


@pytest.mark.parametrize("size", [X.MAX_FILTER_BYTES, X.BLOCK_BITS // 8])
def test_report(spark, size, monkeypatch):
    monkeypatch.setattr(X, "BITS_A_ROW", 4096)  # many blocks, so that the small filter goes in slices
    rows = [(i, f"text {i % 700}") for i in range(1000)] + [(5000 + i, "hot") for i in range(400)] + [(6000, None), (6001, ""), (6002, "é"), (6003, "É"), (6004, "x" * 300_000)]
    got = X.report(spark.createDataFrame(rows, "doc_id long, text string"), max_filter_bytes=size).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == plain(rows)


def test_cleared_rows_do_not_shuffle(spark):
    rows, _ = X.groups(spark.createDataFrame([(i, f"text {i}") for i in range(500)] + [(900, "text 1")], "doc_id long, text string"))
    assert "Exchange" not in rows.filter("NOT maybe")._jdf.queryExecution().executedPlan().toString()
    assert rows.filter("NOT maybe").count() > 400 and rows.count() == 501


def test_filter_keeps_columns_and_one_row(spark):
    rows = [(1, "a", 1.0), (2, "a", 2.0), (2, "a", 2.0), (3, "b", None), (None, "c", 3.0), (None, "c", 4.0), (4, None, 5.0), (5, "", 6.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dedup_sha double")
    for size in (X.MAX_FILTER_BYTES, 1):
        got = X.dedup(df, max_filter_bytes=max(size, X.BLOCK_BITS // 8 if size > 1 else 1))
        assert got.columns == df.columns
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == [(0, "c"), (2, "a"), (3, "b"), (5, "")]
    assert X.dedup(df.limit(0)).count() == X.report(df.limit(0)).count() == 0


def test_filter_never_misses(spark):
    h = spark.range(4000).selectExpr("xxhash64(id % 3500) AS h", "id")
    maybe = {r["id"] for r in X.possible_repeats(h, "h", 4000).collect()}
    assert maybe >= {i for i in range(500)} | {i for i in range(3500, 4000)} and len(maybe) < 1500
