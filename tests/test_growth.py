"""What keeps a task's share from growing with the tables: documents come to the rows, shuffles get tasks by rows."""

import re

from pyspark.sql import functions as F

from tracelake.operators import attributes, checks, coverage, diff, graph, skew, verify, views
from tracelake.plans.projection import model


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_no_rows_are_dealt_out_by_document(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = model(spark, sf_dir)
        for df in (views.search_index(m), graph.edges(m), coverage.effective_rtf(m), attributes.facets(m), attributes.mandatory_dispositions(m), graph.duplicate_ids(m)):
            text = plan(df)
            assert "SortMergeJoin [doc_path" not in text and "SortMergeJoin [_q" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_documents_and_many_rows_give_the_same(spark, sf_dir, monkeypatch):
    want = rows(graph.last_refs(model(spark, sf_dir))), rows(coverage.effective_rtf(model(spark, sf_dir)).drop("suppressions", "rtf"))
    monkeypatch.setattr(graph, "FEW_DOCUMENTS", 2)
    monkeypatch.setattr(skew, "ROWS", 500)
    m = model(spark, sf_dir)
    parts = graph.rows(m) // 500 + 1
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {parts}), REPARTITION_BY_NUM" in plan(graph.definitions(m))
    assert want == (rows(graph.last_refs(m)), rows(coverage.effective_rtf(m).drop("suppressions", "rtf")))


def test_spark_does_not_merge_large_shuffles(spark, sf_dir, monkeypatch):
    """Also where Spark's own number of partitions is enough: it would merge them by compressed bytes."""
    monkeypatch.setattr(skew, "ROWS", 1000)
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        m = model(spark, sf_dir)
        parts = graph.rows(m) // 1000 + 1
        assert 1 < parts < 40
        assert f", {min(40, 4 * parts)}), REPARTITION_BY_NUM" in plan(graph.definitions(m))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)


def test_broken_references_deal_out_requirements_by_rows(spark, sf_dir, monkeypatch):
    want = rows(graph.broken(model(spark, sf_dir)))
    monkeypatch.setattr(skew, "ROWS", 500)
    m = model(spark, sf_dir)
    got = graph.broken(m)
    assert re.search(rf"hashpartitioning\(from_id#\d+, {graph.rows(m) // 500 + 1}\), REPARTITION_BY_NUM", plan(got))
    assert rows(got) == want


def test_rows_that_are_alike_meet_once(spark, monkeypatch):
    monkeypatch.setattr(diff, "CHUNK", 4)
    old = [("a", "1" * 9)] * 5 + [("a", "2" * 9), ("a", None), (None, "3" * 9), ("gone", "4" * 9), ("gone", "4" * 9)]
    new = [("a", "1" * 9)] * 3 + [("a", "5" * 9)] * 7 + [(None, "3" * 9)] * 2
    a, b = (spark.createDataFrame(x, "path string, sha string") for x in (old, new))
    pairs = [(p, o, n) for p, o in old for q, n in new if p is not None and p == q]
    pairs += [(p, o, None) for p, o in old if p is None or p not in {q for q, _ in new}] + [(p, None, n) for p, n in new if p is None]
    cut = lambda s: s and s[:7]
    want = [(p, "added" if o is None else "removed" if n is None else "updated", cut(o), cut(n)) for p, o, n in pairs if o != n]
    got = diff.submodules(a, b)
    assert rows(got) == sorted(want, key=str)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("FullOuter") < text.index("Aggregate")  # rows are counted below the join


def test_pins_meet_hot_targets_where_references_lie(spark, sf_dir):
    """repin_deltas, repin_deltas_unpinned, repin_summary (F10 to F12): a hub's references don't shuffle to it once more for their pins."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = rows(graph.repin_deltas(model(spark, sf_dir), True)), rows(graph.pin_health(model(spark, sf_dir)))
        m = model(spark, sf_dir)
        graph.hot(m)["target"] = ["NAT-000000001", "NAT-000000002"]
        got = graph.repin_deltas(m, True), graph.pin_health(m)
        assert all(re.search(r"BroadcastHashJoin \[to_id#", plan(df)) for df in got)
        assert want == tuple(rows(df) for df in got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_health_of_links_is_found_in_one_pass(spark, sf_dir):
    """downstream_mirror (F7): the last references aren't found twice and joined with themselves."""
    m = model(spark, sf_dir)
    got = verify.mirror(m)
    assert not re.search(r"Join \[from_id#\d+, to_id#\d+\]", plan(got))
    p = graph.pin_health(m).select("from_id", "to_id", "direction")
    want = graph.last_refs(m).join(p, ["from_id", "to_id"], "left").join(graph.definitions(m).select(F.col("id").alias("from_id"), "title"), "from_id")
    assert rows(got) == rows(want.select(F.col("to_id").alias("id"), "from_id", "title", F.coalesce("direction", F.lit("ok"))))


def test_links_are_counted_by_pairs(spark, sf_dir):
    """link_summary (F9): references resolve once; those that only a directory resolves are broken, as before."""
    m = model(spark, sf_dir)
    named = F.when(F.col("doc_path") == "suppliers", "parts").when(F.col("doc_path") == "parts", "p").otherwise(F.col("document_id"))
    m = m.with_(documents=m.documents.withColumn("document_id", named))
    got = attributes.link_summary(m)
    assert not re.search(r"Join \[from_id#\d+, to_id#\d+\]", plan(got))
    x = graph.traces(m).join(graph.pin_health(m).select("from_id", "to_id", "direction"), ["from_id", "to_id"], "left")
    n = lambda c: F.count_if(c)
    want = x.groupBy("doc_path").agg(F.count("*"), n(F.col("resolved")), n(~F.col("resolved")), n(F.col("pin") != 0), n(F.col("direction") == "outdated"))
    assert rows(got) == rows(want)
    assert graph.resolve(m).filter("to_id IS NOT NULL").count() > graph.resolve(m, False).filter("to_id IS NOT NULL").count()


def test_what_is_read_back_is_dealt_out_again(spark, sf_dir, monkeypatch):
    """check_findings (F15): joins with written definitions, and duplicates, run in tasks by rows as well."""
    want = rows(checks.findings(model(spark, sf_dir)))
    monkeypatch.setattr(skew, "ROWS", 2000)
    m = graph.prepared(model(spark, sf_dir))
    parts = graph.rows(m) // 2000 + 1
    assert parts > 1
    for df in (graph.definitions(m), graph.duplicate_ids(m)):
        assert re.search(rf"hashpartitioning\(id#\d+, {max(parts, min(4, 4 * parts))}\), REPARTITION_BY_NUM", plan(df))
    assert rows(checks.findings(model(spark, sf_dir))) == want
