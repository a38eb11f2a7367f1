
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.functions import refs as R
from tracelake.model import DOCUMENTS, NODES, REFS, RESULTS, Model
from tracelake.operators import attributes, checks, coverage, diff, graph, reach, schema, tree, verify, views
from tracelake.sources.replicate import replicate


def model(spark, docs, nodes, refs, results=None):
    """docs: (path, document_id, level, rtf, sources, options); nodes: (path, id, options)."""
    d = [(p, i, x[0], x[1], o.get("prefix", ""), o.get("external", False), o.get("mandatory", False), o.get("ignore", False), x[2], x[3]) for i, (p, x, o) in enumerate(docs)]
    n = [(p, o.get("file", f"{p}/a.md"), k, o.get("kind", "req"), i, o.get("title", i), o.get("status"), o.get("version", 0), o.get("verify"), o.get("disposition"), o.get("reason"), o.get("suppress"), o.get("rtf")) for k, (p, i, o) in enumerate(nodes)]
    r = spark.createDataFrame(results, RESULTS) if results is not None else None
    return Model(spark.createDataFrame(d, DOCUMENTS), spark.createDataFrame(n, NODES), spark.createDataFrame(refs, REFS), r)


def two(spark, nodes, refs, results=None, rtf=("tests",)):
    docs = [("sys", ("system", "system", list(rtf) if rtf is not None else None, []), {}), ("tst", ("tests", "tests", [], ["sys"]), {})]
    return model(spark, docs, nodes, refs, results)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_resolution_by_document_id_directory_and_pin(spark):
    m = two(spark, [("sys", "S-1", {"version": 3}), ("tst", "T-1", {})], [("T-1", 1, "system/S-1~1"), ("T-1", 2, "sys/S-1"), ("T-1", 3, "tests/S-1"), ("T-1", 4, "S-1~x"), ("T-1", 5, "S-9")])
    assert rows(graph.resolve(m).filter("to_id IS NOT NULL"), "ref", "pin") == [("sys/S-1", None), ("system/S-1~1", 1)]
    assert rows(graph.resolve(m, directory_fallback=False).filter("to_id IS NOT NULL"), "ref") == [("sys/S-1",), ("system/S-1~1",)]
    assert {r["req_id"] for r in graph.broken(m).collect()} == {"T-1"} and graph.broken(m).count() == 3
    assert rows(graph.pin_health(m), "direction") == [("outdated",)]
    assert rows(graph.repin_deltas(m), "source_ref", "new_ref") == [("sys/S-1", "sys/S-1~3")]


def test_first_definition_wins(spark):
    m = two(spark, [("sys", "S-1", {}), ("tst", "S-1", {}), ("tst", "T-1", {})], [("T-1", 1, "tests/S-1")])
    assert rows(graph.duplicate_ids(m), "id", "doc_path", "first_doc") == [("S-1", "tst", "sys")]
    assert graph.broken(m).count() == 1


def test_suppressed_checks_are_silent(spark):
    m = two(spark, [("sys", "S-1", {"suppress": ["requires-trace-from-coverage"]}), ("tst", "T-1", {"suppress": ["broken-ref"]})], [("T-1", 1, "S-9")])
    assert graph.broken(m).count() == 0
    assert rows(coverage.coverage_state(m), "id", "state") == [("S-1", "not-required"), ("T-1", "not-required")]


def test_coverage_counts_drafts_before_the_covering_one(spark):
    nodes = [("sys", "S-1", {}), ("tst", "T-1", {"status": "draft"}), ("tst", "T-2", {"status": "APPROVED"}), ("tst", "T-3", {"status": "draft"})]
    m = two(spark, nodes, [("T-1", 1, "S-1"), ("T-2", 1, "S-1"), ("T-3", 1, "S-1")])
    assert rows(coverage.token_state(m), "covered", "drafts") == [(True, 1)]
    m = two(spark, nodes[:2], [("T-1", 1, "S-1")])
    assert [r["message"] for r in coverage.findings(m).filter("code = 'requires-trace-from'").collect()] == ['no upstream trace: no approved requirement from "tests" traces to this item (1 draft downstreams ignored)']
    m = two(spark, nodes[:1], [], rtf=("nowhere",))
    assert rows(coverage.coverage_state(m), "state", "misses") == [("unresolved", "nowhere")]
    m = two(spark, nodes[:1], [], rtf=None)
    assert rows(coverage.findings(m), "code") == [("no-upstream",)]  # a root needs no inbound link; it isn't a leaf here


def test_filter_scopes_coverage_but_not_resolution(spark):
    m = two(spark, [("sys", "S-1", {}), ("tst", "T-1", {})], [("T-1", 1, "S-1")])
    only = m.nodes.filter("id = 'S-1'").select("id")
    assert rows(coverage.coverage_state(m, only), "id", "state") == [("S-1", "missing-coverage")]
    assert graph.broken(m).count() == 0


def test_latest_wins_and_roll_up(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    res = [("T-1~2", "a", "fail", t, "x", 1), ("T-1", "a", "pass", t + dt.timedelta(1), "z", 2), ("T-1", "a", "skipped", t + dt.timedelta(1), "y", 3), ("T-1", "b", "inconclusive", None, "y", 4), ("T-2", "a", "fail", t, "y", 5)]
    m = two(spark, [("sys", "S-1", {"verify": "Test"}), ("tst", "T-1", {"verify": "Test"}), ("tst", "T-2", {"status": "draft", "verify": "Test"})], [("T-1", 1, "S-1"), ("T-2", 1, "S-1")], res)
    assert rows(verify.latest(m.results).filter("measure_id = 'T-1'"), "case_key", "outcome") == [("a", "skipped"), ("b", "inconclusive")]
    assert rows(verify.rollup(m), "id", "verdict", "cases") == [("S-1", "inconclusive", 2), ("T-1", "inconclusive", 2), ("T-2", "fail", 1)]
    assert verify.failing(m).count() == 0  # a draft measure isn't gated
    assert rows(verify.latest_per_target(m.results), "measure_id", "outcome") == [("T-1", "skipped"), ("T-2", "fail")]


def test_cycles_end(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")], "from_id string, to_id string")
    assert rows(graph.cyclic_nodes(e), "id") == [("a",), ("b",), ("c",)]
    up = e.select(F.col("from_id").alias("child"), F.col("to_id").alias("parent"))
    got = reach.propagate(up, spark.createDataFrame([("x", 2), ("d", 4)], "id string, sev int"), [], "sev")
    assert rows(got, "id", "sev") == [("a", 2), ("b", 2), ("c", 2), ("d", 4), ("x", 2)]


def _plain_score(ident, title, q):
    """What the palette scores an item, one character after the other."""
    low, head = q.strip().lower(), ident.lower()
    need = "".join(c for c in low if c.isascii() and c.isalnum())
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in head).split()]
    alnum = lambda c: c.isascii() and c.isalnum()
    starts = [k for k in range(1, len(head)) if head.startswith(low, k) and not alnum(head[k - 1])]
    if head == low:
        return 0.0
    if head.startswith(low) or starts or len(need) >= 2 and any(w.startswith(need) for w in words[1:]):
        return 1.0
    for s, hit in ((2.0, low in head), (3.0, title.lower().startswith(low)), (4.0, low in title.lower())):
        if hit:
            return s
    if len(need) < 2:
        return None

    def one(text):
        text, out = text.lower(), []
        if need in text:
            k = text.index(need)
            out.append(k * 0.2 + (4 if k and alnum(text[k - 1]) else 0))
        dense = "".join(c for c in text if alnum(c))
        if need[:2] in dense:
            first = dense.rindex(need[:2])
            at, skim = first + 2, 0
            for c in need[2:]:
                k = dense.find(c, at)
                if k < 0:
                    break
                skim, at = skim + k - at, k + 1
            else:
                out.append(first * 0.2 + skim * 0.15)
        cost, last, at = 6.0, -2, 0
        for c in need:
            k = text.find(c, at)
            if k < 0:
                break
            gap = k - last - 1
            cost += -2 if gap == 0 else -1 if gap <= 2 else gap
            cost -= 0 if k and alnum(text[k - 1]) else 1.5
            last, at = k, k + 1
        else:
            out += [cost] if cost >= 0 else []
        return min(out, default=None)

    best = [x + p for x, p in ((one(ident), 0), (one(title), 8)) if x is not None]
    return 5 + min(best) if best else None


def test_search_merges_tiers_and_fuzzy_hits(spark):
    import random

    rng = random.Random(5)
    items = [(f"{rng.choice(['SYS', 'SW', 'Graph'])}-{rng.choice(['FMT', 'GRA', 'X_Y', 'FM'])}-{k:03}", " ".join(rng.choice(["Graph", "format", "Löad", "fm-1", "the", "sys", "5-low"]) for _ in range(3)), k) for k in range(150)]
    d = spark.createDataFrame([*items, ("N-1", None, 200)], "id string, title string, ord int")
    for q in ("sysfm1", "graph", " GRA ", "SW-GRA-001", "5", "fm-1", "tf", "l.w", "löa", "zz9", "n-1"):
        want = sorted((s, k, i, t) for i, t, k in [*items, ("N-1", "", 200)] if (s := _plain_score(i, t, q)) is not None)
        want = want[: 30 if sum(c.isascii() and c.isalnum() for c in q) >= 2 else 40]
        got = [(round(r["score"], 6), r["id"]) for r in views.search(d, q).collect()]
        assert got == [(round(s, 6), i) for s, _, i, _ in want], q


def _plain_components(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    seen = {}
    for a in {x for e in edges for x in e}:
        todo, got = [a], set()
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in got:
                    got.add(y)
                    todo.append(y)
        seen[a] = got
    return {a: frozenset(b for b in seen[a] if a in seen[b]) for a in seen if a in seen[a]}


def _groups(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["comp"], set()).add(r["id"])
    return {i: frozenset(g) for g in by.values() for i in g}


def test_components_of_chains_rings_and_branches(spark, monkeypatch):
    ring = [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)]
    other = [(f"q{i}", f"q{(i + 1) % 9}") for i in range(9)]
    for edges in (
        ring + [("in0", "r3"), ("in1", "in0"), ("r5", "out0"), ("out0", "out1")],
        ring + other + [("r7", "q2"), ("q2", "z"), ("z", "q4"), ("y", "y"), ("r1", "r1")],
        ring + [("r0", "s0"), ("s0", "s1"), ("s1", "r20"), ("r20", "t0"), ("t0", "dead")],
        [(a, b) for a in "abcd" for b in "abcd" if a != b] + [("d", "e"), ("e", "f"), ("f", "e"), ("f", "g")],
    ):
        e = spark.createDataFrame(edges, "from_id string, to_id string")
        assert _groups(reach.components(e)) == _plain_components(edges)


def test_long_chain_with_a_cycle_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(reach, "cut", lambda df, own=reach.cut: rounds.append(1) or own(df))
    edges = [(f"n{i}", f"n{i + 1}") for i in range(1000)] + [("n1000", "n990")]
    e = spark.createDataFrame(edges, "from_id string, to_id string")
    assert rows(graph.cyclic_nodes(e), "id") == sorted((f"n{i}",) for i in range(990, 1001))
    assert len(rounds) <= 30


@settings(max_examples=5, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=24))
def test_components_against_reachability(spark, edges):
    edges = [(str(a), str(b)) for a, b in edges]
    assert _groups(reach.components(spark.createDataFrame(edges, "from_id string, to_id string"))) == _plain_components(edges)


@pytest.mark.parametrize("steps", [8, 1])
def test_reach_of_chains_diamonds_and_cycles(spark, monkeypatch, steps):
    monkeypatch.setattr(reach, "STEPS", steps)
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "g"), ("h", "h"), ("h", "g")]
    e = spark.createDataFrame(edges, "child string, parent string")
    seeds = spark.createDataFrame([("a", "k", 1), ("f", "k", 3), ("h", "k", 2), ("c", "j", 4), ("none", "k", 1)], "id string, key string, v int")
    got = reach.reach(e, seeds.select("id")).lift(seeds, ["key"], "v")
    want = {("a", "k"): 1, ("b", "k"): 1, ("c", "k"): 1, ("none", "k"): 1, ("h", "k"): 2, **{(x, "k"): 3 for x in "defg"}, **{(x, "j"): 4 for x in "cdefg"}}
    assert {(r["id"], r["key"]): r["v"] for r in got.collect()} == want


def test_hub_targets_are_not_one_task(spark):
    """Nine tenths of the references go to one requirement, and Spark may not split tasks by itself."""
    own = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}.items():
        spark.conf.set(k, v)
    try:
        n = 20_000
        nodes = spark.range(n, numPartitions=4).selectExpr("if(id < 100, 'sys', 'tst') AS doc_path", "'a.md' AS file", "id AS ord", "concat('R-', id) AS id")
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], NODES).schema if f.name not in (*nodes.columns, "kind")]
        m = two(spark, [], [])
        m = m.with_(nodes=nodes.select("*", F.lit("req").alias("kind"), *blank), refs=spark.range(100, n, numPartitions=4).selectExpr("concat('R-', id) AS from_id", "1 AS pos", "if(id % 10 < 9, 'R-0', concat('system/R-', id % 97)) AS ref"))
        assert graph.hot(m)["target"] == ["R-0"]
        r = graph.resolve(m)
        sizes = sorted(x["count"] for x in r.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == n - 100 and sizes[-1] <= 2 * sizes[len(sizes) // 2] and r.filter("to_id IS NULL").count() == 0
        inbound = coverage._inbound(m, None).select(F.col("to_id").alias("id"), "src_dir")
        from tracelake.operators import skew

        sizes = sorted(x["count"] for x in skew.attach(inbound, m.nodes.select("id", "title"), "id", "inner", graph.hot(m)["target"]).groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
        got = {r["id"]: (r["covered"], r["drafts"]) for r in coverage.token_state(m).collect()}
        assert len(got) == 100 and got["R-0"] == (True, 0) and got["R-99"] == (False, 0)
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


def test_evidence_climbs_a_chain_of_200(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(reach, "cut", lambda df, own=reach.cut: rounds.append(1) or own(df))
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(200)], "child string, parent string")
    seeds = spark.createDataFrame([("n000", "x", 1), ("n150", "x", 4), ("n100", "y", 2)], "id string, key string, v int")
    got = {(r["id"], r["key"]): r["v"] for r in reach.reach(e, seeds.select("id")).lift(seeds, ["key"], "v").collect()}
    assert got == {(f"n{i:03}", "x"): 4 if i >= 150 else 1 for i in range(201)} | {(f"n{i:03}", "y"): 2 for i in range(100, 201)}
    assert len(rounds) < 60


def test_dispositions_prefixes_disjoint_and_schema(spark):
    docs = [("d", ("d", "d", None, []), {"prefix": "D-", "mandatory": True})]
    m = model(spark, docs, [("d", "D-1", {"disposition": "deferred", "reason": "  "}), ("d", "E-2", {"file": "d/b.md", "status": "odd"})], [])
    assert rows(attributes.disposition_reasons(m), "id") == [("D-1",)]
    assert rows(attributes.mandatory_dispositions(m), "id") == [("E-2",)]
    assert rows(graph.prefix_checks(m), "req_id", "problem") == [("D-", "collision"), ("E-2", "mismatch")]
    assert rows(schema.schema_errors(m, {"d": {"required": ["verify"], "properties": {"status": {"enum": ["draft"]}}}}), "id", "problem") == [("D-1", "required"), ("E-2", "enum"), ("E-2", "required")]
    v = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", ["x", "y"]), ("n", [])], "id string, vals array<string>")
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "n")], "from_id string, to_id string")
    assert rows(attributes.disjoint(e, v), "to_id") == [("b",)]


def test_diff_and_views(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "q")], "id int, v string")
    assert rows(diff.requirements(a, b, ["id"], ["v"]), "id", "category") == [(1, "removed"), (2, "modified"), (3, "unchanged"), (4, "added")]
    assert rows(diff.attributes(a, b, ["id"], ["v"]), "id", "old_value", "new_value") == [(2, "y", "z")]
    assert diff.flatten_schema("d", {"a": [{"b": 1}], "c": {}}) == [("d", "a.0.b", "1"), ("d", "c", "{}")]
    t = spark.createDataFrame([(1, "10"), (2, "9"), (3, "b"), (4, "A"), (5, ""), (6, None)], "k int, v string")
    assert [r["k"] for r in t.orderBy(*views.table_order(F.col("v")), "k").collect()] == [2, 1, 4, 3, 5, 6]
    assert [r["k"] for r in t.orderBy(*views.table_order(F.col("v"), True), "k").collect()][-2:] == [5, 6]
    names = ["Item 1", "item 10", "item 9", "Item 09b", "état 2", "Etat 10", "", None, "7", "12", "item 100000000000000000000", "a.b"]
    want = ["7", "12", "a.b", "état 2", "Etat 10", "Item 1", "item 9", "Item 09b", "item 10", "item 100000000000000000000"]
    d = spark.createDataFrame([(x,) for x in names], "v string")
    assert [r["v"] for r in d.orderBy(*views.table_order(F.col("v"))).collect()][:10] == want
    assert [r["v"] for r in d.orderBy(*views.table_order(F.col("v"), True)).collect()][:10] == ["12", "7", *want[:1:-1]]
    assert [r["v"] for r in views.positions(d.filter("v LIKE '%tem%'"), views.table_order(F.col("v"))).orderBy("position").collect()] == want[5:]
    assert views.subsequence_score("abcabc", "cc") == 4 and views.subsequence_score("abc", "ca") is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 2, 3, 4, 5, 6]), st.sampled_from(["req", "info"])), min_size=1, max_size=12))
def test_tree_parents(spark, blocks):
    stack, want, req = [], [], []
    for o, (level, kind) in enumerate(blocks):
        while stack and (level == 0 or stack[-1][1] >= level):
            stack.pop()
        want.append(stack[-1][0] if stack and level else None)
        req.append(next((p for p, _, k in reversed(stack) if k == "req"), None) if level else None)
        stack = [] if level == 0 else [*stack, (o, level, kind)]
    df = spark.createDataFrame([("f", o, lv, k, f"i{o}") for o, (lv, k) in enumerate(blocks)], "file string, ord long, level int, kind string, id string")
    got = {r["ord"]: r for r in tree.requirement_parents(df).collect()}
    assert [got[o]["parent_ord"] for o in range(len(blocks))] == want
    assert [got[o]["req_parent_ord"] for o in range(len(blocks))] == req


def test_reference_functions(spark):
    cases = {"A-1~2": ("A-1", 2), "A~1~+3": ("A~1", 3), "A~-4": ("A", -4), "A~": ("A~", None), "A~99999999999999999999": ("A~99999999999999999999", None), "A": ("A", None), "~7": ("", 7)}
    df = spark.createDataFrame([(c,) for c in cases], "r string").select("r", R.strip_pin(F.col("r")).alias("b"), R.pin(F.col("r")).alias("p"))
    assert {r["r"]: (r["b"], r["p"]) for r in df.collect()} == cases
    t = spark.createDataFrame([("x:trace A-1, b/C-2~3\nother:trace bad\nsee D-E-003 and A-1 UTF-8",)], "t string")
    r = t.select(R.marked_traces(F.col("t")).alias("m"), R.heuristic_traces(F.col("t")).alias("h"), R.status_hash(F.lit("ab")).alias("s")).first()
    assert (r["m"], r["h"], r["s"]) == (["A-1", "b/C-2~3"], ["D-E-003"], (5381 * 33 + 97) * 33 + 98)


def nested(m, parents):
    """The model with parent_id from {id: parent}."""
    up = m.nodes.sparkSession.createDataFrame(list(parents.items()), "id string, parent_id string")
    return m.with_(nodes=m.nodes.join(up, "id", "left").select(*m.nodes.columns, "parent_id"))


def test_nested_requirements_are_children_and_edges(spark):
    docs = [("top", ("top", "top", None, []), {}), ("d", ("d", "d", None, ["top"]), {})]
    m = model(spark, docs, [("d", "A-1", {}), ("d", "A-2", {}), ("d", "A-3", {"status": "draft"}), ("d", "A-4", {}), ("top", "T-1", {})], [])
    assert rows(coverage.findings(m).filter("code = 'untraced'"), "req_id") == [("A-1",), ("A-2",), ("A-3",), ("A-4",)]
    m = nested(m, {"A-2": "A-1", "A-3": "A-2", "A-4": "GONE"})
    assert rows(graph.edges(m), "from_id", "to_id", "kind") == [("A-2", "A-1", "parent"), ("A-3", "A-2", "parent")]
    assert rows(graph.lost_parents(m), "req_id", "parent_id") == [("A-4", "GONE")]
    assert coverage.findings(m).filter("code = 'untraced'").count() == 0
    assert rows(coverage.coverage_state(m), "id", "state") == [("A-1", "covered"), ("A-2", "covered"), ("A-3", "not-required"), ("A-4", "not-required"), ("T-1", "not-required")]
    assert rows(graph.neighbours(m), "id", "direction", "neighbour") == [("A-1", "down", "A-2"), ("A-2", "down", "A-3"), ("A-2", "up", "A-1"), ("A-3", "up", "A-2")]
    found = rows(checks.findings(m), "code", "req_id")
    assert ("parent", "A-4") in found and not any(c == "circular" for c, _ in found)


def test_cycles_joined_by_a_path_and_suppressed_ones(spark):
    two_cycles = [("A", "B"), ("B", "A"), ("B", "C"), ("C", "D"), ("D", "E"), ("E", "D"), ("E", "F"), ("S", "S")]
    e = spark.createDataFrame(two_cycles, "from_id string, to_id string")
    assert rows(graph.cyclic_nodes(e), "id") == [("A",), ("B",), ("D",), ("E",), ("S",)]
    assert rows(graph.cyclic_nodes(e, spark.createDataFrame([("B",), ("S",)], "id string")), "id") == [("D",), ("E",)]
    assert graph.cyclic_nodes(e.limit(0)).count() == 0
    m = two(spark, [("sys", "S-1", {"suppress": ["circular"]}), ("sys", "S-2", {}), ("tst", "T-1", {}), ("tst", "T-2", {})], [("S-1", 1, "S-2"), ("S-2", 1, "S-1"), ("T-1", 1, "T-2"), ("T-2", 1, "T-1")])
    assert rows(graph.circular(m), "id") == [("T-1",), ("T-2",)]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=14))
def test_cyclic_nodes_against_reachability(spark, pairs):
    reach = {a: {b for x, b in pairs if x == a} for a in range(7)}
    for _ in range(7):
        for a in reach:
            reach[a] |= {c for b in list(reach[a]) for c in reach[b]}
    e = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "from_id string, to_id string")
    assert {r["id"] for r in graph.cyclic_nodes(e).collect()} == {str(a) for a in reach if a in reach[a]}


def test_loops_run_to_their_fixpoint(spark):
    n = 12
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(n)], "from_id string, to_id string")
    got = reach.propagate(e.select(F.col("from_id").alias("child"), F.col("to_id").alias("parent")), spark.createDataFrame([("n000", 3)], "id string, v int"), [], "v")
    assert got.count() == n + 1
    assert max(r["depth"] for r in graph.tiers(e, spark.createDataFrame([("n000",)], "id string")).collect()) == n
    up = e.select(F.col("from_id").alias("id"), F.col("to_id").alias("parent_id")).union(spark.createDataFrame([(f"n{n:03}", None)], "id string, parent_id string"))
    assert max(r["depth"] for r in tree.by_depth(up).collect()) == n
    with pytest.raises(ValueError):
        tree.by_depth(spark.createDataFrame([("a", "b"), ("b", "a"), ("r", None)], "id string, parent_id string"))
    links = spark.createDataFrame([("t", "s"), ("s", "r"), ("u", "t"), ("r", "u")], "from_id string, to_id string")
    assert rows(graph.chain(links, "s"), "id", "depth", "direction") == [("r", 1, "up"), ("s", 0, "self"), ("t", 3, "up"), ("u", 2, "up")]


def test_results_of_test_cases_are_nodes(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    res = spark.createDataFrame([("TC:c1", "c1", "fail", t, "x", 1, ["S-1~2", "S-9"]), ("TC:c1", "c1", "pass", t + dt.timedelta(1), "x", 2, ["S-1~1"]), ("S-2~1", "", "pass", t, "y", 3, None)], RESULTS + ", verifies array<string>")
    nodes = [("sys", "S-1", {"verify": "Test", "version": 2}), ("sys", "S-2", {"verify": "Test", "version": 2}), ("sys", "S-3", {"verify": "Test"}), ("tst", "T-1", {"status": "draft"})]
    m = two(spark, nodes, [("T-1", 1, "S-3")]).with_(results=res)
    assert rows(verify.evidence(m), "id", "case_key", "sev") == [("S-1", "c1", 1), ("S-2", "", 1)]
    assert verify.evidence(m, m.nodes.select("id")).filter("id = 'S-1'").count() == 0  # a filter leaves test cases out
    g = verify.synthetic(m)
    assert rows(graph.trace_edges(g).filter("from_id LIKE '%:%'"), "from_id", "to_id") == [("RESULT:S-2", "S-2"), ("RESULT:TC:c1#c1", "TC:c1"), ("TC:c1", "S-1")]
    found = rows(checks.findings(m), "code", "req_id", "message")
    assert {("version-pin", "RESULT:S-2"), ("version-pin", "TC:c1")} <= {(c, r) for c, r, _ in found}
    assert ("missing-verdict", "S-3", "missing verdict: no verification result or downstream test-case result covers this measure (1 draft downstreams ignored)") in found
    assert [x[1] for x in found if x[0] == "verdict"] == ["S-1", "S-2"]
    assert rows(attributes.result_layer(checks.findings(m)), "code") == [("version-pin",), ("version-pin",)]
    assert graph.repin_deltas(g).count() == 0  # synthetic nodes have no file
    assert rows(verify.nested(m), "measure_id", "source") == [("S-1", "x"), ("S-2", "y")]


def test_schema_keywords(spark):
    x = spark.createDataFrame([("d", "A", "req", '{"n": 3, "tags": ["Base", "x"], "s": "ab"}'), ("d", "B", "req", '{"n": "3", "tags": "Base", "extra": 1}'), ("d", "C", "req", None)], "doc_path string, id string, kind string, attrs string")
    m = Model(x, x, x)
    rules = {"required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 4}, "tags": {"type": "array", "items": {"type": "string", "enum": ["Base"]}, "maxItems": 1}, "s": {"type": "string", "pattern": "^b"}}}
    assert rows(schema.schema_errors(m, {"d": rules}), "id", "attr", "problem") == [
        ("A", "n", "minimum"), ("A", "s", "pattern"), ("A", "tags", "maxItems"), ("A", "tags[1]", "enum"), ("B", "extra", "additionalProperties"), ("B", "n", "type"), ("B", "tags", "type"), ("C", "n", "required"),
    ]
    for bad in (
        {"properties": {"n": {"multipleOf": 0}}}, {"properties": {"n": {"type": "date"}}}, {"properties": {"status": {"type": "integer"}}}, {"properties": {"n": {"items": {"not": 1}}}}, {"properties": []}, {"required": "n"},
        {"properties": {"n": {"pattern": "("}}}, {"patternProperties": {"[": {}}}, {"properties": {"n": {"$ref": "#/$defs/none"}}}, {"properties": {"n": {"$ref": "http://x"}}}, {"allOf": {}}, {"properties": {"n": {"frobnicate": 1}}}, {"enum": 3}, [],
    ):
        assert len(schema.problems(bad)) == 1, bad
        if isinstance(bad, dict):
            assert schema.schema_errors(m, {"d": bad}).count() >= 0  # the rest of it counts, and no check is broken off
    assert not schema.problems({"$schema": "x", "x-tool": {"a": 1}, "title": "t", "properties": {"n": {"format": "date", "description": "d"}}})
    assert rows(attributes.universes(m), "attr", "n") == [("extra", 1), ("n", 2), ("s", 1), ("tags", 2)]


TREE = {"$defs": {"tree": {"type": "object", "properties": {"name": {"type": "string"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/tree"}}}, "required": ["name"]}}, "properties": {"v": {"$ref": "#/$defs/tree"}}}
KEYWORDS = [
    ({"type": "integer"}, [1, 1.0, 1.5, "1", True, None, [], {}]), ({"type": ["string", "null"]}, ["a", None, 1, []]), ({"type": "number"}, [1, 2.5, "x"]), ({"type": "boolean"}, [True, 0]), ({"type": "object"}, [{}, []]),
    ({"enum": ["a", 1, None, [1, "b"], {"k": 2}]}, ["a", 1, 1.0, None, [1, "b"], ["b", 1], {"k": 2}, {"k": 3}, "1", True]), ({"const": 3}, [3, 3.0, "3", [3]]), ({"const": False}, [False, 0, None]),
    ({"minLength": 2, "maxLength": 3}, ["a", "ab", "été", "abcd", 5]), ({"pattern": "^a.*z$"}, ["az", "abz", "za", 3]), ({"minimum": 2, "maximum": 4}, [1, 2, 4, 4.5, "9"]), ({"exclusiveMinimum": 2, "exclusiveMaximum": 4}, [2, 3, 4]),
    ({"multipleOf": 0.5}, [1, 1.5, 1.25, "x"]), ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [[], [1], [1, 1], [1, "1", 2], "x"]), ({"items": {"type": "string", "minLength": 2}}, [["ab", "c", 3], [], "x"]),
    ({"prefixItems": [{"type": "string"}, {"type": "integer"}], "items": False}, [["a", 1], ["a", "b"], ["a", 1, 2], [1]]), ({"contains": {"type": "integer"}}, [["a"], ["a", 1], []]), ({"contains": {"const": 1}, "minContains": 2, "maxContains": 3}, [[1], [1, 1], [1, 1, 1, 1]]),
    ({"properties": {"a": {"type": "string"}, "b": {"properties": {"c": {"minimum": 3}}}}, "required": ["a", "z"]}, [{"a": 1}, {"a": "x", "z": None, "b": {"c": 2}}, {"b": {"c": 5}}, []]),
    ({"patternProperties": {"^n_": {"type": "integer"}, "_t$": {"minLength": 2}}, "additionalProperties": {"type": "boolean"}}, [{"n_a": 1, "n_t": "x", "o": True}, {"o": 1, "x_t": "ab"}]),
    ({"properties": {"a": {}}, "patternProperties": {"^x": {}}, "additionalProperties": False}, [{"a": 1, "x1": 2}, {"a": 1, "b": 2, "c": 3}]), ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}, {"abc": 1}, {}]), ({"minProperties": 1, "maxProperties": 2}, [{}, {"a": 1}, {"a": 1, "b": 2, "c": 3}]),
    ({"dependentRequired": {"a": ["b", "c"]}}, [{"a": 1, "b": 2}, {"b": 1}]), ({"dependentSchemas": {"a": {"required": ["q"]}}}, [{"a": 1}, {"a": 1, "q": 1}, {}]),
    ({"allOf": [{"minimum": 2}, {"maximum": 1}]}, [1, 2, 1.5]), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["a", 4, 2]), ({"oneOf": [{"type": "integer"}, {"minimum": 3}]}, [1, 4, 2.5, 3.5]), ({"not": {"enum": ["a"]}}, ["a", "b"]),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"required": ["a"]}, "else": {"required": ["b"]}}, [{"k": 1}, {"k": 1, "a": 1}, {"k": 2}, {"b": 1}]), ({"if": {"type": "string"}, "then": {"minLength": 2}}, ["a", "ab", 1]),
    (True, [1]), (False, [1]), ({}, [1, None]), (TREE, [{"name": "a", "kids": [{"name": 1}, {"kids": [{"name": "x"}, {}]}]}, {"kids": "x"}, 3]), ({"format": "date"}, ["2024-01-31", "2024-13-01", 3]),
]


def _plain_errors(root, s, v, path):
    """(path, keyword) of every violation, by the rules of the specification, one value at a time."""
    import re

    if isinstance(s, bool):
        return set() if s else {(path, "false")}
    num = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    same = lambda a, b: type(a) is type(b) and a == b if isinstance(a, bool) or isinstance(b, bool) else a == b
    types = {"string": isinstance(v, str), "boolean": isinstance(v, bool), "array": isinstance(v, list), "object": isinstance(v, dict), "null": v is None, "number": num(v), "integer": num(v) and v == int(v)}
    ok = lambda x: not _plain_errors(root, x, v, "")
    out, at = set(), lambda n: f"{path}.{n}" if path else n
    simple = {
        "type": lambda w: any(types[t] for t in ([w] if isinstance(w, str) else w)), "enum": lambda w: any(same(v, x) for x in w), "const": lambda w: same(v, w), "minLength": lambda w: not types["string"] or len(v) >= w, "maxLength": lambda w: not types["string"] or len(v) <= w,
        "pattern": lambda w: not types["string"] or re.search(w, v), "minimum": lambda w: not num(v) or v >= w, "maximum": lambda w: not num(v) or v <= w, "exclusiveMinimum": lambda w: not num(v) or v > w, "exclusiveMaximum": lambda w: not num(v) or v < w,
        "multipleOf": lambda w: not num(v) or v / w == int(v / w), "minItems": lambda w: not types["array"] or len(v) >= w, "maxItems": lambda w: not types["array"] or len(v) <= w, "uniqueItems": lambda w: not types["array"] or not any(same(a, b) for i, a in enumerate(v) for b in v[:i]),
        "minProperties": lambda w: not types["object"] or len(v) >= w, "maxProperties": lambda w: not types["object"] or len(v) <= w, "anyOf": lambda w: any(map(ok, w)), "oneOf": lambda w: sum(map(ok, w)) == 1, "not": lambda w: not ok(w),
        "contains": lambda w: not types["array"] or s.get("minContains", 1) <= sum(not _plain_errors(root, w, x, "") for x in v) <= s.get("maxContains", 99), "propertyNames": lambda w: not types["object"] or all(not _plain_errors(root, w, k, "") for k in v),
    }
    for k, w in s.items():
        if k in simple and not simple[k](w):
            out.add((path, k))
        elif k == "$ref":
            out |= _plain_errors(root, root["$defs"][w.split("/")[-1]], v, path)
        elif k == "allOf":
            out |= set().union(*(_plain_errors(root, x, v, path) for x in w))
        elif k == "if":
            out |= _plain_errors(root, s.get("then" if ok(w) else "else", True), v, path)
        elif types["array"] and k == "prefixItems":
            out |= set().union(*(_plain_errors(root, x, y, f"{path}[{i}]") for i, (x, y) in enumerate(zip(w, v))))
        elif types["array"] and k == "items":
            out |= {e for i, y in enumerate(v) if i >= len(s.get("prefixItems", ())) for e in _plain_errors(root, w, y, f"{path}[{i}]")}
        elif types["object"] and k == "properties":
            out |= {e for n, x in w.items() if n in v for e in _plain_errors(root, x, v[n], at(n))}
        elif types["object"] and k == "required":
            out |= {(at(n), k) for n in w if n not in v}
        elif types["object"] and k == "dependentRequired":
            out |= {(at(y), k) for n, ys in w.items() if n in v for y in ys if y not in v}
        elif types["object"] and k == "dependentSchemas":
            out |= {e for n, x in w.items() if n in v for e in _plain_errors(root, x, v, path)}
        elif types["object"] and k == "patternProperties":
            out |= {e for p, x in w.items() for n in v if re.search(p, n) for e in _plain_errors(root, x, v[n], at(n))}
        elif types["object"] and k == "additionalProperties":
            rest = [n for n in v if n not in s.get("properties", {}) and not any(re.search(p, n) for p in s.get("patternProperties", {}))]
            out |= {(at(n), k) for n in rest} if w is False else {e for n in rest for e in _plain_errors(root, w, v[n], at(n))}
    return out


def test_schema_keywords_against_a_plain_validator(spark):
    import json

    schemas = {f"d{i}": s if s is TREE else {"properties": {"v": s}} for i, (s, _) in enumerate(KEYWORDS)}
    data = [(f"d{i}", f"d{i}-{j}", "req", json.dumps({"v": v})) for i, (_, values) in enumerate(KEYWORDS) for j, v in enumerate(values)]
    x = spark.createDataFrame(data, "doc_path string, id string, kind string, attrs string")
    assert not any(schema.problems(s) for s in schemas.values())
    got = {}
    for r in schema.schema_errors(Model(x, x, x), schemas).collect():
        got.setdefault(r["id"], set()).add((r["attr"], r["problem"]))
    for d, i, _, attrs in data:
        assert got.get(i, set()) == _plain_errors(schemas[d], schemas[d], json.loads(attrs), ""), (schemas[d], attrs)
    dates = schema.schema_errors(Model(x, x, x), {f"d{len(KEYWORDS) - 1}": schemas[f"d{len(KEYWORDS) - 1}"]}, formats=True)
    assert rows(dates, "id", "problem") == [(f"d{len(KEYWORDS) - 1}-1", "format")]


def test_builtin_attributes_have_rules(spark):
    nodes = [("d", "D-1", {"status": "odd", "disposition": "dropped"}), ("d", "D-2", {"status": "reviewed", "rtf": ["OK?"], "version": 2}), ("d", "D-3", {"status": "draft", "disposition": "deferred", "rtf": ["a_b"]})]
    m = model(spark, [("d", ("d", "d", None, []), {})], nodes, [])
    assert rows(schema.schema_errors(m, {"d": {"x-t": {"additional-status-values": ["reviewed"]}}}), "id", "attr", "problem") == [("D-1", "disposition", "enum"), ("D-1", "status", "enum"), ("D-2", "requires-trace-from[0]", "pattern")]


def test_filter_as_seen_within_it(spark):
    m = two(spark, [("sys", "S-1", {}), ("tst", "T-1", {})], [("T-1", 1, "S-1")], rtf=None)
    assert [r["code"] for r in coverage.findings(m, m.nodes.filter("id = 'T-1'").select("id")).collect()] == []  # a leaf with an own empty list
    assert rows(graph.degrees(m, m.nodes.filter("id = 'S-1'").select("id")), "id", "upstream", "downstream") == [("S-1", 0, 0), ("T-1", 1, 0)]


def test_boundaries_resolve_any_depth(spark):
    deep = "/".join("abcdefghijkl")
    docs = [(deep, ("x", "x", None, ["../" * 11 + "top"]), {}), ("a/top", ("t", "t", None, []), {})]
    m = model(spark, docs, [(deep, "X-1", {})], [])
    assert rows(coverage.boundaries(m, True), "doc_path", "is_leaf") == [("a/b/c/d/e/f/g/h/i/j/k/l", True), ("a/top", False)]


def test_replicas_refer_to_themselves(spark):
    m = replicate(two(spark, [("sys", "S-1", {}), ("tst", "T-1", {})], [("T-1", 1, "system/S-1~2"), ("T-1", 2, "S-1")]), 3)
    assert rows(graph.edges(m), "from_id", "to_id") == sorted([("T-1", "S-1"), ("T-R1-1", "S-R1-1"), ("T-R2-1", "S-R2-1")] * 2)
    assert rows(m.refs.filter("from_id = 'T-R1-1'"), "ref") == [("S-R1-1",), ("system/S-R1-1~2",)]


def test_list_elements_and_chips(spark):
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["q"])], "id int, l array<string>")
    b = spark.createDataFrame([(1, ["x", "z", "w"]), (3, ["q"])], "id int, l array<string>")
    assert rows(diff.elements(a, b, ["id"], "l"), "index", "old_value", "new_value") == [(1, "y", "z"), (2, None, "w")]
    c = spark.range(1).select(views.chips(F.lit(""), F.lit("unresolved"), F.lit("pass")).alias("a"), views.chips(F.lit("draft"), F.lit("not-required"), F.lit(None).cast("string")).alias("b")).first()
    assert (c["a"], c["b"]) == (["approved", "unresolved source", "pass"], ["draft"])
