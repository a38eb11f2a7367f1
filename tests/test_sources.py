"""Readers, sinks, filters, symbols and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions import expr
from tracelake.functions import text as T
from tracelake.functions.hashes import short_hash, short_hash_text
from tracelake.model import RESULTS
from tracelake.operators import checks, diff, verify
from tracelake.project import Project
from tracelake.sources import imports, markdown, readers, sinks, symbols
from tracelake.streaming import results as streams


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        f = tmp_path / "spec" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("system/schema.yaml", "$schema: x\nx-tool:\n  document-id: sys\n  id-prefix: SYS-\n  requires-trace-from: tests\nproperties:\n  status: {enum: [draft, approved]}\n")
    put("system/a.md", "---\nowner: me\n---\n# System\n\nIntro.\n\n## Part\n\n### SYS-001: Boots *fast*\n\n```attr\nstatus: approved\nversion: 2\nverify: Test\n```\n\nIt boots.\n\n*Rationale: users wait*\n\n### SYS-002: Sleeps\n\n```attr\nstatus: odd\nx-suppress:\n  - untraced\ntrace: []\n```\n")
    put("tests/schema.yaml", "$schema: x\nx-tool:\n  document-id: tests\n  upstream: {sources: [system]}\n  requires-trace-from: []\n")
    put("tests/t.md", "## T-001: Boot test\n\n```attr\ntrace: [sys/SYS-001~1, SYS-9]\n```\n")
    put("tests/broken.md", "## T-002: Bad\n\n```attr\na: 1\na: 2\n```\n")
    put("tests/more/ignored.md", "## X-1: no document\n\n```attr\nstatus: approved\n```\n")
    report = {"results": {"tests": [{"name": "n", "suite": "s", "status": "failed", "stop": 1700000000000, "extra": {"x-tool": {"id": "SYS-001"}}}, {"name": "free", "status": "passed", "extra": {"x-tool": {}}}, {"name": "none", "status": "passed"}]}}
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports/r.json").write_text(json.dumps(report))
    return tmp_path


def test_tree_to_findings_and_export(spark, tree):
    p = Project(spark, str(tree / "spec"), str(tree / "reports"))
    assert {(r["doc_path"], r["document_id"], tuple(r["requires_trace_from"])) for r in p.model.documents.collect()} == {("system", "sys", ("tests",)), ("tests", "tests", ())}
    got = {r["id"]: r for r in p.blocks.filter("kind = 'req'").collect()}
    assert set(got) == {"SYS-001", "SYS-002", "T-001"}
    a = got["SYS-001"]
    assert (a["title"], a["version"], a["body"], a["rationale"], a["level"]) == ("Boots fast", 2, "It boots.", "users wait", 3)
    assert got["SYS-002"]["suppressions"] == ["untraced"]
    codes = {(r["code"], r["req_id"]) for r in p.check().collect()}
    assert {("parse", "tests/broken.md"), ("broken-ref", "T-001"), ("version-pin", "T-001"), ("requires-trace-from", "SYS-002"), ("failing-verdict", "SYS-001"), ("unbound-result", ""), ("schema", "SYS-002")} <= codes
    assert ("requires-trace-from", "SYS-002") not in {(r["code"], r["req_id"]) for r in p.check(filter="status == 'approved'").collect()}
    assert [r["new_ref"] for r in p.repin().collect()] == ["sys/SYS-001~2"]
    assert p.stats().count() == 2 and p.search("boots").first()["id"] == "SYS-001"
    p.export(str(tree / "out"))
    lines = [json.loads(x) for f in sorted((tree / "out/requirements").glob("part-*")) for x in f.read_text().splitlines()]
    assert len(lines) == 5 and all({"disposition", "attrs"} <= set(x) for x in lines)
    sinks.csv(p.blocks, str(tree / "csv"), ["status", "trace"])
    assert any("T-001" in f.read_text() for f in (tree / "csv").glob("part-*"))
    sinks.property_graph(p.model, str(tree / "graph"))
    assert spark.read.parquet(str(tree / "graph/edges")).count() == 1
    assert p.diff(Project(spark, str(tree / "spec"))).filter("category <> 'unchanged'").count() == 0
    assert "errors" in sinks.findings_text(p.check())[0]


@pytest.mark.parametrize("text", ["a:\n  b: 1", "a: 1\na: 2", "a:\n- x", "just text"])
def test_attribute_blocks_that_are_refused(text):
    with pytest.raises(markdown.MarkdownError):
        markdown.decode_attrs(text)


def test_attribute_values():
    got = markdown.decode_attrs("a: yes\nb: true\nc: 12\nd: ~\ne: [x, 'y z', 3]\nf:\n  - p\n  - q # note\ng: \"q\\n\"\nh: {k: 1}\ni: on # c\n")
    assert got == {"a": "yes", "b": True, "c": 12, "d": None, "e": ["x", "y z", 3], "f": ["p", "q"], "g": "q\n", "h": {"k": 1}, "i": "on"}


def test_markdown_shapes():
    blocks, title, front = markdown.parse("# T\n\npre\n\n## A\none\ntwo\n\n---\n\n- x\n- y\n\n```py\ncode\n```\n\n## B: c\n~~~attr\ns: 1\n~~~\n")
    assert title == "T" and [(b.level, b.kind, b.id) for b in blocks] == [(0, "info", ""), (2, "info", ""), (2, "req", "B")]
    assert blocks[1].body.startswith("onetwo\n\n---\n\n- x\n- y") and "code" in blocks[1].body and blocks[2].attrs == {"s": 1}
    with pytest.raises(markdown.MarkdownError):
        markdown.parse("# A: b\n```attr\ns: 1\n```\n")


def test_rewrite_and_render(tmp_path):
    text = "A-1~1 stays\n\n```attr\ntrace: [A-1~1, A-1~10]\n```\n"
    assert sinks.rewrite_refs(text, {"A-1~1": "A-1~2"}) == (text.replace("[A-1~1,", "[A-1~2,"), 1)
    doc = sinks.markdown("T", "generated", [{"id": "A-1", "title": "t", "status": "approved", "trace": ["B-1~2"], "attrs": {"k": "yes", "n": 3, "l": ["a b"]}, "body": "x"}])
    blocks, _, _ = markdown.parse(doc)
    assert blocks[-1].attrs == {"status": "approved", "k": "yes", "n": 3, "l": ["a b"], "trace": ["B-1~2"]}
    f = str(tmp_path / "d/x.md")
    assert sinks.write_if_changed(f, doc, "generated") and not sinks.write_if_changed(f, doc, "generated")
    (tmp_path / "d/x.md").write_text("by hand")
    with pytest.raises(FileExistsError):
        sinks.write_if_changed(f, doc, "generated")


def test_bundle_and_csv(spark, tmp_path):
    item = {"native-id": "1", "title": "t"}
    assert readers.read_bundle(sinks.bundle([{"id-prefix": "P-", "requirements": [item, {"native-id": "2", "parent": "1", "native-trace": ["1"]}]}]))[0]["id-prefix"] == "P-"
    for bad in ({"x": 1}, {"requirements": [item, item]}, {"requirements": [{**item, "native-trace": ["9"]}]}):
        with pytest.raises(ValueError):
            readers.read_bundle(json.dumps({"documents": [bad]}))
    (tmp_path / "b.csv").write_text('No,Head,Links,Prio\n7,Brake,"SYS-001; 3|x-2",high\n,section,,\n')
    r = readers.read_csv(spark, str(tmp_path / "b.csv"), "No", "Head", "Links", attrs={"prio": "Prio"}).collect()
    assert [(x["native_id"], x["trace"], x["native_trace"], x["attrs"]) for x in r] == [("7", ["SYS-001"], ["3", "x-2"], {"prio": "high"})]


def test_filters(spark):
    df = spark.createDataFrame([("A", ["x", "y"], 3, None), ("B", [], 1, "q"), ("C", None, 2, "r")], "id string, tags array<string>, n int, s string")

    def ids(text, **kw):
        return "".join(sorted(r["id"] for r in df.filter(expr.Filter(text, df.schema, **kw).column).collect()))

    assert ids("'x' in tags") == "A" and ids("'x' not in tags") == "BC" and ids("s == nil") == "A" and ids("s != 'q'") == "AC"
    assert ids("n > 1 and not (n == 3)") == "C" and ids("len(id) == 1 && n <= 2") == "BC"
    assert ids("any(tags, # == 'y')") == "A" and ids("all(tags, {# == 'y'})") == "BC" and ids("count(tags, {true}) == 2") == "A"
    assert ids("nothing == nil", relaxed=True) == "ABC"
    for bad in ("nothing == 1", "n", "n ==", "(n > 1", "n > 'a'", "'a' in n", "1 +"):
        with pytest.raises(expr.ExpressionError):
            expr.Filter(bad, df.schema)
    with pytest.raises(Exception, match="nil"):
        ids("s startsWith 'q'")


def test_filters_on_declared_attributes(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("a/schema.yaml", "$schema: x\nx-t: {document-id: a}\nproperties:\n  prio: {type: string}\n  size: {type: integer}\n  tags: {type: array}\n  ratio: {type: number}\n  ok: {type: boolean}\n")
    put("a/a.md", "".join(f"## A-{i}: T\n\n```attr\n{x}\n```\n\n" for i, x in enumerate([
        "prio: high\nsize: 3\ntags: [x, 3]\nok: true\nratio: 1.5", "prio: low\nsize: 12\ntags: []\nok: false", "prio: 3\nsize: big\nother: 1", "status: draft\nprio: null\ntags: [xy, {m: 1}, null]",
    ])))
    p = Project(spark, str(tmp_path))

    def ids(text, **kw):
        return "".join(sorted(r["id"][-1] for r in p.matching(text, **kw).collect()))

    assert ids("prio == 'high'") == "0" and ids("prio != 'high'") == "123" and ids("prio == 3") == "2" and ids("prio == '3'") == "" and ids("prio == nil") == "3" and ids("prio in ['low', 3]") == "12"
    assert ids("size == 3") == "0" and ids("size != nil and (size == 'big' or size == 12)") == "12" and ids("size == '3'") == "" and ids("prio in ['high', 'low'] and size < 10") == "0" and ids("prio == 'low' and size >= 12.0") == "1"
    assert ids("'x' in tags") == "0" and ids("3 in tags") == "0" and ids("'3' in tags") == "" and ids("tags == nil") == "2" and ids("tags != nil and len(tags) == 0") == "1" and ids("any(tags, {# == 'xy'})") == "3" and ids("tags == []") == "1"
    assert ids("ok") == "0" and ids("ok == false") == "1" and ids("ratio == 1.5") == "0" and ids("prio in ['high'] and prio startsWith 'hi'") == "0"
    assert ids("status == 'draft' or title == 'X'") == "3" and ids("prio == size") == "3" and ids("count(filter(tags, {# == 'x' or # == 3}), {true}) == 2") == "0"
    for bad in ("other == 1", "priority == 'high'", "doc_path == 'a'", "verify == nil"):
        with pytest.raises(expr.ExpressionError):
            p.matching(bad)
    assert ids("other == 1", relaxed=True) == "2" and p.filter_warnings("other == 1 or nowhere == 2 or prio == 'x'") == ['unknown attribute "nowhere"', 'attribute "other" is declared by no schema']
    with pytest.raises(Exception, match="another type"):
        ids("size < 5")
    assert {(r["attr"], r["value"], r["n"]) for r in p.histogram().collect()} == {("prio", "high", 1), ("prio", "low", 1), ("size", "big", 1)}
    assert {r["attr"]: r["values"] for r in p.facets().collect()} == {"prio": "3,high,low", "size": "12,3,big", "tags": "3,x,xy", "ok": "false,true"}
    assert {r["id"] for r in p.ls("prio == 'high'").filter("kind = 'req'").collect()} == {"A-0"} and p.check(filter="prio == 'high'").count() >= 0


def test_what_cannot_be_read_is_a_finding(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("s/a/schema.yaml", "$schema: x\nx-t: {document-id: one}\n")
    put("s/a/good.md", "## A-1: T\n\n```attr\nstatus: approved\ntrace: [one/B-1]\n```\n")
    put("s/a/front.md", "---\n{a: [\n---\n## A-2: T\n")
    put("s/a/list.md", "---\n- a\n---\n## A-3: T\n")
    put("s/b/schema.yaml", "$schema: x\nx-t: {document-id: one}\n")  # the last document of an id counts
    put("s/b/b.md", "## B-1: T\n\n```attr\nstatus: approved\n```\n")
    put("s/c/schema.yaml", "a: [\n")
    put("s/d/schema.yaml", "- a\n")
    put("r/x.ctrf.json", '{"a": 1}')
    put("r/y.json", json.dumps({"results": {"tests": [{"name": "free", "status": "passed", "extra": {"x-t": {}}}]}}))
    p = Project(spark, str(tmp_path / "s"), str(tmp_path / "r"))
    found = p.check().collect()
    codes = {(r["code"], r["level"]) for r in found}
    assert {r["file"] for r in found if r["code"] == "parse"} == {"a/front.md", "a/list.md", "c/schema.yaml", "d/schema.yaml"}
    assert not [r for r in found if r["code"] == "config"] and {("unbound-result", "WARNING"), ("results", "ERROR")} <= codes and ("broken-ref", "WARNING") not in codes
    left = {r["code"] for r in p.check(ignore_unbound=True).collect()}
    assert {"parse", "results"} <= left and "unbound-result" not in left and checks.exit_code(p.check()) == 2
    assert [(r["from_id"], r["to_id"]) for r in p.model.derived["edges"].collect()] == [("A-1", "B-1")]


def test_symbols(spark, tmp_path):
    src = {
        "a.py": '# top\nLIMIT = 3\n\n# does f\ndef f():\n    """Doc.\n\n    x:trace REQ-1\n    """\n\nclass C:\n    def m(self): pass\n',
        "b.go": "package p\n\n// Run runs.\nfunc Run() {\n\tconst inner = 1\n}\n\nfunc (s *Srv) Stop() {}\n\ntype Srv struct{}\n\nvar _ = 1\nconst Max = 2\n",
        "c.rs": "/// Point\npub struct Point { x: i32 }\nimpl Point {\n    pub fn new() -> Self { Point { x: 1 } }\n}\nfn free() {}\nconst K: i32 = 1;\nstatic S: i32 = 2;\n",
        "d.c": "#define N 3\nint f(int a);\nint g(int a) {\n  return a;\n}\nstruct S { int x; };\ntypedef int T;\nint v = 1;\n",
        "e.cpp": "class K {\n public:\n  int m(int a) {\n    return a;\n  }\n};\nusing U = int;\nvoid h() {\n}\n",
        "bad.py": "def (",
        "vendor/z.py": "X = 1\n",
    }
    for name, text in src.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    s = symbols.read_symbols(spark, str(tmp_path))
    got = {(r["file"].rpartition("/")[2], r["kind"], r["receiver"] or "", r["name"]) for r in s.filter("error IS NULL").collect()}
    assert got == {
        ("a.py", "const", "", "LIMIT"), ("a.py", "function", "", "f"), ("a.py", "class", "", "C"), ("a.py", "method", "C", "m"),
        ("b.go", "function", "", "Run"), ("b.go", "method", "*Srv", "Stop"), ("b.go", "type", "", "Srv"), ("b.go", "const", "", "Max"),
        ("c.rs", "type", "", "Point"), ("c.rs", "method", "Point", "new"), ("c.rs", "function", "", "free"), ("c.rs", "const", "", "K"), ("c.rs", "static", "", "S"),
        ("d.c", "macro", "", "N"), ("d.c", "function", "", "g"), ("d.c", "type", "", "S"), ("d.c", "type", "", "T"), ("d.c", "var", "", "v"),
        ("e.cpp", "type", "", "K"), ("e.cpp", "method", "K", "m"), ("e.cpp", "type", "", "U"), ("e.cpp", "function", "", "h"),
    }
    assert s.filter("error IS NOT NULL").count() == 1
    n = {r["native_key"]: r for r in symbols.native_ids(s).collect()}
    assert n["*Srv.Stop"]["parent"] == "Srv" and n["f"]["trace"] == ["REQ-1"] and "does f" in n["f"]["doc"] and n["Run"]["doc"] == "Run runs."
    assert len(short_hash_text("p", "n")) == 7 and short_hash_text("x", "y") != short_hash_text("xy", "")


def test_streams(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "path string, mtime long")
    new = spark.createDataFrame([("a", 2), ("c", 1)], "path string, mtime long")
    assert {(r["path"], r["op"]) for r in streams.snapshot_changes(old, new).collect()} == {("a", "modify"), ("b", "delete"), ("c", "add")}
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("path string").json(str(tmp_path / "in"))
    q = streams.rebuild_on_change(stream, lambda s, i: s.range(7 + i), "rebuilt", str(tmp_path / "ck"), "0 seconds")
    (tmp_path / "in/x.json").write_text('{"path": "p"}\n')
    q.processAllAvailable()
    q.stop()
    assert spark.table("rebuilt").count() == 7


def test_report_shape(spark):
    df = spark.createDataFrame([('{"results": {}}',), ('{"results": []}',), ("x",)], "v string")
    assert [r[0] for r in df.select(readers.looks_like_report(F.col("v"))).collect()] == [True, False, False]


def test_import_build_and_guards():
    doc = {"id-prefix": "P-", "dir": "pkg", "requirements": [{"native-id": "2", "parent": "1", "native-trace": ["1"]}, {"native-id": "1", "title": "top", "attrs": {"k": "v"}}]}
    text = imports.build([doc])["pkg/requirements.md"]
    blocks, _, _ = markdown.parse(text)
    assert [(b.level, b.id, b.attrs.get("trace")) for b in blocks if b.kind == "req"] == [(2, "P-1", []), (3, "P-2", ["P-1"])]
    bad = {"id-prefix": "P-", "dir": "../x", "file": "a/b", "requirements": [{"native-id": "a b", "title": "x\ny", "attrs": {"1 k": 1}, "body": "```attr\n```"}]}
    assert len(imports.guard([bad, bad])) == 13
    with pytest.raises(ValueError):
        imports.by_depth([{"native-id": "1", "parent": "2"}, {"native-id": "2", "parent": "1"}])


def test_texts(spark):
    one = spark.createDataFrame([("T-1", "c", "TC:x")], "t string, c string, tc string")
    r = one.select(T.result_id(F.col("t"), F.col("c")).alias("a"), T.result_id(F.col("t"), F.lit("")).alias("b"), T.case_of(F.lit("RESULT:T-1#c"), F.col("t")).alias("d"), T.case_of(F.lit("RESULT:x"), F.col("tc")).alias("e"), T.schema_title(F.lit("i"), F.lit("t")).alias("f")).first()
    assert tuple(r) == ("RESULT:T-1#c", "RESULT:T-1", "c", "x", "i — t")
    sel = {"a": ["x:y", "&"], "state.coverage": ["covered"]}
    assert T.decode_filters("?" + T.encode_filters(sel)) == sel
    assert T.ordered_properties(["z", "b"], ["a", "b", "z"], ["trace", "a"]) == ["z", "b", "a", "trace"]


def test_manual_results_and_config(spark):
    blocks = spark.createDataFrame([("req", "R-1", ["M-1~2"], '{"x-tool.outcome": "pass", "x-tool.verified-at": "2024-02-30"}', "f", 3), ("req", "R-2", [], '{"x-tool.outcome": "fail", "x-tool.verified-at": "2024-02-03"}', "f", 4), ("req", "R-3", [], None, "f", 5)], "kind string, id string, trace array<string>, attrs string, file string, ord long")
    got = {r["measure_id"]: (r["outcome"], str(r["verified_at"])[:10]) for r in readers.manual_results(blocks).collect()}
    assert got == {"M-1~2": ("pass", "None"), "R-2": ("fail", "2024-02-03")}
    assert len(readers.config_errors({"a": {"x-t": {"requires-trace-from": 3, "additional-status-values": [""]}}})) == 3


def test_documents_results_and_configuration_are_connected(spark, tmp_path):
    def put(path, text):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("spec/sys/schema.yaml", "$schema: x\nx-tool:\n  document-id: sys\n  additional-status-values: 3\nx-other:\n  document-id: no\nproperties:\n  prio: {type: integer}\n  variant: {type: array, items: {type: string}}\n")
    put("spec/sys/a.md", "---\nowner: me\nteam: one\n---\n# First\n\n## S-1: Top\n\n```attr\nverify: Test\nprio: high\nvariant: [Base]\n```\n\n### S-2: Below\n\n```attr\nstatus: draft\ntool-suppress: [untraced]\nvariant: [Sport]\n```\n\n## Loose\n\n### More\n")
    put("spec/sys/b.md", "---\nteam: two\nsince: 2020\n---\n# Second\n\n## S-3: Other\n\n```attr\nverify: Review\nversion: 2\n```\n")
    put("res/manual/schema.yaml", "$schema: x\nx-tool:\n  document-id: res\n")
    put("res/manual/r.md", "## R-1: Review\n\n```attr\ntrace: [S-3~1]\nx-tool.outcome: pass\nx-tool.verified-at: 2024-02-03\n```\n")
    put("res/run.json", json.dumps({"results": {"suite": "s", "tests": [{"name": "t", "status": "failed", "extra": {"x-tool": {"verifies": ["S-1"]}}}, {"name": "u", "status": "passed", "extra": {"x-tool": {}}}]}}))
    put("res/other.json", "{}")
    put("res/bad.ctrf.json", "[]")
    with pytest.raises(ValueError, match="name the tool"):
        Project(spark, str(tmp_path / "spec"))
    p = Project(spark, str(tmp_path / "spec"), str(tmp_path / "res"), tool="tool")
    d = p.documents().first()
    assert (d["title"], d["meta"]) == ("First", {"owner": "me", "team": "one", "since": "2020"})
    assert {(r["id"], r["parent_id"], r["kind"]) for r in p.model.nodes.collect()} == {("S-1", None, "req"), ("S-2", "S-1", "req"), (None, None, "container"), (None, None, "info"), ("S-3", None, "req")}
    found = {(r["code"], r["req_id"]) for r in p.check(disjoint=("variant",)).collect()}
    assert {("config", ""), ("schema", "S-1"), ("failing-verdict", "S-1"), ("verdict", "S-3"), ("version-pin", "RESULT:S-3"), ("unbound-result", ""), ("disjoint", "S-2")} <= found
    assert ("untraced", "S-2") not in found
    assert not p.check(ignore_unbound=True).filter("code = 'unbound-result'").count()
    assert checks.exit_code(p.check()) == 1
    got = {r["attr"]: (r["declared"], r["found"]) for r in p.attributes().collect()}
    assert got["prio"] == (True, 1) and got["verify"][1] == 2
    latest, warned = readers.read_latest(spark, str(tmp_path / "res"), "tool")
    assert {(r["measure_id"], r["case_key"], r["outcome"]) for r in latest.collect()} == {("TC:s/t", "s/t", "fail"), ("S-3", "", "pass")} and warned.count() == 2
    assert sinks.list_text(p.ls()).count("\n") == 5 and "requirements" in sinks.stats_text(p.stats())
    assert sinks.findings_json(p.check()).count() == p.check().count()
    blocks, errors = readers.read_file(spark, str(tmp_path / "spec/sys/b.md"), str(tmp_path / "spec/sys/schema.yaml"), "tool")[:2], None
    assert blocks[0].count() == 1 and blocks[1].count() == 0
    sinks.csv(p.blocks, str(tmp_path / "csv"), ["status"], verify.rollup(p.model).join(verify.representative(p.model), "id", "left"))
    assert "Verdict Source" in next((tmp_path / "csv").glob("part-*")).read_text()


def test_reports_of_changes(spark):
    a = spark.createDataFrame([("d/x", "A", "1"), ("d/x", "B", "1")], "doc_path string, id string, v string")
    b = spark.createDataFrame([("d/x", "A", "2"), ("d/y", "C", None)], "doc_path string, id string, v string")
    text = sinks.diff_text(diff.requirements(a, b, ["doc_path", "id"], ["v"]), diff.attributes(a, b, ["doc_path", "id"], ["v"]), "v1", "v2", submodules=diff.submodules(spark.createDataFrame([("m", "0" * 40)], "path string, sha string"), spark.createDataFrame([("m", "1" * 40)], "path string, sha string")))
    assert "  ~ A  (modified)\n      v: 1 → 2\n  - B  (removed)" in text and "--- y/ ---\n  + C  (added)" in text and "updated m: 0000000 → 1111111" in text and text.endswith("Summary: 1 added, 1 removed, 1 modified, 0 unchanged\n")
    d = spark.createDataFrame([("f", "A-1", "B-1~1", "outdated", "B-1~2"), ("f", "A-1", "x/B-2", "unpinned", "x/B-2~1")], "file string, req_id string, source_ref string, kind string, new_ref string")
    assert sinks.repin_text(d) == "f  A-1  B-1 → B-1~2\nf  A-1  x/B-2 → x/B-2~1\n1 outdated, 1 unpinned, 0 predated across 1 files.\n"
    assert sinks.repin_text(d.limit(0)) == "no version-pin changes needed\n"


def test_large_files_parse_alike_in_parts():
    text = "---\na: 1\n---\n# T\n\nintro\n\n" + "".join(f"## R-{i}: t\n\n```attr\nversion: {i}\n```\n\nBody {i}.\n\n### Sub {i}\n\n```md\n## not: one\n```\n\n" for i in range(60))
    whole = markdown.parse(text)
    parts = markdown.split_roots(text, 400)
    got = [markdown.parse(p) for p in parts]
    assert len(parts) > 5 and [b for g in got for b in g[0]] == whole[0] and got[0][1:] == whole[1:]


def test_hashes_links_and_streams(spark, tmp_path):
    df = spark.createDataFrame([("p", "n"), ("", "é x"), ("a/b", "")], "p string, n string")
    assert [r["h"] for r in df.select(short_hash(F.col("p"), F.col("n")).alias("h")).collect()] == [short_hash_text("p", "n"), short_hash_text("", "é x"), short_hash_text("a/b", "")]
    one = spark.range(1).select(T.relative_link(F.lit("a/b/x.html"), F.lit("c/y.html"), F.lit("I-1")).alias("a"), T.relative_link(F.lit("x.html"), F.lit("x.html"), F.lit("I")).alias("b"), T.attribute_label(F.lit("disposition-reason")).alias("c"), T.format_scalar(F.lit("1.0E-7"), F.lit("DOUBLE")).alias("d"), T.format_scalar(F.lit("3"), F.lit("BIGINT")).alias("e")).first()
    assert tuple(one) == ("../../c/y.html#I-1", "#I", "Disposition reason", "0.0000001", "3")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("path string").json(str(tmp_path / "in"))
    told = []
    before = sum(streams.failures.values())
    q = streams.notify(stream, [lambda i: 1 / 0, told.append], str(tmp_path / "ck"), "0 seconds")
    (tmp_path / "in/x.json").write_text('{"path": "p"}\n')
    q.processAllAvailable()
    q.stop()
    assert sum(streams.failures.values()) == before + 1
    assert told == [0] and streams.watched_folders("r/x.json", False) == ["r"] and streams.watched_folders("r/", True) == ["r"]
