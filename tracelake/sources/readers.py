"""Readers: requirement trees, test reports, exchange bundles and CSV into the core relations.

Files are found and read by Spark (one partition list over the whole tree) and
parsed on the executors; the driver sees only the schema files' rows.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import refs as R
from tracelake.model import DOCUMENTS, Model, cut
from tracelake.operators import schema as schemas_
from tracelake.operators import tree, verify
from tracelake.sources import markdown

PARSED = (
    "file string, ord bigint, level int, kind string, id string, title string, body string, rationale string, suppressions array<string>, trace array<string>, "
    "requires_trace_from array<string>, status string, version int, verify string, disposition string, disposition_reason string, attrs string, doc_title string, error string, front string"
)
PROMOTED = ("trace", "requires-trace-from", "status", "version", "verify", "disposition", "disposition-reason")


def _text(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), "value")


def _strings(v: object) -> list[str] | None:
    return None if v is None else [x for x in v if isinstance(x, str)] if isinstance(v, list) else [v] if isinstance(v, str) else []


def _fits(name: str, value: object) -> bool:
    """Whether an attribute has a column that holds its value whole."""
    if name in ("trace", "requires-trace-from"):
        return isinstance(value, list) and all(isinstance(x, str) for x in value)
    return name in PROMOTED and (isinstance(value, int) and not isinstance(value, bool) if name == "version" else isinstance(value, str))


def _parser(tool: str | None):
    return lambda batches: _parse(batches, tool)


def _parse(batches: Iterator[pd.DataFrame], tool: str | None) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PARSED.split(", ")]
    for batch in batches:
        rows = []
        for path, text in zip(batch["path"], batch["value"]):
            try:
                blocks, title, front = [], "", {}
                for part in markdown.split_roots(text):  # a large file is worked on part by part
                    got, t, f = markdown.parse(part, path, tool)
                    blocks, title, front = blocks + got, title or t, front or f
            except markdown.MarkdownError as e:
                rows.append(dict.fromkeys(names) | {"file": path, "ord": -1, "kind": "error", "error": str(e)})
                continue
            for k, b in enumerate(blocks):
                a = b.attrs
                text_of = lambda n, a=a: a[n] if isinstance(a.get(n), str) else None
                version = a.get("version")
                rest = {x: y for x, y in a.items() if not _fits(x, y)}
                rows.append({
                    "file": path, "ord": k, "level": b.level, "kind": b.kind, "id": b.id or None, "title": b.title, "body": b.body, "rationale": b.rationale, "suppressions": b.suppressions,
                    "trace": _strings(a.get("trace")) or [], "requires_trace_from": _strings(a.get("requires-trace-from")), "status": text_of("status"),
                    "version": int(version) if isinstance(version, (int, float)) and not isinstance(version, bool) else 0, "verify": text_of("verify"), "disposition": text_of("disposition"),
                    "disposition_reason": text_of("disposition-reason"), "attrs": json.dumps(rest, default=str, sort_keys=True) if rest else None, "doc_title": title, "error": None, "front": json.dumps(front, default=str, sort_keys=True) if front and not k else None,
                })
        yield pd.DataFrame(rows, columns=names).astype({"ord": "Int64", "level": "Int32", "version": "Int32"})


def extension(schema: dict, tool: str | None = None) -> dict:
    """The map under ``x-<tool>``; without ``tool``, the only map under an ``x-`` key, and an error if there are several."""
    found = {k: v for k, v in schema.items() if k.startswith("x-") and isinstance(v, dict) and tool in (None, k[2:])}
    if len(found) > 1:
        raise ValueError(f"{', '.join(sorted(found))}: name the tool")
    return next(iter(found.values()), {})


def document_row(doc_path: str, doc_ord: int, schema: dict, tool: str | None = None) -> tuple:
    """A row of ``documents`` from a schema."""
    x = extension(schema, tool)
    up = x["upstream"] if isinstance(x.get("upstream"), dict) else {}
    return (doc_path, doc_ord, x.get("document-id") or "", x.get("level") or "", x.get("id-prefix") or "", bool(x.get("external")), bool(x.get("mandatory-disposition")), bool(x.get("ignore-status")), _strings(x.get("requires-trace-from") or ([] if x.get("requires-trace-from") == [] else None)), _strings(up.get("sources")) or [])


def read_tree(spark: SparkSession, root: str, tool: str | None = None) -> tuple[Model, DataFrame, dict[str, dict]]:
    """(model, parsed blocks, schemas) of every directory under ``root`` that holds a ``schema.yaml``; paths relative to it.

    Files of a directory count in name order; a directory below a document
    belongs to it only if it has a schema of its own. ``tool`` is the name in
    extension keys (``x-<tool>``, ``<tool>-suppress``); see ``extension``. The
    blocks are written once to the shared checkpoint folder, so that no check
    parses the files again.
    """
    found = {r["path"].rpartition("/")[0]: markdown.load_schema(r["value"]) for r in _text(spark, root, "schema.yaml").collect()}
    if not found:
        raise ValueError(f"no documents under {root}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    relative = lambda d: d.partition(base)[2].lstrip("/") or "."
    schemas = {relative(d): s for d, s in found.items()}
    documents = spark.createDataFrame([document_row(d, i, schemas[d], tool) for i, d in enumerate(sorted(schemas))], DOCUMENTS)
    below = F.substr("file", F.instr("file", base) + len(base) + 1)
    blocks = _text(spark, root, "*.md").mapInPandas(_parser(tool), PARSED).withColumn("file", below)
    blocks = blocks.withColumn("doc_path", F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "")).otherwise("."))
    blocks = cut(blocks.join(F.broadcast(documents.select("doc_path")), "doc_path", "left_semi"))
    blocks = with_parents(blocks)
    nodes = blocks.filter("kind <> 'error'").select("doc_path", "file", "ord", "kind", "id", "title", "status", "version", "verify", "disposition", "disposition_reason", "suppressions", "requires_trace_from", "parent_id", "trace", "attrs")
    refs = blocks.filter("kind = 'req'").select(F.col("id").alias("from_id"), F.posexplode("trace").alias("pos", "ref")).select("from_id", (F.col("pos") + 1).alias("pos"), "ref")
    return Model(documents, nodes, refs), blocks, schemas


def with_parents(blocks: DataFrame) -> DataFrame:
    """Adds parent_id: the id of the requirement around a nested one; and makes info blocks with children containers."""
    good = blocks.filter("kind <> 'error'")
    t = tree.requirement_parents(good.select("file", "ord", "level", "kind", "id"))
    up = good.select("file", F.col("ord").alias("req_parent_ord"), F.col("id").alias("parent_id"))
    own = t.join(up, ["file", "req_parent_ord"], "left").select("file", "ord", "parent_id")
    kinds = tree.promote_containers(good.select("file", "ord", "level", "kind")).select("file", "ord", F.col("kind").alias("_kind"))
    return cut(blocks.join(own, ["file", "ord"], "left").join(kinds, ["file", "ord"], "left").withColumn("kind", F.coalesce("_kind", "kind")).drop("_kind"))


def document_meta(blocks: DataFrame) -> DataFrame:
    """doc_path, title (of its first file alone), meta: frontmatter of all its files, the first file that has a key wins."""
    files = blocks.groupBy("doc_path", "file").agg(F.max("doc_title").alias("title"), F.max("front").alias("front"))
    title = files.groupBy("doc_path").agg(F.min_by(F.coalesce("title", F.lit("")), "file").alias("title"))
    keys = files.select("doc_path", "file", F.explode(F.from_json("front", "map<string,string>")).alias("k", "v")).groupBy("doc_path", "k").agg(F.min_by("v", "file").alias("v"))
    meta = keys.groupBy("doc_path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("meta"))
    return title.join(meta, "doc_path", "left")


def read_file(spark: SparkSession, path: str, schema: str, tool: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, schema errors) of a single file under a given schema file: no graph, so no graph checks."""
    text = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), "value")
    blocks = cut(text.mapInPandas(_parser(tool), PARSED).withColumn("doc_path", F.lit(".")))
    rules = markdown.load_schema(spark.read.text(schema, wholetext=True).first()["value"])
    if isinstance(rules, markdown.Unreadable):
        raise ValueError(rules.error)
    nodes = with_parents(blocks).filter("kind <> 'error'")
    return blocks, schemas_.schema_errors(Model(spark.createDataFrame([], DOCUMENTS), nodes, nodes.limit(0).select(F.col("id").alias("from_id"), F.lit(1).alias("pos"), F.col("id").alias("ref"))), {".": rules})


#: A test report's shape; the binding block is the map under an ``x-`` key of ``extra``.
REPORT = "results struct<suite: string, tests: array<struct<name: string, suite: string, status: string, flaky: boolean, start: bigint, stop: bigint, extra: map<string, string>>>>"
BINDING = "id string, `case` string, verifies array<string>, description string"


def read_reports(spark: SparkSession, root: str, tool: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, warnings) under ``root``: test reports, by name or by shape, and results written by hand, wherever there is a schema.

    Other files are left out, but a ``*.ctrf.json`` that is no report is among the warnings, as ``not a report``, and an error to ``check``.
    """
    files = _text(spark, root, "*.json")
    report = looks_like_report(F.col("value"))
    found, warnings = bind_reports(files.filter(report), tool)
    named = files.filter(F.col("path").endswith(".ctrf.json") & ~report).select(F.concat(F.lit("not a report: "), "path").alias("message"), F.col("path").alias("source"))
    if _text(spark, root, "schema.yaml").limit(1).count():
        _, blocks, _ = read_tree(spark, root, tool)
        found = found.unionByName(manual_results(blocks, tool), allowMissingColumns=True)
    return found, warnings.unionByName(named)


def read_latest(spark: SparkSession, root: str, tool: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the latest result of each target and case, warnings) under ``root``."""
    found, warnings = read_reports(spark, root, tool)
    return verify.latest(found), warnings


def _owned(entries: str, end: str, tool: str | None) -> str:
    """SQL: the member of a map under ``x-<tool>`` + ``end``; without ``tool``, the only one under an ``x-`` key, null if there are several."""
    if tool is not None:
        return f"try_element_at({entries}, 'x-{tool}{end}')"
    own = f"map_values(map_filter({entries}, (k, v) -> k RLIKE '^x-[^.]*{end.replace('.', '[.]')}$'))"
    return f"if(size({own}) = 1, {own}[0], null)"


def bind_reports(files: DataFrame, tool: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, warnings) of reports (path, value): a test bound to an id, to a case that verifies ids, or unbound; tests without a block count for nothing."""
    doc = files.select("path", F.from_json("value", REPORT).alias("r")).filter("r.results IS NOT NULL")
    t = doc.select("path", F.col("r.results.suite").alias("suite"), F.posexplode("r.results.tests").alias("k", "t"))
    t = t.filter(F.col("t.extra").isNotNull()).withColumn("b", F.from_json(F.expr(_owned("t.extra", "", tool)), BINDING)).filter("b IS NOT NULL")
    own = F.coalesce(F.nullif(F.col("b.case"), F.lit("")), R.case_key(F.coalesce("suite", "t.suite"), F.col("t.name")))
    by_id = F.coalesce(F.col("b.id"), F.lit("")) != ""
    bound = by_id | (F.size(F.coalesce("b.verifies", F.array().cast("array<string>"))) > 0)
    x = t.withColumns({"measure_id": F.when(by_id, F.col("b.id")).otherwise(F.concat(F.lit("TC:"), own)), "case_key": F.when(by_id, F.coalesce("b.case", F.lit(""))).otherwise(own), "bound": bound})
    results = x.filter("bound").select(
        "measure_id", "case_key", F.col("b.verifies").alias("verifies"), F.col("t.name").alias("name"), F.col("b.description").alias("description"), R.ctrf_outcome(F.col("t.status"), F.col("t.flaky")).alias("outcome"),
        R.epoch_ms(F.col("t.stop"), F.col("t.start")).alias("verified_at"), F.col("path").alias("source"), F.col("k").cast("bigint").alias("load_ord"),
    )
    warnings = x.filter("NOT bound").select(F.concat(F.lit("unbound-result: "), F.coalesce("t.name", F.lit(""))).alias("message"), F.col("path").alias("source"))
    return results, warnings


def looks_like_report(value: Column) -> Column:
    """Whether a JSON text has an object, not an array, under ``results``."""
    return F.coalesce(F.trim(F.get_json_object(value, "$.results")).startswith("{"), F.lit(False))


_BUNDLE_KEYS = {"dir", "file", "title", "notice", "id-prefix", "level", "document-id", "upstream", "requires-trace-from", "external", "schema-id", "schema-title", "schema-description", "properties", "required", "requirements"}
_ITEM_KEYS = {"native-id", "title", "body", "status", "parent", "trace", "native-trace", "attrs"}


def read_bundle(text: str) -> list[dict]:
    """Documents of an exchange bundle; unknown fields, repeated native ids and unresolved native references are errors."""
    data = json.loads(text)
    unknown = set(data) - {"version", "format", "documents"}
    for d in data.get("documents", []):
        unknown |= set(d) - _BUNDLE_KEYS
        for r in d.get("requirements", []):
            unknown |= set(r) - _ITEM_KEYS
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    ids = [r["native-id"] for d in data["documents"] for r in d.get("requirements", [])]
    if len(ids) != len(set(ids)):
        raise ValueError(f"repeated native id {sorted(x for x in set(ids) if ids.count(x) > 1)}")
    lost = {t for d in data["documents"] for r in d.get("requirements", []) for t in [*r.get("native-trace", []), *filter(None, [r.get("parent")])]} - set(ids)
    if lost:
        raise ValueError(f"unknown native id {sorted(lost)}")
    return data["documents"]


def read_csv(spark: SparkSession, path: str, id_column: str, title_column: str, trace_column: str | None = None, body_column: str | None = None, parent_column: str | None = None, attrs: dict[str, str] | None = None) -> DataFrame:
    """Requirements of a CSV export: native_id, title, body, parent, trace, native_trace, attrs. Rows without an id are skipped."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    col = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) if c else F.lit("")
    links = F.filter(F.transform(F.split(col(trace_column), "[;|]"), lambda x: F.trim(x)), lambda x: x != "")
    m = F.create_map(*(y for k, c in (attrs or {}).items() for y in (F.lit(k), col(c)))) if attrs else F.create_map().cast("map<string,string>")
    d = d.select(col(id_column).alias("native_id"), col(title_column).alias("title"), col(body_column).alias("body"), col(parent_column).alias("parent"), links.alias("_l"), m.alias("attrs")).filter("native_id <> ''")
    own = lambda x: x.rlike(R.TRACE_ITEM)
    return d.select("native_id", "title", "body", "parent", F.filter("_l", own).alias("trace"), F.filter("_l", lambda x: ~own(x)).alias("native_trace"), "attrs")


def git_archive(repository: str, tag: str, target: str) -> str:
    """The tree of a tag, unpacked under ``target``."""
    archive = subprocess.run(["git", "-C", repository, "archive", tag], check=True, capture_output=True).stdout
    subprocess.run(["tar", "-x", "-C", target], check=True, input=archive)
    return target


def git_submodules(spark: SparkSession, repository: str, tag: str) -> DataFrame:
    """(path, sha) of the submodules at a tag."""
    out = subprocess.run(["git", "-C", repository, "ls-tree", "-r", "-t", tag], check=True, capture_output=True, text=True).stdout
    rows = [(p, meta.split()[2]) for meta, _, p in (x.partition("\t") for x in out.splitlines()) if meta.startswith("160000 commit")]
    return spark.createDataFrame(rows, "path string, sha string")


def manual_results(blocks: DataFrame, tool: str | None = None) -> DataFrame:
    """Results written as requirements: an ``x-<tool>.outcome`` attribute; the measure is the first trace, else the own id; the date ``verified-at``."""
    values = lambda end: F.expr(_owned("from_json(attrs, 'map<string,string>')", f".{end}", tool))
    x = blocks.filter("kind = 'req' AND attrs IS NOT NULL").withColumn("outcome", values("outcome")).filter("outcome IS NOT NULL")
    return x.select(
        F.coalesce(F.get("trace", F.lit(0)), F.col("id")).alias("measure_id"), F.lit("").alias("case_key"), "outcome",
        F.try_to_timestamp(values("verified-at"), F.lit("yyyy-MM-dd")).alias("verified_at"), F.col("file").alias("source"), F.col("ord").alias("load_ord"),
    )


def config_errors(schemas: dict[str, dict], tool: str | None = None) -> list[str]:
    """Schemas that can't be compiled, malformed extension blocks (status additions and coverage defaults that aren't lists of texts), a missing ``$schema``."""
    bad = []
    for d, s in sorted(schemas.items()):
        if isinstance(s, markdown.Unreadable):  # a parse error
            continue
        try:
            x = extension(s, tool)
        except ValueError as e:
            bad.append(f"{d}: {e}")
            continue
        bad += [f"{d}: {x}" for x in schemas_.problems(s)]
        if "$schema" not in s:
            bad.append(f"{d}: $schema is missing")
        for key in ("additional-status-values", "requires-trace-from"):
            v = x.get(key, [])
            if not isinstance(v, str) and not (isinstance(v, list) and all(isinstance(i, str) and i for i in v)):
                bad.append(f"{d}: {key} must be a text or a list of texts")
    return bad
