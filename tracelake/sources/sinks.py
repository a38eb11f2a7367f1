"""Sinks: NDJSON tables, CSV, property graph, Markdown documents, in-place pin rewrite, reports."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import refs as R
from tracelake.model import Model
from tracelake.operators import checks, graph


def ndjson(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON object a line, every column in every row, range-partitioned by ``order``: the files in name order are sorted."""
    df.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def requirements(blocks: DataFrame) -> DataFrame:
    """The export's rows of all blocks: promoted attributes, the others as JSON text or null."""
    return blocks.filter("kind <> 'error'").select(
        "doc_path", "file", "ord", "kind", F.coalesce("id", F.lit("")).alias("id"), "title", "status", "version", "verify", "disposition",
        F.col("disposition_reason").alias("disposition-reason"), "trace", F.col("requires_trace_from").alias("requires-trace-from"), "body", "rationale", "attrs",
    )


def csv(blocks: DataFrame, path: str, properties: list[str], verdicts: DataFrame | None = None) -> None:
    """Type, ID, Title, the properties in order, Body, Rationale and, if given, Verdict, Verdict Source, Verdict Cases (``verdicts``: id, verdict[, source, cases])."""
    own = {"status": F.col("status"), "version": F.col("version").cast("string"), "verify": F.col("verify"), "disposition": F.col("disposition"), "disposition-reason": F.col("disposition_reason"), "trace": F.array_join("trace", ", "), "requires-trace-from": F.array_join("requires_trace_from", ", ")}
    cell = lambda p: F.coalesce(own[p] if p in own else F.get_json_object("attrs", f"$['{p}']"), F.lit(""))
    extra = [] if verdicts is None else [c for c in ("verdict", "source", "cases") if c in verdicts.columns]
    x = blocks if verdicts is None else blocks.join(verdicts.select("id", *extra), "id", "left")
    cols = [F.col("kind").alias("Type"), F.coalesce("id", F.lit("")).alias("ID"), F.col("title").alias("Title"), *(cell(p).alias(p) for p in properties), F.col("body").alias("Body"), F.col("rationale").alias("Rationale")]
    names = {"verdict": "Verdict", "source": "Verdict Source", "cases": "Verdict Cases"}
    cols += [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(names[c]) for c in extra]
    x.filter("kind <> 'error'").orderBy("file", "ord").select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def property_graph(m: Model, path: str, raw_refs: bool = False) -> None:
    """Parquet ``vertices`` (id, doc_path, file) and ``edges`` (src, dst).

    With ``raw_refs`` only references that are written exactly as an id make
    edges, so pinned and qualified ones don't; by default all resolved ones do.
    """
    v = graph.definitions(m).select("id", "doc_path", "file")
    if raw_refs:
        e = m.refs.join(v.select(F.col("id").alias("ref")), "ref", "left_semi").select(F.col("from_id").alias("src"), F.col("ref").alias("dst"))
    else:
        e = graph.trace_edges(m).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    v.write.mode("overwrite").parquet(f"{path}/vertices")
    e.distinct().write.mode("overwrite").parquet(f"{path}/edges")


def quote(text: str) -> str:
    """A YAML scalar that reads back as the same string."""
    plain = re.fullmatch(r"[A-Za-z0-9_./~-][A-Za-z0-9_./~ -]*", text) and text == text.strip() and not re.fullmatch(r"(?i)true|false|null|~|[-+.\d].*|yes|no|on|off|-.*", text)
    return text if plain else json.dumps(text, ensure_ascii=False)


def attr_block(status: str, trace: Iterable[str], attrs: dict[str, object]) -> str:
    """Status, the other attributes by name, then the trace list."""
    value = lambda v: "[" + ", ".join(quote(str(x)) for x in v) + "]" if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else quote(str(v))
    lines = ([f"status: {quote(status)}"] if status else []) + [f"{k}: {value(attrs[k])}" for k in sorted(attrs)]
    trace = list(trace)
    lines += ["trace:"] + [f"  - {quote(t)}" for t in trace] if trace else ["trace: []"]
    return "```attr\n" + "\n".join(lines) + "\n```"


def markdown(title: str, notice: str, items: Iterable[dict]) -> str:
    """A document of requirements (id, title, body, status, trace, attrs, depth), headings two levels below their depth."""
    parts = [f"# {title}", f"<!-- {notice} -->"] if notice else [f"# {title}"]
    for r in items:
        head = "#" * min(6, 2 + r.get("depth", 0)) + (f" {r['id']}: {r['title']}" if r.get("title") else f" {r['id']}")
        parts += [head, attr_block(r.get("status", ""), r.get("trace", ()), r.get("attrs", {}))] + ([r["body"]] if r.get("body") else [])
    return "\n\n".join(parts) + "\n"


def write_if_changed(path: str, text: str, marker: str) -> bool:
    """Write unless the bytes are the same; a file without the marker was made by hand and is never overwritten."""
    if os.path.exists(path):
        with open(path, encoding="utf-8", newline="") as f:
            old = f.read()
        if old == text:
            return False
        if marker not in old:
            raise FileExistsError(f"{path} wasn't generated")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return True


_ATTR_FENCE = re.compile(r"(?ms)^(```|~~~)[ \t]*attr[ \t]*\n(.*?)^\1[ \t]*$")


def rewrite_refs(text: str, changes: dict[str, str]) -> tuple[str, int]:
    """The text with whole references replaced inside attribute blocks only, and how many were."""
    if not changes:
        return text, 0
    ref = re.compile(r"(?<![^ \t\r\n,\[\"'])(" + "|".join(re.escape(c) for c in sorted(changes, key=len, reverse=True)) + r")(?![^ \t\r\n,\]\"'])")
    count = 0

    def block(m: re.Match) -> str:
        nonlocal count
        new, n = ref.subn(lambda r: changes[r[1]], m[2])
        count += n
        return m[0][: m.start(2) - m.start()] + new + m[0][m.end(2) - m.start() :]

    return _ATTR_FENCE.sub(block, text), count


def rewritten(files: DataFrame, deltas: DataFrame) -> DataFrame:
    """(file, text, replaced) of the files (file, text) that deltas (file, source_ref, new_ref) change; on the executors."""
    by = deltas.groupBy("file").agg(F.map_from_entries(F.collect_set(F.struct("source_ref", "new_ref"))).alias("m"))

    def run(batches):
        for b in batches:
            got = [rewrite_refs(t, dict(m)) for t, m in zip(b["text"], b["m"])]
            yield pd.DataFrame({"file": b["file"], "text": [g[0] for g in got], "replaced": [g[1] for g in got]})

    return files.join(by, "file").mapInPandas(run, "file string, text string, replaced long").filter("replaced > 0")


def bundle(documents: list[dict]) -> str:
    """Exchange-bundle JSON without empty fields."""
    bare = lambda x: {k: bare(v) for k, v in x.items() if v not in (None, "", [], {}, False)} if isinstance(x, dict) else [bare(v) for v in x] if isinstance(x, list) else x
    return json.dumps({"documents": [bare(d) for d in documents]}, ensure_ascii=False, indent=2) + "\n"


def findings_text(findings: DataFrame, most: int = 1000) -> tuple[str, int]:
    """A report of at most ``most`` findings, all counts, and the exit code: 2 with a file that can't be parsed, 1 with an error, else 0."""
    counts = {r["level"]: r["n"] for r in findings.groupBy("level").agg(F.count("*").alias("n")).collect()}
    lines = [f"{r['level']}: {r['req_id']}: {r['message']}" for r in findings.orderBy("req_id", "code", "message").limit(most).collect()]
    lines.append(f"{counts.get('ERROR', 0)} errors, {counts.get('WARNING', 0)} warnings")
    return "\n".join(lines), checks.exit_code(findings)


def findings_json(findings: DataFrame) -> DataFrame:
    """One JSON text a finding, in order, for any number of them."""
    return findings.orderBy("req_id", "code", "message").select(F.to_json(F.struct(*findings.columns)).alias("value"))


def list_text(nodes: DataFrame, most: int = 1000) -> str:
    """At most ``most`` nodes, one a line: kind, id, title, under their documents."""
    lines, doc = [], None
    for r in nodes.orderBy("doc_path", "file", "ord").limit(most).collect():
        if r["doc_path"] != doc:
            doc = r["doc_path"]
            lines.append(doc)
        lines.append("  " + "  ".join(x for x in (r["kind"], r["id"], r["title"]) if x))
    return "\n".join(lines)


def stats_text(stats: DataFrame) -> str:
    """One line a document, its counts by name."""
    names = [c for c in stats.columns if c != "doc_path"]
    return "\n".join(f"{r['doc_path']}: " + ", ".join(f"{r[c]} {c}" for c in names) for r in stats.orderBy("doc_path").collect())


def repin_text(deltas: DataFrame, most: int = 1000) -> str:
    """At most ``most`` references to rewrite in the order of file, requirement and reference, then all counts."""
    counts = {(r["file"], r["kind"]): r["n"] for r in graph.repin_summary(deltas).filter("file IS NULL").collect()}
    if not counts.get((None, None)):
        return "no version-pin changes needed\n"
    files = deltas.select("file").distinct().count()
    rows = deltas.orderBy("file", "req_id", "source_ref").limit(most).select("file", "req_id", R.strip_pin(F.col("source_ref")).alias("old"), "new_ref").collect()
    lines = [f"{r['file']}  {r['req_id']}  {r['old']} → {r['new_ref']}" for r in rows]
    n = {k: counts.get((None, k), 0) for k in ("outdated", "unpinned", "predated")}
    return "\n".join([*lines, ", ".join(f"{v} {k}" for k, v in n.items()) + f" across {files} files."]) + "\n"


def diff_text(changes: DataFrame, attrs: DataFrame, old: str, new: str, schemas: DataFrame | None = None, submodules: DataFrame | None = None, most: int = 1000) -> str:
    """At most ``most`` changes between two snapshots by document, with their attributes, then schemas, submodules and all counts."""
    mark = {"added": "+", "removed": "-", "modified": "~"}
    shown = changes.filter("category <> 'unchanged'").orderBy("doc_path", "id").limit(most)
    more: dict[tuple, list[str]] = {}
    for r in attrs.join(shown.filter("category = 'modified'").select("doc_path", "id"), ["doc_path", "id"], "left_semi").orderBy("attr").collect():
        text = f"{r['new_value']} (new)" if r["old_value"] is None else f"{r['old_value']} (removed)" if r["new_value"] is None else f"{r['old_value']} → {r['new_value']}"
        more.setdefault((r["doc_path"], r["id"]), []).append(f"      {r['attr']}: {text}")
    lines, doc = [f"=== Baseline Diff: {old} → {new} ==="], None
    for r in shown.collect():
        if r["doc_path"] != doc:
            doc = r["doc_path"]
            lines.append(f"--- {doc.rpartition('/')[2]}/ ---")
        lines += [f"  {mark[r['category']]} {r['id']}  ({r['category']})", *more.get((doc, r["id"]), [])]
    for title, x in (("Schema Changes", schemas), ("Submodules", submodules)):
        rows = x.orderBy("path").limit(most).collect() if x is not None else []
        values = lambda r: (r["old_value"], r["new_value"]) if "old_value" in r else (r["old_sha"], r["new_sha"])
        lines += [f"--- {title} ---", *(f"  {r['change']} {r['path']}: " + " → ".join(v for v in values(r) if v is not None) for r in rows)] if rows else []
    n = {r["category"]: r["n"] for r in changes.groupBy("category").agg(F.count("*").alias("n")).collect()}
    lines.append("Summary: " + ", ".join(f"{n.get(k, 0)} {k}" for k in ("added", "removed", "modified", "unchanged") if n.get(k) or k == "unchanged"))
    return "\n".join(lines) + "\n"
