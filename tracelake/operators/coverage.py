"""Coverage: which requirements are traced from where they must be."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import refs as R
from tracelake.model import Model, column, cut
from tracelake.operators import graph, skew


def effective_rtf(m: Model) -> DataFrame:
    """id, doc_path, rtf: the own list if present, even empty, else the document's, else null."""
    d = m.documents.select("doc_path", F.col("requires_trace_from").alias("_d"))
    own = graph.definitions(m)
    child = F.coalesce(column(own, "parent_id", "string"), F.lit("")) != ""
    return graph.by_document(m, own, d, "doc_path").select("id", "doc_path", "file", "suppressions", F.coalesce("requires_trace_from", "_d").alias("rtf"), child.alias("is_child"))


def sources_of(m: Model) -> DataFrame:
    """(token, dir): a coverage token names a document id (of the last document that has it), or else a level with all its directories."""
    by_id = graph.document_ids(m).select(F.col("document_id").alias("token"), F.col("doc_path").alias("dir"))
    by_level = m.documents.filter("level <> ''").select(F.col("level").alias("token"), F.col("doc_path").alias("dir"))
    return by_id.unionByName(by_level.join(by_id.select("token"), "token", "left_anti"))


def boundaries(m: Model, resolve_paths: bool = False) -> DataFrame:
    """doc_path, is_root, is_leaf. Root: no upstream sources, or external; leaf: in nobody's sources.

    The checks compare source strings with paths as they are; exports resolve
    them against the document's directory first (``resolve_paths``).
    """
    named = m.documents.select("doc_path", F.explode("upstream_sources").alias("source"))
    if resolve_paths:
        steps = F.filter(F.split(F.concat_ws("/", "doc_path", "source"), "/"), lambda p: (p != "") & (p != "."))
        inner = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        walk = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & inner(acc), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, p)))
        named = named.select(F.array_join(walk, "/").alias("source"))
    used = named.select(F.col("source").alias("doc_path")).distinct().withColumn("_used", F.lit(True))
    root = (F.size(F.coalesce("upstream_sources", F.array())) == 0) | F.coalesce("external", F.lit(False))
    return m.documents.join(used, "doc_path", "left").select("doc_path", root.alias("is_root"), F.col("_used").isNull().alias("is_leaf"))


def _inbound(m: Model, in_filter: DataFrame | None, of: DataFrame | None = None) -> DataFrame:
    """Inbound edges, of the ids in ``of`` (id) or of all (a repeated reference counts each time) with the source's directory and whether it provides coverage; in order, parents last."""
    own = graph.definitions(m).select(F.col("id").alias("from_id"), F.col("doc_path").alias("src_dir"), "doc_ord", "file", "ord", R.is_provider(F.col("status"), F.col("ignore_status")).alias("provider"))
    at = F.struct((F.col("kind") == "parent").alias("last"), "doc_ord", "file", "ord", "pos")
    e = graph.edges(m).select("from_id", "to_id", "kind", "pos")
    if of is not None:
        hubs = sorted({*graph.hot(m)["target"], *graph.hot(m)["parent"]})
        e = skew.attach(e, of.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi", hubs)
    e = skew.attach(e, own, "from_id", "inner", graph.hot(m)["source"]).select("from_id", "to_id", "src_dir", "provider", at.alias("at"))
    return e if in_filter is None else e.join(in_filter.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi")


def _ends(m: Model, end: str, other: str, in_filter: DataFrame | None) -> DataFrame:
    """Ids at one end of edges whose other end is in the filter; only existence counts, so ids combine before they shuffle."""
    e = graph.edges(m).select(end, other)
    e = e if in_filter is None else e.join(in_filter.select(F.col("id").alias(other)).distinct(), other, "left_semi")
    return e.select(F.col(end).alias("id")).distinct()


def token_state(m: Model, in_filter: DataFrame | None = None) -> DataFrame:
    """One row per requirement and token of its effective list: known, covered, drafts (seen before the first covering inbound)."""
    want = effective_rtf(m).filter("rtf IS NOT NULL").select("id", F.explode("rtf").alias("token"))
    dirs = sources_of(m)
    known = dirs.select("token").distinct().withColumn("known", F.lit(True))
    want = graph.by_document(m, want, known, "token", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    inbound = cut(_inbound(m, in_filter, want).select(F.col("to_id").alias("id"), "src_dir", "provider", "at"))
    hubs = sorted({*graph.hot(m)["target"], *graph.hot(m)["parent"]})
    met = skew.attach(inbound, want, "id", "inner", hubs)  # the edges are the long side: a hub's stay where they are
    met = met.unionByName(want.select("id", "token", "known"), allowMissingColumns=True)
    x = graph.by_document(m, met, dirs.select("token", F.col("dir").alias("src_dir"), F.lit(True).alias("hit")), ["token", "src_dir"], "left")
    covers = F.coalesce(F.col("provider") & F.col("hit"), F.lit(False))
    x = x.groupBy("id", "token", "known").agg(F.min(F.when(covers, F.col("at"))).alias("first"))
    drafts = inbound.filter("NOT provider").select("id", F.col("at").alias("draft"))
    before = F.col("first").isNull() | (F.col("draft") < F.col("first"))
    n = skew.attach(drafts, x, "id", "inner", hubs).filter(before).groupBy("id", "token").agg(F.count("*").alias("n"))
    y = x.join(n, ["id", "token"], "left").select("id", "token", "known", F.col("first").isNotNull().alias("covered"), F.coalesce("n", F.lit(0)).alias("n"))
    return y.select("id", "token", "known", "covered", F.when(F.col("known"), F.col("n")).otherwise(0).cast("int").alias("drafts"))


def coverage_state(m: Model, in_filter: DataFrame | None = None) -> DataFrame:
    """id, doc_path, state (covered, missing-coverage, unresolved, not-required), drafts, misses (comma-joined)."""
    m = graph.prepared(m)
    rtf = graph.by_document(m, effective_rtf(m), boundaries(m).select("doc_path", "is_root"), "doc_path")
    t = token_state(m, in_filter).groupBy("id").agg(
        F.max(F.when(~F.col("known"), 2).when(~F.col("covered"), 1).otherwise(0)).alias("worst"),
        F.sum("drafts").alias("drafts"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("known") | ~F.col("covered"), F.col("token")))), ",").alias("misses"),
    )
    has = _ends(m, "to_id", "from_id", in_filter).withColumn("has", F.lit(True))
    x = rtf.join(t, "id", "left").join(has, "id", "left")
    generic = F.when(F.col("has"), "covered").when(F.col("is_root") | F.col("is_child") | R.suppressed(F.col("suppressions"), "untraced"), "not-required").otherwise("missing-coverage")
    state = (
        F.when(R.suppressed(F.col("suppressions"), "requires-trace-from-coverage"), "not-required").when(F.col("rtf").isNull(), generic)
        .when(F.size("rtf") == 0, "not-required").when(F.col("worst") == 2, "unresolved").when(F.col("worst") == 1, "missing-coverage").otherwise("covered")
    )
    x = x.select("id", "doc_path", state.alias("state"), F.coalesce("drafts", F.lit(0)).alias("drafts"), F.coalesce("misses", F.lit("")).alias("misses"))
    return x if in_filter is None else x.join(in_filter.select("id").distinct(), "id", "left_semi")


def findings(m: Model, in_filter: DataFrame | None = None) -> DataFrame:
    """Coverage findings of all requirements, or of those in ``in_filter`` as seen within it: code, req_id, message."""
    m = graph.prepared(m)
    rtf = effective_rtf(m)
    if in_filter is not None:
        rtf = rtf.join(in_filter.select("id").distinct(), "id", "left_semi")
    bounds = boundaries(m)
    drafts = F.sum("drafts").over(Window.partitionBy("id"))
    t = token_state(m, in_filter).withColumn("all_drafts", drafts).join(rtf.select("id", "suppressions"), "id").filter(~R.suppressed(F.col("suppressions"), "requires-trace-from-coverage"))
    unknown = t.filter("NOT known").select(F.lit("unknown-source").alias("code"), F.col("id").alias("req_id"), F.concat(F.lit('unknown coverage source: "'), "token", F.lit('"')).alias("message"))
    note = F.when(F.col("all_drafts") > 0, F.concat(F.lit(" ("), F.col("all_drafts"), F.lit(" draft downstreams ignored)"))).otherwise("")
    text = F.concat(F.lit('no upstream trace: no approved requirement from "'), "token", F.lit('" traces to this item'), note)
    missed = t.filter("known AND NOT covered").select(F.lit("requires-trace-from").alias("code"), F.col("id").alias("req_id"), text.alias("message"))
    free = graph.by_document(m, rtf.filter("rtf IS NULL"), bounds, "doc_path")
    lost = free.filter("NOT is_root AND NOT is_child").join(_ends(m, "to_id", "from_id", in_filter), "id", "left_anti").filter(~R.suppressed(F.col("suppressions"), "untraced"))
    lost = lost.select(F.lit("untraced").alias("code"), F.col("id").alias("req_id"), F.lit("untraced: no downstream reference").alias("message"))
    top = free.filter("NOT is_leaf").join(_ends(m, "from_id", "to_id", in_filter), "id", "left_anti").filter(~R.suppressed(F.col("suppressions"), "no-downstream"))
    top = top.select(F.lit("no-upstream").alias("code"), F.col("id").alias("req_id"), F.lit("no upstream reference").alias("message"))
    return unknown.unionByName(missed).unionByName(lost).unionByName(top)


def summary(m: Model) -> DataFrame:
    """Counts of coverage states by document and, with a null doc_path, in total."""
    s = coverage_state(m)
    many = lambda v, name: F.count_if(F.col("state") == v).alias(name)
    return s.rollup("doc_path").agg(F.count("*").alias("total"), many("covered", "covered"), many("missing-coverage", "missing"), many("unresolved", "unresolved"), many("not-required", "not_required"))
