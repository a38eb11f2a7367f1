"""Attributes: histograms, facets, dispositions, disjoint sets, schema checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import refs as R
from tracelake.model import Model
from tracelake.operators import graph, skew
from tracelake.operators.schema import BUILTINS

ATTRIBUTES = ("status", "verify", "disposition", "disposition_reason")


def attribute_rows(m: Model, names: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """doc_path, id, attr, value for every string attribute that is set."""
    pairs = F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).alias("value")) for a in names))
    x = m.nodes.filter("kind = 'req'").select("doc_path", "id", F.explode(pairs).alias("p"))
    return x.select("doc_path", "id", "p.attr", "p.value").filter("value IS NOT NULL")


def attribute_values(m: Model, names: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """doc_path, id, attr, value (a variant) for every attribute that is set: the columns ``names`` and the members of ``attrs``, in one pass."""
    fixed = F.array(*(F.struct(F.lit(a).alias("key"), F.col(a).cast("variant").alias("value")) for a in names if a in m.nodes.columns))
    own = F.filter(fixed, lambda e: e["value"].isNotNull())
    if "attrs" in m.nodes.columns:
        more = F.map_entries(F.try_variant_get(F.try_parse_json("attrs"), "$", "map<string,variant>"))
        own = F.concat(own, F.coalesce(more, F.filter(fixed, lambda e: F.lit(False))))
    x = m.nodes.filter("kind = 'req'").select("doc_path", "id", F.explode(own).alias("p"))
    return x.select("doc_path", "id", F.col("p.key").alias("attr"), "p.value")


def texts_of(value: Column) -> Column:
    """A variant as the texts that it is shown by: the items of a list, or a scalar; maps and nulls have none."""
    plain = lambda v: ~F.is_variant_null(v) & ~F.schema_of_variant(v).startswith("OBJECT")
    text = lambda v: F.try_variant_get(v, "$", "string")
    listed = F.transform(F.filter(F.try_variant_get(value, "$", "array<variant>"), plain), text)
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), listed).when(plain(value), F.array(text(value))).otherwise(F.array().cast("array<string>"))


def histogram(m: Model, declared: dict[str, list[str]] | None = None) -> DataFrame:
    """How often each attribute has each text in a document: doc_path, attr, value, n; other types aren't counted.

    With ``declared`` (names by document) only what a document's schema declares.
    """
    x = attribute_values(m).filter(F.schema_of_variant("value") == "STRING").select("doc_path", "attr", F.try_variant_get("value", "$", "string").alias("value"))
    if declared is not None:
        names = m.nodes.sparkSession.createDataFrame([(d, a.replace("-", "_") if a == "disposition-reason" else a) for d, own in declared.items() for a in own], "doc_path string, attr string")
        x = x.join(F.broadcast(names), ["doc_path", "attr"], "left_semi")
    return x.groupBy("doc_path", "attr", "value").agg(F.count("*").alias("n"))


def facets(m: Model, least: int = 2, names: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """Attributes with at least ``least`` distinct values in a document: doc_path, attr, values (comma-joined).

    A list counts by its items; numbers and booleans by their text; trace
    never, and status not in documents that ignore it.
    """
    free = m.documents.filter("ignore_status").select("doc_path", F.lit("status").alias("attr"))
    x = graph.by_document(m, attribute_values(m, names).filter("attr <> 'trace'"), free, ["attr", "doc_path"], "left_anti")
    x = x.select("doc_path", "attr", F.explode(texts_of(F.col("value"))).alias("value")).distinct()
    v = x.groupBy("doc_path", "attr").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return v.filter(F.size("v") >= least).select("doc_path", "attr", F.array_join("v", ",").alias("values"))


def status_breakdown(m: Model, additions: tuple[str, ...] = ()) -> DataFrame:
    """doc_path, status, n, rank: draft, approved, additions, then the rest (rank ties by name)."""
    order = ["draft", "approved", *additions]
    s = m.nodes.filter("kind = 'req'").groupBy("doc_path", R.effective_status(F.col("status")).alias("status")).agg(F.count("*").alias("n"))
    rank = reduce(lambda a, iv: a.when(F.col("status") == iv[1], iv[0]), list(enumerate(order))[1:], F.when(F.col("status") == order[0], 0)).otherwise(len(order))
    return s.withColumn("rank", rank)


def disposition_reasons(m: Model) -> DataFrame:
    """Requirements with another disposition than ``implemented`` whose reason is missing or blank."""
    x = m.nodes.filter("kind = 'req' AND coalesce(disposition, '') NOT IN ('', 'implemented')").filter(~R.suppressed(F.col("suppressions"), "disposition-reason"))
    return x.filter("trim(coalesce(disposition_reason, '')) = ''").select("id", "doc_path", "disposition")


def mandatory_dispositions(m: Model) -> DataFrame:
    """Requirements without a disposition in documents that demand one."""
    d = m.documents.filter("mandatory_disposition").select("doc_path")
    x = m.nodes.filter("kind = 'req' AND coalesce(disposition, '') = ''").filter(~R.suppressed(F.col("suppressions"), "mandatory-disposition"))
    return graph.by_document(m, x, d, "doc_path", "left_semi").select("id", "doc_path")


def disjoint(e: DataFrame, values: DataFrame) -> DataFrame:
    """Edges whose ends both have values and share none: from_id, to_id. ``values``: id, vals (array)."""
    a = values.select(F.col("id").alias("from_id"), F.col("vals").alias("a"))
    b = values.select(F.col("id").alias("to_id"), F.col("vals").alias("b"))
    x = e.select("from_id", "to_id").distinct().join(a, "from_id").join(b, "to_id")
    return x.filter((F.size("a") > 0) & (F.size("b") > 0) & ~F.arrays_overlap("a", "b")).select("from_id", "to_id")


def universes(m: Model) -> DataFrame:
    """Attributes that requirements have, by name and how many have them: attr, n. Columns and members of ``attrs``."""
    names = [c for c in (*ATTRIBUTES, "version") if c in m.nodes.columns]
    own = F.array(*(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != "0"), F.lit(c.replace("_", "-"))) for c in names))
    more = F.coalesce(F.json_object_keys("attrs"), F.array().cast("array<string>")) if "attrs" in m.nodes.columns else F.array().cast("array<string>")
    x = m.nodes.filter("kind = 'req'").select(F.explode(F.concat(F.filter(own, lambda a: a.isNotNull()), more)).alias("attr"))
    return x.groupBy("attr").agg(F.count("*").alias("n"))


def type_breakdown(m: Model) -> DataFrame:
    """Blocks of a document by kind: doc_path, kind, n; a null doc_path is the project."""
    return m.nodes.rollup("kind", "doc_path").agg(F.count("*").alias("n")).filter("kind IS NOT NULL").select("doc_path", "kind", "n")


def result_layer(findings: DataFrame) -> DataFrame:
    """Findings about results: without a requirement, or about RESULT: and TC: ids."""
    return findings.filter("coalesce(req_id, '') = '' OR req_id RLIKE '^(RESULT|TC):'")


def document_summary(m: Model) -> DataFrame:
    return m.nodes.groupBy("doc_path").agg(F.count_if(F.col("kind") == "req").alias("requirements"), F.count_if(F.col("kind") != "req").alias("items"))


def link_summary(m: Model) -> DataFrame:
    """Declared references by document: total, resolved, broken, pinned, outdated."""
    r = skew.spread(graph.targets(m), graph.rows(m), "from_id", "to_id").groupBy("from_id", "to_id")
    r = r.agg(F.count("*").alias("links"), F.count("strict").alias("resolved"), F.count_if(F.coalesce("pin", F.lit(0)) != 0).alias("pinned"), graph.last_pin())
    r = r.withColumn("to_id", F.coalesce("to_id", F.concat(F.lit("\0"), "from_id")))  # broken references have no key, but must not meet
    x = graph.linked(m, r, "doc_path", "suppressions", how="left")
    outdated = F.when(graph.direction() == "outdated", F.col("resolved")).otherwise(0)
    many = lambda c, n: F.sum(c).alias(n)
    return x.groupBy("doc_path").agg(many("links", "links"), many("resolved", "resolved"), many(F.col("links") - F.col("resolved"), "broken"), many("pinned", "pinned"), many(outdated, "outdated"))


def is_builtin(name: str) -> bool:
    return name in BUILTINS


def filterable(m: Model, declared: dict[str, list[str]]) -> DataFrame:
    """Attributes that a filter may name: attr, declared, found (how many requirements have it)."""
    names = sorted({a for v in declared.values() for a in v} | set(BUILTINS) | {"id", "title"})
    d = m.nodes.sparkSession.createDataFrame([(a, True) for a in names], "attr string, declared boolean")
    x = universes(m).withColumnRenamed("n", "found").join(d, "attr", "full_outer")
    return x.select("attr", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("found", F.lit(0)).alias("found"))
