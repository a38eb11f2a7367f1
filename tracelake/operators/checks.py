"""The union of all checks in their fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import refs as R
from tracelake.model import Model
from tracelake.operators import attributes, coverage, graph, schema, verify

COLUMNS = ("check_ord", "level", "code", "direction", "outcome", "req_id", "message")


def _note(drafts: Column) -> Column:
    return F.when(F.coalesce(drafts, F.lit(0)) > 0, F.concat(F.lit(" ("), drafts, F.lit(" draft downstreams ignored)"))).otherwise("")


def findings(m: Model, in_filter: DataFrame | None = None, relaxed_versions: bool = False, schemas: dict[str, dict] | None = None, disjoint: dict[str, DataFrame] | None = None) -> DataFrame:
    """All findings: check_ord, level, code, direction, outcome, req_id, file, message.

    ``in_filter`` (id) limits every check but identity, references and cycles;
    the graph is always the whole one. ``disjoint`` maps an attribute to its
    values (id, vals). Verdict checks run only if the model has results, which
    then are nodes of the graph as well. ``relaxed_versions`` makes outdated
    pins warnings; predated ones stay errors.
    """
    g = graph.prepared(verify.synthetic(m) if m.results is not None else m)
    parts: list[DataFrame] = []

    def add(df: DataFrame, level: str | Column, code: str | Column, req_id: str, message: Column, scoped: bool, direction: Column | None = None, outcome: Column | None = None) -> None:
        df = df if in_filter is None or not scoped else df.join(in_filter.select(F.col("id").alias(req_id)).distinct(), req_id, "left_semi")
        text = lambda c: F.lit(c) if isinstance(c, str) else c
        none = F.lit("")
        parts.append(df.select(F.lit(len(parts)).alias("check_ord"), text(level).alias("level"), text(code).alias("code"), (none if direction is None else direction).alias("direction"), (none if outcome is None else outcome).alias("outcome"), F.col(req_id).alias("req_id"), message.alias("message")))

    add(graph.duplicate_ids(g), "ERROR", "duplicate-id", "id", F.concat(F.lit("duplicate requirement ID: already defined in "), "first_doc"), False)
    add(graph.broken(g), "WARNING", "broken-ref", "req_id", F.col("message"), False)
    lost = graph.lost_parents(g).join(graph.definitions(g).select(F.col("id").alias("req_id"), "suppressions"), "req_id").filter(~R.suppressed(F.col("suppressions"), "broken-ref"))
    add(lost, "ERROR", "parent", "req_id", F.concat(F.lit('parent requirement "'), "parent_id", F.lit('" not found')), False)
    add(graph.circular(g), "ERROR", "circular", "id", F.lit("circular dependency"), False)
    add(coverage.findings(g, in_filter), "WARNING", F.col("code"), "req_id", F.col("message"), False)
    add(attributes.disposition_reasons(g), "WARNING", "disposition-reason", "id", F.concat(F.lit('disposition without reason for "'), "disposition", F.lit('"')), True)
    add(attributes.mandatory_dispositions(g), "ERROR", "mandatory-disposition", "id", F.lit("disposition is required (mandatory-disposition is set)"), True)
    level = F.when((F.col("direction") == "outdated") & F.lit(relaxed_versions), "WARNING").otherwise("ERROR")
    add(graph.pin_health(g), level, "version-pin", "from_id", F.concat_ws(" ", "direction", F.lit("pin on"), "to_id"), True, F.col("direction"))
    add(graph.prefix_checks(g), "ERROR", "id-prefix", "req_id", F.concat_ws(" in ", "problem", "file"), False)
    if m.results is not None:
        ev = verify.evidence(g, in_filter)
        suppress = graph.definitions(g).select("id", "suppressions")
        gated = verify.measures(g).filter("gated").join(suppress, "id")
        missing = gated.filter(~R.suppressed(F.col("suppressions"), "missing-verdict")).join(ev.select("id").distinct(), "id", "left_anti").join(verify.ignored_drafts(g, in_filter), "id", "left")
        add(missing, "WARNING", "missing-verdict", "id", F.concat(F.lit("missing verdict: no verification result or downstream test-case result covers this measure"), _note(F.col("drafts"))), True)
        verdicts = verify.verdicts(ev)
        failing = gated.filter(~R.suppressed(F.col("suppressions"), "failing-verdict")).join(verdicts.filter("verdict = 'fail'"), "id")
        add(failing, "ERROR", "failing-verdict", "id", F.concat(F.lit("failing verdict: rolled-up verification result is fail: "), "failing"), True)
        add(verify.measures(g).filter("expected").join(verdicts, "id"), "INFO", "verdict", "id", F.concat(F.lit("verified: "), "verdict"), True, None, F.col("verdict"))
    for name in sorted(disjoint or {}):
        add(attributes.disjoint(graph.edges(g), disjoint[name]), "ERROR", "disjoint", "from_id", F.concat(F.lit(f'no common value of "{name}" with '), "to_id"), True)
    if schemas:
        add(schema.schema_errors(g, schemas), "ERROR", "schema", "id", F.concat_ws(": ", "attr", "problem"), False)
    files = graph.definitions(g).select(F.col("id").alias("req_id"), "file")
    out = reduce(DataFrame.unionByName, parts).join(files, "req_id", "left")
    return out.select(*COLUMNS[:-1], F.coalesce("file", F.lit("")).alias("file"), "message")


def exit_code(found: DataFrame) -> int:
    """2 with a file or schema that couldn't be read, else 1 with an error, else 0."""
    worst = found.agg(F.max(F.when(F.col("code") == "parse", 2).when(F.col("level") == "ERROR", 1).otherwise(0))).first()[0]
    return worst or 0
