"""Verification: latest results, evidence through the trace graph, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import refs as R
from tracelake.functions import text as T
from tracelake.model import Model, column, cut
from tracelake.operators import graph
from tracelake.operators.reach import Reach, reach


EXTRA = {"verifies": "array<string>", "name": "string", "description": "string"}
RESULTS_PATH = "<verify-results>"


def latest(results: DataFrame) -> DataFrame:
    """The latest result of each (target without pin, case): greatest time (null: oldest), then least source, then first loaded.

    A partial and a final maximum, so a hot target never meets in one task.
    """
    return _latest(results, ["outcome", "verified_at", "source", "load_ord"])


def _latest(results: DataFrame, columns: list[str]) -> DataFrame:
    key = R.strip_pin(F.col("measure_id"))
    own = [F.col("measure_id").alias("ref"), *(column(results, c, t).alias(c) for c, t in EXTRA.items())]
    r = results.select(key.alias("measure_id"), F.coalesce("case_key", F.lit("")).alias("case_key"), "outcome", "verified_at", "source", "load_ord", *own)
    when = F.coalesce(F.unix_micros(F.col("verified_at").cast("timestamp")), F.lit(-(1 << 62)))
    best = F.min_by(F.struct(*columns), F.struct(-when, F.col("source"), F.col("load_ord")))
    return r.groupBy("measure_id", "case_key").agg(best.alias("b")).select("measure_id", "case_key", "b.*")


def latest_of(m: Model) -> DataFrame:
    """The latest results of a model, with what they verify, written once."""
    if "latest" not in m.derived:
        m.derived["latest"] = cut(_latest(m.results, ["outcome", "verified_at", "source", "load_ord", "ref", "verifies", "name", "description"]))
    return m.derived["latest"]


def latest_per_target(results: DataFrame) -> DataFrame:
    """The latest result of each target over all its cases: measure_id, outcome, source."""
    when = F.coalesce(F.unix_micros(F.col("verified_at").cast("timestamp")), F.lit(-(1 << 62)))
    best = F.min_by(F.struct("outcome", "source"), F.struct(-when, F.col("source"), F.col("load_ord")))
    return latest(results).groupBy("measure_id").agg(best.alias("b")).select("measure_id", "b.*")


def synthetic(m: Model) -> Model:
    """The model with results as nodes that trace to what they verify.

    RESULT:<target>[#case] traces to its target, pinned as reported, and
    TC:<case> to what the latest run of that case verifies, so references,
    cycles, pins and neighbours of results need no code of their own.
    """
    best = latest_of(m)
    blank = lambda skip: [F.lit(None).cast(f.dataType).alias(f.name) for f in m.nodes.schema if f.name not in skip]
    common = [F.lit(RESULTS_PATH).alias("doc_path"), F.coalesce("source", F.lit("")).alias("file"), F.col("load_ord").alias("ord"), F.lit("req").alias("kind")]
    node = T.result_id(F.col("measure_id"), F.col("case_key"))
    title = F.concat(F.lit("verification result: "), F.substr(node, F.lit(8)))
    own = best.select(*common, node.alias("id"), title.alias("title"), F.lit("approved").alias("status"), *blank(("doc_path", "file", "ord", "kind", "id", "title", "status")))
    cases = best.filter(F.col("measure_id").startswith("TC:")).groupBy("measure_id").agg(F.min_by(F.struct("source", "load_ord", "verifies", "name"), F.struct(F.coalesce("description", F.lit("")) == "", F.col("case_key"))).alias("b")).select("measure_id", "b.*")
    case = cases.select(*common, F.col("measure_id").alias("id"), F.col("name").alias("title"), *blank(("doc_path", "file", "ord", "kind", "id", "title")))
    names = m.nodes.columns
    refs = best.select(node.alias("from_id"), F.lit(1).alias("pos"), "ref").unionByName(cases.select(F.col("measure_id").alias("from_id"), F.posexplode("verifies").alias("p", "ref")).select("from_id", (F.col("p") + 1).alias("pos"), "ref"))
    document = {"doc_path": RESULTS_PATH, "doc_ord": 1 << 30, "document_id": "", "level": "verify-results", "id_prefix": "", "external": False, "mandatory_disposition": False, "ignore_status": False, "upstream_sources": []}
    row = m.documents.sparkSession.createDataFrame([tuple(document.get(f.name) for f in m.documents.schema)], m.documents.schema)
    g = m.with_(documents=m.documents.unionByName(row), nodes=m.nodes.unionByName(own.select(*names)).unionByName(case.select(*names)), refs=m.refs.unionByName(refs))
    g.derived["latest"] = latest_of(m)
    return g


def _case_edges(m: Model) -> DataFrame:
    """(child, parent): synthesised test cases and the requirements that their latest run verifies."""
    best = latest_of(m).filter(F.col("measure_id").startswith("TC:"))
    best = best.groupBy("measure_id").agg(F.min_by("verifies", F.struct(F.coalesce("description", F.lit("")) == "", F.col("case_key"))).alias("verifies"))
    refs = best.select(F.col("measure_id").alias("from_id"), F.posexplode("verifies").alias("pos", "ref"))
    own = m.with_(refs=refs)
    own.derived["definitions"] = graph.definitions(m)
    return graph.resolve(own).filter("to_id IS NOT NULL").select(F.col("from_id").alias("child"), F.col("to_id").alias("parent"))


def _upward(m: Model, in_filter: DataFrame | None) -> DataFrame:
    """Edges (child, parent) that evidence travels: from approved requirements, and from test cases unless a filter leaves them out."""
    ok = graph.definitions(m).filter(R.is_provider(F.col("status"), F.col("ignore_status"))).select(F.col("id").alias("child"))
    if in_filter is not None:
        ok = ok.join(in_filter.select(F.col("id").alias("child")).distinct(), "child", "left_semi")
    up = graph.edges(m).select(F.col("from_id").alias("child"), F.col("to_id").alias("parent")).join(ok, "child", "left_semi")
    return up.unionByName(_case_edges(m)) if in_filter is None and "verifies" in m.results.columns else up


def reached(m: Model, in_filter: DataFrame | None) -> Reach:
    """What evidence reaches from every requirement or test case with results, and from every traced one; found once for a model without a filter."""
    if in_filter is None and "reach" in m.derived:
        return m.derived["reach"]
    starts = latest_of(m).select(F.col("measure_id").alias("id")).union(graph.edges(m).select("to_id")).distinct()
    r = reach(_upward(m, in_filter), starts)
    if in_filter is None:
        m.derived["reach"] = r
    return r


def evidence(m: Model, in_filter: DataFrame | None = None) -> DataFrame:
    """Worst severity of each case that reaches a requirement: id, case_key, sev.

    Own results and those of every requirement or test case that traces to it
    through approved ones. Which requirements a result reaches is found once
    for a model; then each result moves to all of them in one exchange.
    """
    m = graph.prepared(m)
    target = F.col("measure_id")
    known = graph.definitions(m).select(F.col("id").alias("measure_id"))
    last = latest_of(m).withColumn("case_key", F.when(F.col("case_key") != "", F.col("case_key")).otherwise(F.when(target.startswith("TC:"), F.substr(target, F.lit(4))).otherwise("")))
    seeds = last.filter(~target.startswith("TC:")).join(known, "measure_id", "left_semi").unionByName(last.filter(target.startswith("TC:")))
    seeds = seeds.select(target.alias("id"), "case_key", R.severity(F.col("outcome")).alias("sev"))
    return reached(m, in_filter).lift(seeds, ["case_key"], "sev").filter(~F.col("id").startswith("TC:"))


def ignored_drafts(m: Model, in_filter: DataFrame | None = None) -> DataFrame:
    """How many distinct drafts would reach a requirement through approved ones, but give no evidence: id, drafts."""
    m = graph.prepared(m)
    draft = graph.definitions(m).filter(~R.is_provider(F.col("status"), F.col("ignore_status"))).select(F.col("id").alias("child"))
    if in_filter is not None:
        draft = draft.join(in_filter.select(F.col("id").alias("child")).distinct(), "child", "left_semi")
    first = graph.edges(m).select(F.col("from_id").alias("child"), F.col("to_id").alias("id")).join(draft, "child").select("id", F.col("child").alias("draft"), F.lit(1).alias("one"))
    return reached(m, in_filter).lift(first, ["draft"], "one").filter(~F.col("id").startswith("TC:")).groupBy("id").agg(F.count("*").alias("drafts"))


def verdicts(ev: DataFrame) -> DataFrame:
    """id, verdict (the worst), cases, failing (failing case keys, comma-joined)."""
    failing = F.array_join(F.array_sort(F.collect_list(F.when(F.col("sev") == 4, F.col("case_key")))), ",")
    v = ev.groupBy("id").agg(F.max("sev").alias("sev"), F.count("*").alias("cases"), failing.alias("failing"))
    return v.select("id", R.outcome_of(F.col("sev")).alias("verdict"), "cases", "failing")


def measures(m: Model) -> DataFrame:
    """id, doc_path of requirements with a verify method; ``expected``: neither deferred nor rejected; ``gated``: a provider, too."""
    d = graph.definitions(m).filter("coalesce(verify, '') <> ''")
    gate = R.is_provider(F.col("status"), F.col("ignore_status")) & ~F.coalesce(F.col("disposition"), F.lit("")).isin("deferred", "rejected")
    expected = ~F.coalesce(F.col("disposition"), F.lit("")).isin("deferred", "rejected")
    return d.select("id", "doc_path", "verify", gate.alias("gated"), expected.alias("expected"))


def rollup(m: Model) -> DataFrame:
    """One row per measure: id, doc_path, verdict (null without evidence), cases."""
    m = graph.prepared(m)
    return measures(m).join(verdicts(evidence(m)), "id", "left").select("id", "doc_path", "verdict", F.coalesce("cases", F.lit(0)).alias("cases"))


def missing(m: Model) -> DataFrame:
    """Gated measures that no evidence reaches."""
    m = graph.prepared(m)
    return measures(m).filter("gated").join(evidence(m).select("id").distinct(), "id", "left_anti").select("id", "doc_path")


def failing(m: Model) -> DataFrame:
    """Gated measures with a failing verdict and the failing cases."""
    return measures(m).filter("gated").join(verdicts(evidence(m)).filter("verdict = 'fail'"), "id").select("id", "failing")


def summary(m: Model) -> DataFrame:
    """Verdicts of gated measures by document."""
    x = measures(m).filter("gated").join(verdicts(evidence(m)), "id", "left")
    many = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v}")
    return x.groupBy("doc_path").agg(F.count("*").alias("measures"), many("pass"), many("skipped"), many("inconclusive"), many("fail"), F.count_if(F.col("verdict").isNull()).alias("n_missing"))


def export(m: Model) -> DataFrame:
    """One row per measure with evidence: measure_id, verify, outcome, cases (``case=outcome``, comma-joined by case)."""
    ev = evidence(m)
    each = F.concat_ws("=", "case_key", R.outcome_of(F.col("sev")))
    rows = ev.groupBy("id").agg(F.max("sev").alias("sev"), F.array_join(F.array_sort(F.collect_list(each)), ",").alias("cases"))
    return measures(m).join(rows, "id").select(F.col("id").alias("measure_id"), "verify", R.outcome_of(F.col("sev")).alias("outcome"), "cases")


def nested(m: Model) -> DataFrame:
    """One row per measure with evidence: measure_id, verify, outcome, source, cases (an array of case, outcome; by case)."""
    m = graph.prepared(m)
    ev = evidence(m)
    each = F.struct(F.col("case_key").alias("case"), R.outcome_of(F.col("sev")).alias("outcome"))
    rows = ev.groupBy("id").agg(F.max("sev").alias("sev"), F.array_sort(F.collect_list(each)).alias("cases"))
    x = measures(m).join(rows, "id").join(representative(m), "id", "left")
    return x.select(F.col("id").alias("measure_id"), "verify", R.outcome_of(F.col("sev")).alias("outcome"), "source", "cases")


def representative(m: Model) -> DataFrame:
    """Where each measure's verdict comes from: its own latest result's source, else that of the worst evidence; id, source."""
    m = graph.prepared(m)
    last = latest_of(m).withColumnRenamed("measure_id", "id")
    own = last.groupBy("id").agg(F.min_by("source", "load_ord").alias("own"))
    seeds = last.select("id", F.struct(R.severity(F.col("outcome")).alias("sev"), (-F.col("load_ord")).alias("o"), F.col("source").alias("source")).alias("w"))
    worst = reached(m, None).lift(seeds, [], "w")
    return measures(m).join(worst, "id").join(own, "id", "left").select("id", F.coalesce("own", F.col("w")["source"]).alias("source"))


def mirror(m: Model) -> DataFrame:
    """Links seen from their targets: id, from_id, title of the source, pin health (ok, outdated, predated)."""
    x = graph.linked(m, graph.last_refs(m), "title", "suppressions")
    return x.select(F.col("to_id").alias("id"), "from_id", "title", F.coalesce(graph.direction(), F.lit("ok")).alias("health"))


def attached(m: Model) -> DataFrame:
    """The outcome attached to each requirement itself, without roll-up: its first case's latest result; id, outcome, source."""
    last = latest(m.results).groupBy(F.col("measure_id").alias("id")).agg(F.min_by(F.struct("outcome", "source"), F.col("case_key")).alias("b"))
    return last.join(graph.definitions(m).select("id"), "id", "left_semi").select("id", "b.outcome", "b.source")
