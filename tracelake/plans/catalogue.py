"""Registered queries over the driver's tables, each with an oracle written apart from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import expr
from tracelake.functions import refs as R
from tracelake.operators import attributes, checks, coverage, diff, graph, schema, tree, verify, views
from tracelake.plans.projection import BLOCKS_SQL, CTES, Model, attributed, model, on_spark, plain

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: bool = True, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = (CTES if ctes else "") + sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def on_model(sql: str, name: str, f: Callable[[Model], DataFrame]) -> None:
    query(sql, name=name)(lambda spark, sf_dir: f(model(spark, sf_dir)))


# ------------------------------------------------------------ resolution, pins, identity

on_model(
    "SELECT 'WARNING' AS level, 'broken-ref' AS code, from_id AS req_id, n_.file, concat('broken reference: ', ref) AS message FROM t_ JOIN p_ n_ ON n_.id = from_id WHERE to_id IS NULL AND NOT contains(sup, ',broken-ref,')",
    "findings_broken_ref", graph.broken)
on_model(
    "SELECT from_id, to_id, n_.doc_path, ref, n_.file, coalesce(pin, 0) AS pin, to_id IS NOT NULL AS resolved FROM t_ JOIN n_ ON n_.id = from_id",
    "traces_export", graph.traces)
on_model("SELECT from_id, to_id, ref, pin, pos, kind FROM e_", "edges_with_parents", graph.edges)
on_model("SELECT from_id, to_id, ref, pin, pos FROM e_ WHERE kind = 'trace'", "edges", lambda m: graph.trace_edges(m).drop("kind"))
on_model("SELECT c.id AS req_id, c.parent_id FROM n_ c WHERE c.parent_id IS NOT NULL AND c.parent_id NOT IN (SELECT id FROM n_)", "lost_parents", graph.lost_parents)
on_model("SELECT count(*) AS nodes, (SELECT count(*) FROM e_ WHERE kind = 'trace') AS trace_edges, (SELECT count(*) FROM e_ WHERE kind = 'parent') AS parent_edges, (SELECT count(*) FROM d_) AS documents FROM n_", "graph_counters", graph.counters)
on_model(
    """, f AS (SELECT *, row_number() OVER (PARTITION BY id, direction, neighbour ORDER BY late, doc_ord, file, ord, pos) AS k FROM (
      SELECT e_.from_id AS id, 'up' AS direction, e_.to_id AS neighbour, e_.kind = 'parent' AS late, s.doc_ord, s.file, s.ord, e_.pos FROM e_ JOIN p_ s ON s.id = e_.from_id
      UNION ALL SELECT e_.to_id, 'down', e_.from_id, e_.kind = 'parent', s.doc_ord, s.file, s.ord, e_.pos FROM e_ JOIN p_ s ON s.id = e_.from_id))
    SELECT id, direction, neighbour, cast(row_number() OVER (PARTITION BY id, direction ORDER BY late, doc_ord, file, ord, pos, neighbour) AS int) AS position FROM f WHERE k = 1""",
    "neighbours", graph.neighbours)
on_model("SELECT from_id, to_id, ref, pin FROM l_", "last_refs", graph.last_refs)
on_model(
    "SELECT from_id, to_id, pin, version, CASE WHEN pin < version THEN 'outdated' ELSE 'predated' END AS direction FROM l_ JOIN p_ ON p_.id = to_id WHERE NOT external AND version <> 0 AND pin <> version",
    "pin_health", graph.pin_health)
for _promote, _name in ((False, "repin_deltas"), (True, "repin_deltas_unpinned")):
    on_model(
        f"""SELECT f.file, from_id AS req_id, ref AS source_ref, CASE WHEN pin IS NULL THEN 'unpinned' WHEN pin < p_.version THEN 'outdated' ELSE 'predated' END AS kind,
        concat(regexp_replace(ref, '~[0-9]+$', ''), '~', p_.version) AS new_ref FROM l_ JOIN p_ ON p_.id = to_id JOIN n_ f ON f.id = from_id
        WHERE NOT external AND p_.version <> 0 AND (pin <> p_.version {"OR pin IS NULL" if _promote else ""})""",
        _name, lambda m, p=_promote: graph.repin_deltas(m, p))
on_model(
    """, x AS (SELECT DISTINCT from_id, to_id FROM e_) SELECT id, (SELECT count(*) FROM x WHERE from_id = id) AS upstream, (SELECT count(*) FROM x WHERE to_id = id) AS downstream FROM n_""",
    "neighbors_degree", graph.degrees)


def _twice(m: Model) -> Model:
    """A second copy of parts 0 to 9 under another document."""
    again = m.nodes.filter("doc_path = 'parts' AND ord < 10").withColumns({"doc_path": F.lit("tests"), "file": F.lit("tests/again.md")})
    return m.with_(nodes=m.nodes.unionByName(again))


on_model("SELECT id, 'tests' AS doc_path, 'parts' AS first_doc FROM n_ WHERE doc_path = 'parts' AND ord < 10", "duplicate_ids", lambda m: graph.duplicate_ids(_twice(m)))
on_model(
    "SELECT from_id, ref, cast(2 AS bigint) AS dirs FROM q_ JOIN n_ ON n_.id = lid WHERE q IS NULL AND n_.doc_path IN ('suppliers') AND n_.ord < 10",
    "ambiguous_refs", lambda m: graph.ambiguous(m.with_(nodes=m.nodes.unionByName(m.nodes.filter("doc_path = 'suppliers' AND ord < 10").withColumn("doc_path", F.lit("tests"))))))
on_model(
    "SELECT id AS req_id, 'tests/again.md' AS file, 'mismatch' AS problem FROM n_ WHERE doc_path = 'parts' AND ord < 10 UNION ALL SELECT 'ORD-', 'tests/orders.md', 'collision'",
    "prefix_checks", lambda m: graph.prefix_checks(_twice(m)))


@query("""SELECT id FROM n_ WHERE id IN ('REG-000000000') OR id IN (SELECT id FROM n_ WHERE doc_path = 'system' AND id IN (SELECT from_id FROM e_ WHERE to_id = 'REG-000000000'))""", name="cyclic_nodes")
def cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region 0 and its nations, made to refer to each other: exactly those lie on cycles."""
    e = graph.edges(model(spark, sf_dir)).select("from_id", "to_id")
    back = e.filter("to_id = 'REG-000000000'").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return graph.cyclic_nodes(e.unionByName(back))


_LINKED = "from_id = 'NAT-000000000' AND to_id LIKE 'REG-%' OR doc_path = 'system' AND ord % 3 = 1"


@query(f""", x AS (SELECT from_id, to_id FROM e_ UNION SELECT to_id, from_id FROM e_ JOIN n_ ON n_.id = from_id WHERE {_LINKED} UNION SELECT 'REG-000000001', 'NAT-000000000' UNION SELECT 'REG-000000002', 'REG-000000002'),
    y AS (SELECT * FROM x WHERE from_id NOT LIKE 'NAT-%4' AND to_id NOT LIKE 'NAT-%4'), z AS (SELECT * FROM y WHERE from_id SIMILAR TO '(NAT|REG)-.*' AND to_id SIMILAR TO '(NAT|REG)-.*'),
    c AS (SELECT from_id, to_id FROM z UNION SELECT c.from_id, z.to_id FROM c JOIN z ON z.from_id = c.to_id) SELECT DISTINCT from_id AS id FROM c WHERE from_id = to_id""")
def cycles_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles between regions and some of their nations, one linked to the next, a requirement that refers to itself, and suppressed nations that break some."""
    m = graph.prepared(model(spark, sf_dir))
    e = graph.edges(m).select("from_id", "to_id").distinct()
    at = m.nodes.select(F.col("id").alias("from_id"), "doc_path", "ord")
    back = e.join(at, "from_id").filter(_LINKED).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    more = spark.createDataFrame([("REG-000000001", "NAT-000000000"), ("REG-000000002", "REG-000000002")], "from_id string, to_id string")
    return graph.cyclic_nodes(e.unionByName(back).unionByName(more), m.nodes.filter("id LIKE 'NAT-%4'").select("id"))


# ------------------------------------------------------------ coverage

_TOKENS = """, w AS (SELECT id, doc_path, unnest(string_split(eff, ',')) AS token FROM p_ WHERE eff <> ''),
i AS (SELECT to_id AS id, s.doc_path AS src, s.provider, row_number() OVER (PARTITION BY to_id ORDER BY kind = 'parent', s.doc_ord, s.file, s.ord, pos) AS k
      FROM e_ JOIN p_ s ON s.id = from_id),
f AS (SELECT w.id, w.token, min(k) FILTER (src = token AND provider) AS first FROM w LEFT JOIN i USING (id) GROUP BY ALL),
s AS (SELECT f.id, f.token, f.token IN (SELECT doc_path FROM d_) AS known, f.first IS NOT NULL AS covered,
      cast(CASE WHEN f.token IN (SELECT doc_path FROM d_) THEN count(*) FILTER (NOT provider AND (f.first IS NULL OR k < f.first)) ELSE 0 END AS int) AS drafts FROM f LEFT JOIN i USING (id) GROUP BY f.id, f.token, f.first)
"""
_STATE = _TOKENS + """, c AS (SELECT p_.id, p_.doc_path, CASE WHEN contains(sup, ',requires-trace-from-coverage,') THEN 'not-required'
  WHEN eff IS NULL THEN CASE WHEN EXISTS (FROM e_ WHERE to_id = p_.id) THEN 'covered' WHEN is_root OR is_child OR contains(sup, ',untraced,') THEN 'not-required' ELSE 'missing-coverage' END
  WHEN eff = '' THEN 'not-required' WHEN EXISTS (FROM s WHERE s.id = p_.id AND NOT known) THEN 'unresolved' WHEN EXISTS (FROM s WHERE s.id = p_.id AND NOT covered) THEN 'missing-coverage' ELSE 'covered' END AS state,
  coalesce((SELECT cast(sum(drafts) AS bigint) FROM s WHERE s.id = p_.id), 0) AS drafts, coalesce((SELECT string_agg(token, ',' ORDER BY token) FROM s WHERE s.id = p_.id AND NOT covered), '') AS misses
  FROM p_)
"""
on_model("SELECT id, doc_path, eff AS rtf FROM p_", "effective_rtf", lambda m: coverage.effective_rtf(m).select("id", "doc_path", F.array_join("rtf", ",").alias("rtf")))
on_model("SELECT doc_path, is_root, is_leaf FROM d_", "doc_boundaries", coverage.boundaries)
on_model(_TOKENS + "SELECT id, token, covered, drafts FROM s", "draft_counts", lambda m: coverage.token_state(m).select("id", "token", "covered", "drafts"))
on_model(_STATE + "SELECT * FROM c", "coverage_state", coverage.coverage_state)
_COVERAGE = """SELECT 'requires-trace-from' AS code, s.id AS req_id, concat('no upstream trace: no approved requirement from "', token, '" traces to this item', CASE WHEN c.drafts > 0 THEN concat(' (', c.drafts, ' draft downstreams ignored)') ELSE '' END) AS message FROM s JOIN c USING (id) JOIN p_ USING (id) WHERE known AND NOT covered AND NOT contains(sup, ',requires-trace-from-coverage,')
    UNION ALL SELECT 'unknown-source', s.id, concat('unknown coverage source: "', token, '"') FROM s JOIN p_ USING (id) WHERE NOT known AND NOT contains(sup, ',requires-trace-from-coverage,')
    UNION ALL SELECT 'untraced', id, 'untraced: no downstream reference' FROM p_ WHERE eff IS NULL AND NOT is_root AND NOT is_child AND NOT contains(sup, ',untraced,') AND id NOT IN (SELECT to_id FROM e_)
    UNION ALL SELECT 'no-upstream', id, 'no upstream reference' FROM p_ WHERE eff IS NULL AND NOT is_leaf AND NOT contains(sup, ',no-downstream,') AND id NOT IN (SELECT from_id FROM e_)"""
on_model(_STATE + _COVERAGE, "coverage_findings", coverage.findings)
on_model(
    "SELECT id AS req_id FROM p_ WHERE eff IS NULL AND NOT is_root AND NOT is_child AND NOT contains(sup, ',untraced,') AND id NOT IN (SELECT to_id FROM e_)",
    "untraced", lambda m: coverage.findings(m).filter("code = 'untraced'").select("req_id"))
on_model(
    _STATE + "SELECT doc_path, count(*) AS total, count(*) FILTER (state = 'covered') AS covered, count(*) FILTER (state = 'missing-coverage') AS missing, count(*) FILTER (state = 'unresolved') AS unresolved, count(*) FILTER (state = 'not-required') AS not_required FROM c GROUP BY ROLLUP (doc_path)",
    "coverage_summary", coverage.summary)
on_model(
    ", g AS (SELECT id FROM p_ WHERE provider AND doc_path = 'tests') SELECT id, doc_path, NOT contains(sup, ',requires-trace-from-coverage,') AND EXISTS (FROM e_ WHERE to_id = p_.id AND from_id IN (FROM g)) AS covered FROM p_ WHERE doc_path = 'software' AND verify IS NOT NULL",
    "filtered_coverage",
    lambda m: coverage.coverage_state(m, m.nodes.filter("doc_path = 'tests' OR (doc_path = 'software' AND verify IS NOT NULL)").select("id")).filter("doc_path = 'software'").select("id", "doc_path", (F.col("state") == "covered").alias("covered")))

# ------------------------------------------------------------ verification

_LATEST = """, x AS (SELECT regexp_replace(measure_id, '~[0-9]+$', '') AS measure_id, case_key, outcome, verified_at, source, load_ord, verifies, measure_id AS ref FROM v_),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY measure_id, case_key ORDER BY verified_at DESC, source, load_ord) = 1),
z AS (SELECT measure_id AS id, CASE WHEN case_key = '' AND starts_with(measure_id, 'TC:') THEN substr(measure_id, 4) ELSE case_key END AS case_key, CASE outcome WHEN 'pass' THEN 1 WHEN 'skipped' THEN 2 WHEN 'inconclusive' THEN 3 ELSE 4 END AS sev FROM y WHERE measure_id IN (SELECT id FROM n_) OR starts_with(measure_id, 'TC:')),
tc AS (SELECT * FROM (SELECT measure_id AS child, unnest(string_split(verifies, ',')) AS parent FROM y WHERE starts_with(measure_id, 'TC:')) WHERE parent IN (SELECT id FROM n_)),
eu AS (SELECT from_id AS child, to_id AS parent FROM e_ JOIN p_ ON p_.id = from_id AND p_.provider UNION SELECT child, parent FROM tc),
u AS (SELECT id, case_key, sev FROM z UNION SELECT eu.parent, u.case_key, u.sev FROM u JOIN eu ON eu.child = u.id),
ev AS (SELECT id, case_key, max(sev) AS sev FROM u WHERE NOT starts_with(id, 'TC:') GROUP BY ALL),
vd AS (SELECT id, max(sev) AS sev, count(*) AS cases, coalesce(string_agg(case_key, ',' ORDER BY case_key) FILTER (sev = 4), '') AS failing FROM ev GROUP BY id),
ms AS (SELECT id, doc_path, verify, provider AND coalesce(disposition, '') NOT IN ('deferred', 'rejected') AS gated FROM p_ WHERE coalesce(verify, '') <> '')
"""
_NAME = "CASE {} WHEN 1 THEN 'pass' WHEN 2 THEN 'skipped' WHEN 3 THEN 'inconclusive' WHEN 4 THEN 'fail' END"
on_model(_LATEST + "SELECT measure_id, case_key, outcome, verified_at, source, load_ord FROM y", "latest_results", lambda m: verify.latest(m.results))
on_model(
    _LATEST + "SELECT measure_id, outcome, source FROM y QUALIFY row_number() OVER (PARTITION BY measure_id ORDER BY verified_at DESC, source, load_ord) = 1",
    "latest_per_target", lambda m: verify.latest_per_target(m.results))
on_model(_LATEST + "SELECT * FROM ev", "evidence_closure", verify.evidence)
on_model(_LATEST + f"SELECT ms.id, ms.doc_path, {_NAME.format('sev')} AS verdict, coalesce(cases, 0) AS cases FROM ms LEFT JOIN vd USING (id)", "rollup_verdict", verify.rollup)
on_model(_LATEST + f"SELECT id, {_NAME.format('sev')} AS verdict, cases, failing FROM vd", "verdicts", lambda m: verify.verdicts(verify.evidence(m)))
on_model(_LATEST + "SELECT id, doc_path FROM ms WHERE gated AND id NOT IN (SELECT id FROM ev)", "missing_verdict", verify.missing)
on_model(_LATEST + "SELECT ms.id, failing FROM ms JOIN vd USING (id) WHERE gated AND sev = 4", "failing_verdict", verify.failing)
on_model(
    _LATEST + "SELECT doc_path, count(*) AS measures, count(*) FILTER (sev = 1) AS n_pass, count(*) FILTER (sev = 2) AS n_skipped, count(*) FILTER (sev = 3) AS n_inconclusive, count(*) FILTER (sev = 4) AS n_fail, count(*) FILTER (sev IS NULL) AS n_missing FROM ms LEFT JOIN vd USING (id) WHERE gated GROUP BY doc_path",
    "verdict_summary", verify.summary)
on_model(
    _LATEST + f"SELECT ms.id AS measure_id, any_value(verify) AS verify, {_NAME.format('max(sev)')} AS outcome, string_agg(concat(case_key, '=', {_NAME.format('sev')}), ',' ORDER BY case_key) AS cases FROM ms JOIN ev USING (id) GROUP BY ms.id",
    "results_export", verify.export)


def project_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage state and rolled-up verdict of every measure."""
    m = model(spark, sf_dir)
    return verify.rollup(m).join(coverage.coverage_state(m).drop("doc_path"), "id").select("id", "doc_path", "verdict", "cases", "state", "misses")


query(_LATEST + _STATE + f"SELECT ms.id, ms.doc_path, {_NAME.format('sev')} AS verdict, coalesce(cases, 0) AS cases, state, misses FROM ms LEFT JOIN vd USING (id) JOIN c ON c.id = ms.id")(project_health)

# ------------------------------------------------------------ attributes and filters

_ATTR = ", a AS (SELECT * FROM (SELECT doc_path, id, unnest(['status', 'verify', 'disposition', 'disposition_reason']) AS attr, unnest([status, verify, disposition, disposition_reason]) AS value FROM n_) WHERE value IS NOT NULL) "
on_model(_ATTR + "SELECT doc_path, attr, value, count(*) AS n FROM a GROUP BY ALL", "attribute_histogram", attributes.histogram)
on_model(_ATTR + "SELECT doc_path, attr, string_agg(DISTINCT value, ',' ORDER BY value) AS values FROM a GROUP BY doc_path, attr HAVING count(DISTINCT value) >= 2", "facets", attributes.facets)
on_model(
    "SELECT doc_path, coalesce(nullif(status, ''), 'approved') AS status, count(*) AS n, CASE coalesce(nullif(status, ''), 'approved') WHEN 'draft' THEN 0 WHEN 'approved' THEN 1 ELSE 2 END AS rank FROM n_ GROUP BY ALL",
    "status_breakdown", attributes.status_breakdown)
on_model("SELECT id, doc_path, disposition FROM n_ WHERE coalesce(disposition, '') NOT IN ('', 'implemented') AND trim(coalesce(disposition_reason, '')) = ''", "disposition_reasons", attributes.disposition_reasons)
on_model("SELECT id, doc_path FROM n_ JOIN d_ USING (doc_path) WHERE mandatory AND coalesce(disposition, '') = ''", "mandatory_disposition", attributes.mandatory_dispositions)
on_model("SELECT doc_path, count(*) AS requirements, cast(0 AS bigint) AS items FROM n_ GROUP BY doc_path", "document_summary", attributes.document_summary)
on_model(
    """, ph AS (SELECT from_id, to_id, pin < version AS old FROM l_ JOIN p_ ON p_.id = to_id WHERE NOT external AND version <> 0 AND pin <> version)
    SELECT n_.doc_path, count(*) AS links, count(*) FILTER (t_.to_id IS NOT NULL) AS resolved, count(*) FILTER (t_.to_id IS NULL) AS broken, count(*) FILTER (coalesce(pin, 0) <> 0) AS pinned, count(*) FILTER (old) AS outdated
    FROM t_ JOIN n_ ON n_.id = t_.from_id LEFT JOIN ph ON ph.from_id = t_.from_id AND ph.to_id = t_.to_id GROUP BY n_.doc_path""",
    "link_summary", attributes.link_summary)
SCHEMAS = {
    "parts": {"required": ["title", "status"], "properties": {"version": {"type": "integer", "minimum": 2, "maximum": 45}, "title": {"pattern": "a", "maxLength": 18}}},
    "tests": {"properties": {"status": {"enum": ["approved"]}, "title": {"minLength": 6, "pattern": "^[1-5]-"}, "verify": {"const": "Test"}}},
}
on_model(
    """SELECT * FROM (SELECT doc_path, id, unnest(['status', 'version', 'version', 'title', 'title']) AS attr, unnest(['required', 'minimum', 'maximum', 'pattern', 'maxLength']) AS problem,
      unnest([status IS NULL, version < 2, version > 45, NOT contains(title, 'a'), length(title) > 18]) AS bad FROM n_ WHERE doc_path = 'parts'
    UNION ALL SELECT doc_path, id, unnest(['status', 'title', 'title', 'verify']), unnest(['enum', 'minLength', 'pattern', 'const']), unnest([status <> 'approved', length(title) < 6, NOT regexp_matches(title, '^[1-5]-'), verify <> 'Test']) FROM n_ WHERE doc_path = 'tests') WHERE bad""".replace("SELECT * FROM (SELECT doc_path", "SELECT doc_path, id, attr, problem FROM (SELECT doc_path", 1),
    "schema_validation", lambda m: schema.schema_errors(m, SCHEMAS))

_TAGS = "SELECT {id} AS id, {tags} AS tags FROM {{{table}}}"


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT concat('CUS-', lpad(cast(c_custkey as string), 9, '0')) AS id, {f}(lower(c_mktsegment), CASE WHEN c_custkey % 3 = 0 THEN 'building' ELSE 'all' END) AS vals FROM {{customer}} UNION ALL SELECT concat('ORD-', lpad(cast(o_orderkey as string), 9, '0')), {f}(CASE WHEN o_orderkey % 2 = 0 THEN 'all' ELSE 'machinery' END) FROM {{orders}}"
    return on_spark(spark, sf_dir, sql.format(f="array"))


@query(
    """, g AS (SELECT concat('CUS-', lpad(cast(c_custkey as string), 9, '0')) AS id, [lower(c_mktsegment), CASE WHEN c_custkey % 3 = 0 THEN 'building' ELSE 'all' END] AS vals FROM customer
    UNION ALL SELECT concat('ORD-', lpad(cast(o_orderkey as string), 9, '0')), [CASE WHEN o_orderkey % 2 = 0 THEN 'all' ELSE 'machinery' END] FROM orders)
    SELECT DISTINCT from_id, to_id FROM e_ JOIN g a ON a.id = from_id JOIN g b ON b.id = to_id WHERE NOT list_has_any(a.vals, b.vals)"""
)
def disjoint_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.disjoint(graph.edges(model(spark, sf_dir)), _tags(spark, sf_dir))


FILTERS = {
    "filter_eq": ("status == 'draft'", "status = 'draft'"),
    "filter_nil": ("status == nil and verify != nil", "status IS NULL AND verify IS NOT NULL"),
    "filter_in": ("disposition in ['deferred', 'rejected'] or status in ['Approved']", "coalesce(disposition IN ('deferred', 'rejected'), false) OR coalesce(status IN ('Approved'), false)"),
    "filter_cmp": ("version >= 2 and not (version > 40)", "version >= 2 AND version <= 40"),
    "filter_startswith": ("id startsWith 'NAT-' || title contains '#00000001'", "starts_with(id, 'NAT-') OR contains(title, '#00000001')"),
    "filter_len": ("len(title) > 12 && len(id) == 13", "length(title) > 12 AND length(id) = 13"),
    "filter_any": ("any(tags, {# startsWith 'ap'}) or none(tags, # != 'draft')", "starts_with(coalesce(status, 'x'), 'ap') OR status = 'draft'"),
    "filter_count": ("count(filter(tags, {# == 'draft' or # == 'approved'}), {true}) == 1 and one(tags, {# != 'draft'})", "coalesce(status, 'x') = 'approved'"),
}
for _name, (_text, _where) in FILTERS.items():
    on_model(f"SELECT DISTINCT id FROM n_ WHERE {_where}", _name, lambda m, t=_text: expr.matching_ids(m.nodes.withColumn("tags", F.array(F.coalesce("status", F.lit("x")))), t))

# Attributes outside the core columns, as a schema would declare them.
_MORE = """, m_ AS (SELECT n_.id, n_.doc_path, p_brand AS brand, p_size AS size, CASE WHEN c_custkey % 3 = 0 THEN 'L' WHEN c_custkey IS NOT NULL THEN 'S' END AS csize, CASE WHEN p_partkey IS NOT NULL THEN [p_type, p_brand] WHEN c_custkey IS NOT NULL THEN ['MED', cast(c_nationkey AS varchar)] END AS tags,
    CASE WHEN p_size > 40 THEN p_partkey % 2 = 0 END AS exotic, lower(c_mktsegment) AS segment, c_custkey % 7 + 0.5 AS rate, status
    FROM n_ LEFT JOIN part ON n_.doc_path = 'parts' AND ord = p_partkey LEFT JOIN customer ON n_.doc_path = 'software' AND ord = c_custkey)"""
DECLARED = {"parts": ["brand", "size", "tags", "exotic"], "software": ["segment", "size", "tags", "rate"]}
ATTR_FILTERS = {
    "filter_attr_eq": ("brand == 'Brand#13' or segment == 'building'", "brand = 'Brand#13' OR segment = 'building'"),
    "filter_attr_mixed_types": ("size == 7 or size == 'L' or size in [9, 'XL']", "size IN (7, 9) OR csize = 'L'"),
    "filter_attr_order": ("rate != nil and rate > 3 or brand != nil and size >= 45", "rate > 3 OR size >= 45"),
    "filter_attr_list": ("'PROMO' in tags and not (exotic or brand == nil) or any(tags, {# startsWith 'LAR'}) and len(tags) == 2", "list_contains(tags, 'PROMO') AND NOT coalesce(exotic, false) AND brand IS NOT NULL OR len(list_filter(tags, lambda t: starts_with(t, 'LAR'))) > 0 AND len(tags) = 2"),
    "filter_attr_nil": ("brand == nil and segment != nil and count(filter(tags, {# matches '^[0-9]+$'}), {true}) == 1 and status != 'draft'", "brand IS NULL AND segment IS NOT NULL AND coalesce(status, '') <> 'draft'"),
    "filter_attr_bool": ("exotic or exotic == false and brand contains '2'", "exotic OR exotic = false AND contains(brand, '2')"),
}
for _name, (_text, _where) in ATTR_FILTERS.items():
    query(_MORE + f" SELECT DISTINCT id FROM m_ WHERE {_where}", name=_name)(lambda spark, sf_dir, t=_text: expr.matching_ids(attributed(spark, sf_dir).nodes, t, declared={a for v in DECLARED.values() for a in v}))


@query(_MORE + _ATTR + """, h AS (SELECT doc_path, attr, value FROM a UNION ALL SELECT doc_path, unnest(['brand', 'segment', 'size']), unnest([brand, segment, csize]) FROM m_) SELECT doc_path, attr, value, count(*) AS n FROM h WHERE value IS NOT NULL GROUP BY ALL""")
def declared_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all attributes, in and outside the core columns."""
    return attributes.histogram(attributed(spark, sf_dir))


@query(_MORE + _ATTR + """, h AS (SELECT doc_path, attr, value FROM a UNION ALL SELECT doc_path, unnest(['brand', 'segment', 'size', 'size', 'exotic', 'rate']), unnest([brand, segment, csize, cast(size AS varchar), cast(exotic AS varchar), cast(rate AS varchar)]) FROM m_ UNION ALL SELECT doc_path, 'tags', unnest(tags) FROM m_)
    SELECT doc_path, attr, string_agg(DISTINCT value, ',' ORDER BY value) AS values FROM h WHERE value IS NOT NULL GROUP BY doc_path, attr HAVING count(DISTINCT value) >= 2""")
def declared_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all attributes, lists by their items."""
    return attributes.facets(attributed(spark, sf_dir))


ATTR_SCHEMAS = {
    "parts": {
        "$defs": {"short": {"type": "string", "maxLength": 7}}, "properties": {"brand": {"pattern": "^Brand#[1-9]$"}, "size": {"type": "integer", "exclusiveMaximum": 40}, "tags": {"items": {"$ref": "#/$defs/short"}, "contains": {"enum": ["PROMO", "SMALL", "LARGE"]}}},
        "if": {"required": ["exotic"]}, "then": {"properties": {"exotic": {"const": True}}}, "else": {"properties": {"size": {"not": {"multipleOf": 9}}}},
    },
    "software": {"required": ["owner"], "properties": {"segment": {"anyOf": [{"maxLength": 8}, {"pattern": "^f"}]}, "size": {"type": ["integer", "null"]}, "rate": {"multipleOf": 1.5}}, "patternProperties": {"^ta": {"uniqueItems": True, "prefixItems": [{"const": "MED"}, {"pattern": "^1"}]}}, "additionalProperties": False},
}


@query(_MORE + """, x AS (SELECT doc_path, id, unnest([
      {'a': 'brand', 'p': 'pattern', 'b': NOT regexp_full_match(brand, 'Brand#[1-9]')}, {'a': 'size', 'p': 'exclusiveMaximum', 'b': size >= 40}, {'a': 'tags[0]', 'p': 'maxLength', 'b': length(tags[1]) > 7}, {'a': 'tags[1]', 'p': 'maxLength', 'b': length(tags[2]) > 7},
      {'a': 'tags', 'p': 'contains', 'b': tags[1] NOT IN ('PROMO', 'SMALL', 'LARGE')}, {'a': 'exotic', 'p': 'const', 'b': NOT exotic}, {'a': 'size', 'p': 'not', 'b': exotic IS NULL AND size % 9 = 0}]) AS e FROM m_ WHERE doc_path = 'parts'
    UNION ALL SELECT m_.doc_path, m_.id, unnest([{'a': 'owner', 'p': 'required', 'b': true}, {'a': 'segment', 'p': 'anyOf', 'b': length(segment) > 8 AND segment[1] <> 'f'}, {'a': 'size', 'p': 'type', 'b': true}, {'a': 'rate', 'p': 'multipleOf', 'b': rate NOT IN (1.5, 4.5)},
      {'a': 'tags[1]', 'p': 'pattern', 'b': tags[2][1] <> '1'}, {'a': 'verify', 'p': 'additionalProperties', 'b': n_.verify IS NOT NULL}, {'a': 'status', 'p': 'enum', 'b': n_.status = 'Approved'}, {'a': 'requires-trace-from', 'p': 'x', 'b': false}]) FROM m_ JOIN n_ USING (id) WHERE m_.doc_path = 'software')
    SELECT doc_path, id, e.a AS attr, e.p AS problem FROM x WHERE e.b""")
def schema_of_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas with references, combinators, conditions and patterns over attributes outside the core columns."""
    return schema.schema_errors(attributed(spark, sf_dir), ATTR_SCHEMAS)


# ------------------------------------------------------------ snapshots

_OLD = "SELECT o_orderkey AS id, 'tests' AS doc_path, o_orderpriority AS priority, o_orderstatus AS status FROM {orders} WHERE o_orderdate < timestamp '1999-01-01 00:00:00'"
_NEW = "SELECT o_orderkey AS id, 'tests' AS doc_path, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderpriority END AS priority, o_orderstatus AS status FROM {orders}"
_SNAP = f"WITH a AS ({plain(_OLD)}), b AS ({plain(_NEW)}), j AS (SELECT id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.priority IS DISTINCT FROM b.priority OR a.status IS DISTINCT FROM b.status THEN 'modified' ELSE 'unchanged' END AS category, doc_path FROM a FULL JOIN b USING (doc_path, id)) "


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return on_spark(spark, sf_dir, _OLD), on_spark(spark, sf_dir, _NEW)


@query(_SNAP + "SELECT doc_path, id, category FROM j", ctes=False)
def diff_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.requirements(*_snapshots(spark, sf_dir), ["doc_path", "id"], ["priority", "status"])


@query(_SNAP + "SELECT doc_path, id, 'priority' AS attr, a.priority AS old_value, b.priority AS new_value FROM a JOIN b USING (doc_path, id) WHERE a.priority IS DISTINCT FROM b.priority", ctes=False)
def diff_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.attributes(*_snapshots(spark, sf_dir), ["doc_path", "id"], ["priority", "status"])


@query(_SNAP + "SELECT doc_path, count(*) FILTER (category = 'added') AS added, count(*) FILTER (category = 'removed') AS removed, count(*) FILTER (category = 'modified') AS modified, count(*) FILTER (category = 'unchanged') AS unchanged FROM j GROUP BY ROLLUP (doc_path)", ctes=False)
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.summary(diff_requirements(spark, sf_dir), "doc_path")


@query(
    ", a AS (SELECT id, doc_path FROM n_ WHERE status = 'draft'), b AS (SELECT id, doc_path FROM n_ WHERE verify = 'Test') SELECT doc_path, id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'unchanged' END AS category FROM a FULL JOIN b USING (doc_path, id)"
)
def two_view_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = model(spark, sf_dir).nodes
    views_ = [n.filter(expr.Filter(t, n.schema).column) for t in ("status == 'draft'", "verify == 'Test'")]
    return diff.requirements(*views_, ["doc_path", "id"], ["status", "verify"])


_SCHEMAS = ({"properties": {"status": {"enum": ["draft", "approved"]}, "old": {"type": "string"}}, "required": ["title"]}, {"properties": {"status": {"enum": ["draft", "final"]}, "new": {"minLength": 2}}, "required": ["title"]})


@query(
    """SELECT concat('part-', p_partkey) AS doc_path, path, change, old_value, new_value FROM part, (VALUES ('properties.new.minLength', 'added', NULL, '2'), ('properties.old.type', 'removed', '"string"', NULL), ('properties.status.enum.1', 'changed', '"approved"', '"final"')) v(path, change, old_value, new_value) WHERE p_partkey % 2 = 0""",
    ctes=False,
)
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas of the parts as documents: every other one changes."""
    docs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("part-"), "p_partkey").alias("doc_path"), (F.col("p_partkey") % 2 == 0).alias("new"))
    flat = [spark.createDataFrame([r[1:] for r in diff.flatten_schema("", s)], "path string, value string") for s in _SCHEMAS]
    old = docs.join(F.broadcast(flat[0])).select("doc_path", "path", "value")
    new = docs.filter("new").join(F.broadcast(flat[1])).select("doc_path", "path", "value").unionByName(docs.filter("NOT new").join(F.broadcast(flat[0])).select("doc_path", "path", "value"))
    return diff.schemas(old, new)


_M_OLD = "SELECT p_name AS path, concat(p_brand, '0123456789') AS sha FROM {part} WHERE p_partkey % 5 <> 0"
_M_NEW = "SELECT p_name AS path, concat(CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_brand END, '0123456789') AS sha FROM {part} WHERE p_partkey % 7 <> 0"


@query(
    f"WITH a AS ({plain(_M_OLD)}), b AS ({plain(_M_NEW)}) SELECT path, CASE WHEN a.sha IS NULL THEN 'added' WHEN b.sha IS NULL THEN 'removed' ELSE 'updated' END AS change, left(a.sha, 7) AS old_sha, left(b.sha, 7) AS new_sha FROM a FULL JOIN b USING (path) WHERE a.sha IS DISTINCT FROM b.sha",
    ctes=False,
)
def submodule_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.submodules(on_spark(spark, sf_dir, _M_OLD), on_spark(spark, sf_dir, _M_NEW))


# ------------------------------------------------------------ trees and documents

_B = f"WITH RECURSIVE k AS ({plain(BLOCKS_SQL)}), "
_PARENT = _B + "t AS (SELECT *, (SELECT max(p.ord) FROM k p WHERE p.file = k.file AND p.ord < k.ord AND p.level < k.level) AS parent_ord FROM k)"


@query(_PARENT + "SELECT file, ord, level, kind, id, parent_ord FROM t", ctes=False)
def tree_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.parents(on_spark(spark, sf_dir, BLOCKS_SQL))


_UP = ", w AS (SELECT file, ord, parent_ord AS at FROM t UNION ALL SELECT w.file, w.ord, t.parent_ord FROM w JOIN t ON t.file = w.file AND t.ord = w.at WHERE NOT {stop})"


@query(_PARENT + _UP.format(stop="t.kind = 'req'") + "SELECT t.file, t.ord, (SELECT max(w.at) FROM w JOIN t p ON p.file = w.file AND p.ord = w.at WHERE w.file = t.file AND w.ord = t.ord AND p.kind = 'req') AS req_parent_ord FROM t", ctes=False)
def req_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.requirement_parents(on_spark(spark, sf_dir, BLOCKS_SQL)).select("file", "ord", "req_parent_ord")


@query(_PARENT + "SELECT file, ord, CASE WHEN kind = 'info' AND EXISTS (FROM t c WHERE c.file = t.file AND c.parent_ord = t.ord) THEN 'container' ELSE kind END AS kind FROM t", ctes=False)
def container_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.promote_containers(on_spark(spark, sf_dir, BLOCKS_SQL)).select("file", "ord", "kind")


@query(_PARENT + _UP.format(stop="(t.kind <> 'req' OR t.ord % 3 = 0)") + ", s AS (SELECT * FROM t WHERE kind <> 'req' OR ord % 3 = 0) SELECT s.file, s.ord, (SELECT max(w.at) FROM w JOIN s p ON p.file = w.file AND p.ord = w.at WHERE w.file = s.file AND w.ord = s.ord) AS parent_ord FROM s", ctes=False)
def prune_reattach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.prune(on_spark(spark, sf_dir, BLOCKS_SQL), F.col("ord") % 3 == 0).select("file", "ord", "parent_ord")


@query(_B + "x AS (SELECT 1) SELECT file, ord, CASE WHEN kind = 'req' THEN id ELSE concat('item-', count(*) FILTER (kind <> 'req') OVER (PARTITION BY file ORDER BY ord)) END AS anchor FROM k", ctes=False)
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.anchors(on_spark(spark, sf_dir, BLOCKS_SQL), "file").select("file", "ord", "anchor")


@query(", x AS (SELECT id, (SELECT min(to_id) FROM e_ WHERE from_id = id AND pos = 1) AS parent_id FROM n_), y AS (SELECT id, 0 AS depth FROM x WHERE parent_id IS NULL UNION ALL SELECT x.id, depth + 1 FROM y JOIN x ON x.parent_id = y.id) SELECT id, depth FROM y")
def order_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    up = graph.edges(m).filter("pos = 1").groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("parent_id"))
    return tree.by_depth(m.nodes.select("id").join(up, "id", "left"))


@query(", x AS (SELECT DISTINCT a.doc_path AS f, b.doc_path AS t FROM e_ JOIN n_ a ON a.id = from_id JOIN n_ b ON b.id = to_id), y AS (SELECT 'tests' AS id, 0 AS depth UNION SELECT x.t, depth + 1 FROM y JOIN x ON x.f = y.id WHERE depth < 9) SELECT id, min(depth) AS depth FROM y GROUP BY id")
def doc_chain_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    at = m.nodes.select("id", "doc_path")
    e = graph.edges(m).join(at.withColumnsRenamed({"id": "from_id", "doc_path": "f"}), "from_id").join(at.withColumnsRenamed({"id": "to_id", "doc_path": "t"}), "to_id")
    e = e.select(F.col("f").alias("from_id"), F.col("t").alias("to_id")).distinct()
    return graph.tiers(e, spark.createDataFrame([("tests",)], "id string"))


# ------------------------------------------------------------ search and views

_ITEMS = "SELECT concat('PRT-', lpad(cast(p_partkey as string), 9, '0')) AS id, p_name AS title, p_partkey AS ord, p_type, p_brand, p_size FROM {part}"


@query(f"WITH x AS ({plain(_ITEMS)}), y AS (SELECT *, CASE WHEN lower(id) = 'art' THEN 0 WHEN starts_with(lower(id), 'art') THEN 1 WHEN starts_with(lower(title), 'art') THEN 2 WHEN contains(lower(id), 'art') THEN 3 WHEN contains(lower(title), 'art') THEN 4 END AS tier FROM x) SELECT id, title, tier FROM y WHERE tier IS NOT NULL ORDER BY tier, ord LIMIT 40", ctes=False)
def search_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.palette(on_spark(spark, sf_dir, _ITEMS), " ART ")


@query(f"""WITH x AS ({plain(_ITEMS)}), y AS (SELECT *, lower(concat_ws(' ', id, title)) AS t FROM x), a AS (SELECT *, strpos(t, 'p') AS i FROM y),
    b AS (SELECT *, strpos(substr(t, i + 1), '0') AS j FROM a WHERE i > 0), c AS (SELECT *, strpos(substr(t, i + j + 1), '7') AS k FROM b WHERE j > 0)
    SELECT id, title, cast(i + j + k - 3 AS int) AS score FROM c WHERE k > 0 ORDER BY score, ord LIMIT 30""", ctes=False)
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.fuzzy(on_spark(spark, sf_dir, _ITEMS), "p07")


@query("""SELECT id, title, CASE WHEN lower(id) = '5-l' THEN 0 WHEN starts_with(lower(id), '5-l') THEN 1 WHEN contains(lower(id), '5-l') THEN 2 WHEN starts_with(lower(title), '5-l') THEN 3 ELSE 4 END + 0e0 AS score
    FROM n_ WHERE contains(lower(id), '5-l') OR contains(lower(title), '5-l') ORDER BY score, ord, id LIMIT 30""")
def search_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all requirements; enough of them hold the query for no fuzzy match to come in."""
    return views.search(model(spark, sf_dir).nodes, "5-L")


@query(f"WITH x AS ({plain(_ITEMS)}) SELECT id FROM x WHERE contains(lower(concat_ws(' ', id, title, p_type)), '1') AND p_brand IN ('Brand#11', 'Brand#23') AND p_size IN (1, 5, 9, 13, 17, 21)", ctes=False)
def facet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facet_search(on_spark(spark, sf_dir, _ITEMS), "1", {"p_brand": ["Brand#11", "Brand#23"], "p_size": [1, 5, 9, 13, 17, 21]}, ["id", "title", "p_type"]).select("id")


@query(
    _STATE + _LATEST + """, qx AS (SELECT state AS queue, id FROM c WHERE state IN ('missing-coverage', 'unresolved')
    UNION ALL SELECT 'broken', from_id FROM t_ JOIN p_ ON p_.id = from_id WHERE to_id IS NULL AND NOT contains(sup, ',broken-ref,')
    UNION ALL SELECT DISTINCT 'stale', from_id FROM l_ JOIN p_ ON p_.id = to_id WHERE NOT external AND version <> 0 AND pin < version
    UNION ALL SELECT 'missing-verdict', id FROM ms WHERE gated AND id NOT IN (SELECT id FROM ev)
    UNION ALL SELECT 'failing', ms.id FROM ms JOIN vd USING (id) WHERE gated AND sev = 4),
    qy AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY id) AS position, count(*) OVER (PARTITION BY queue) AS total FROM qx) SELECT queue, id, cast(position AS int) AS position, total FROM qy WHERE position <= 50"""
)
def queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 of each queue of work: coverage, references, pins and verdicts."""
    return views.queue(views.work(model(spark, sf_dir)), ["id"]).select("queue", "id", "position", "total")


@query("SELECT id, row_number() OVER (ORDER BY status IS NULL, lower(status), id) AS position FROM n_")
def table_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of all requirements sorted by status, empties last."""
    return views.positions(model(spark, sf_dir).nodes.select("id", "status"), [*views.table_order(F.col("status")), F.col("id")]).select("id", "position")


_LABEL = "concat(CASE ord % 3 WHEN 0 THEN 'Item ' WHEN 1 THEN 'item ' ELSE 'ITÉM ' END, CASE WHEN ord % 5 = 0 THEN '00' ELSE '' END, cast(ord AS varchar), CASE WHEN ord % 2 = 0 THEN 'b' ELSE '.A' END)"


@query(f"""SELECT id, row_number() OVER (ORDER BY CASE WHEN ord % 11 = 0 THEN 2 WHEN ord % 7 = 0 THEN 0 ELSE 1 END, CASE WHEN ord % 11 <> 0 THEN ord END DESC, id) AS position FROM n_""")
def table_sort_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, then labels by the numbers in them, backwards, whatever their case and accents; empties last."""
    n = model(spark, sf_dir).nodes.withColumn("label", F.expr(f"CASE WHEN ord % 11 = 0 THEN ' ' WHEN ord % 7 = 0 THEN cast(ord AS string) ELSE {_LABEL.replace('varchar', 'string')} END"))
    return views.positions(n.select("id", "label"), [*views.table_order(F.col("label"), True), F.col("id")]).select("id", "position")


@query("SELECT from_id, to_id, cast(1 AS int) AS linked FROM (SELECT DISTINCT from_id, to_id FROM e_)", name="trace_cells")
def trace_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the whole trace matrix, in long form: any number of rows and columns."""
    return views.cells(graph.edges(model(spark, sf_dir)))


@query(", x AS (SELECT DISTINCT from_id, to_id FROM e_ WHERE starts_with(from_id, 'NAT')) SELECT from_id, " + ", ".join(f"max(1) FILTER (to_id = 'REG-00000000{i}') AS \"REG-00000000{i}\"" for i in range(5)) + " FROM x GROUP BY from_id")
def trace_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.matrix(graph.edges(model(spark, sf_dir)).filter("from_id LIKE 'NAT%'").select("from_id", "to_id").distinct())


# ------------------------------------------------------------ text

_H = "SELECT doc_id, concat(upper(source), '-', cast(doc_id as string), CASE WHEN doc_id % 3 = 0 THEN ': ' ELSE ' ' END, ' ', lang, ': x ') AS h FROM {documents}"


@query(f"WITH x AS ({plain(_H)}) SELECT doc_id, trim(CASE WHEN strpos(h, ': ') > 0 THEN left(h, strpos(h, ': ') - 1) ELSE h END) AS id, trim(CASE WHEN strpos(h, ': ') > 0 THEN substr(h, strpos(h, ': ') + 2) ELSE '' END) AS title FROM x", ctes=False)
def split_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = on_spark(spark, sf_dir, _H)
    return h.select("doc_id", R.heading_id(F.col("h")).alias("id"), R.heading_title(F.col("h")).alias("title"))


_T = "SELECT o_orderkey, concat('see ORD-', lpad(cast(o_orderkey as string), 4, '0'), ' and CUS-', cast(o_custkey as string), ', ORD-', lpad(cast(o_orderkey as string), 4, '0')) AS t FROM {orders}"


@query(rf"WITH x AS ({plain(_T)}) SELECT o_orderkey, array_to_string(list_distinct(regexp_extract_all(t, '\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*-[0-9]{{3,}}(?:~[0-9]+)?\b')).list_sort(), ',') AS ids FROM x", ctes=False)
def extract_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = on_spark(spark, sf_dir, _T)
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit(R.HEURISTIC_ID), F.lit(0))))
    return t.select("o_orderkey", F.array_join(found, ",").alias("ids"))


_REPORTS = """SELECT concat('run-', cast(user_id as string), '.ctrf.json') AS path, event_id, event_type, concat('{"name": "t', cast(event_id as string), '", "status": "',
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'passed' WHEN 'signup' THEN 'skipped' ELSE 'other' END, '", "stop": ', cast(event_id * 1000 as string), ', "extra": {"x-tool": ',
  CASE WHEN event_id % 3 = 0 THEN concat('{"id": "E-', cast(event_id as string), '", "case": "', event_type, '"}') WHEN event_id % 3 = 1 THEN concat('{"verifies": ["E-', cast(event_id as string), '"]}') ELSE '{}' END, '}}') AS test FROM {events}"""
_OUTCOME = "CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'pass' WHEN 'signup' THEN 'skipped' ELSE 'inconclusive' END"


@query(
    f"""SELECT concat('E-', event_id) AS measure_id, event_type AS case_key, {_OUTCOME} AS outcome, '' AS verifies, epoch_ms(event_id * 1000) AS verified_at FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT concat('TC:s/t', event_id), concat('s/t', event_id), {_OUTCOME}, concat('E-', event_id), epoch_ms(event_id * 1000) FROM events WHERE event_id % 3 = 1""",
    ctes=False,
)
def ctrf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as a test report, read by the report reader."""
    from tracelake.sources.readers import bind_reports

    t = on_spark(spark, sf_dir, _REPORTS.replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}"))
    files = t.groupBy("path").agg(F.concat(F.lit('{"results": {"suite": "s", "tests": ['), F.concat_ws(", ", F.collect_list("test")), F.lit("]}}")).alias("value"))
    found, _ = bind_reports(files, "tool")
    at = F.when(F.col("verified_at").isNull(), F.timestamp_millis(F.lit(0))).otherwise(F.col("verified_at")).cast("timestamp_ntz")
    return found.select("measure_id", "case_key", "outcome", F.coalesce(F.array_join("verifies", ","), F.lit("")).alias("verifies"), at.alias("verified_at"))


@query(
    """WITH h AS (SELECT p_partkey, list_reduce(list_prepend(cast(69346085 AS bigint), list_transform(string_split(p_type, ''), lambda c: cast(ord(c) AS bigint))), lambda h, c: (xor(h, c) * 435) & 268435455) AS a,
    list_transform(string_split(p_name, ''), lambda c: cast(ord(c) AS bigint)) AS b FROM part)
    SELECT p_partkey, lower(lpad(to_hex(list_reduce(list_prepend(xor(a, 58), b), lambda h, c: (xor(h, c) * 435) & 268435455)), 7, '0')) AS hash FROM h""",
    ctes=False,
)
def short_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ids of (type, name) of the parts; tests/test_sources.py compares them with the plain version too."""
    from tracelake.functions.hashes import short_hash as h

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", h(F.col("p_type"), F.col("p_name")).alias("hash"))


@query(
    ", c AS (SELECT unnest(range(3)) AS copy) SELECT " + ", ".join(f"CASE WHEN copy = 0 THEN {x} ELSE regexp_replace({x}, '-([0-9]+)$', concat('-R', copy, '-\\1')) END AS {x}" for x in ("from_id", "to_id")) + ", pos FROM e_, c WHERE kind = 'trace'",
    name="replicated_edges",
)
def replicated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of three copies of the whole model: each copy refers to itself."""
    from tracelake.sources.replicate import replicate as copy

    return graph.trace_edges(copy(model(spark, sf_dir), 3)).select("from_id", "to_id", "pos")


@query("SELECT nation.n_nationkey + 25 * i AS n_nationkey, concat(n_name, '-', i) AS name, n_regionkey + 5 * i AS n_regionkey FROM nation, range(4) r(i)", ctes=False)
def replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four copies of the nations with renamed ids and references."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    c = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return c.select((F.col("n_nationkey") + 25 * F.col("i")).alias("n_nationkey"), F.concat_ws("-", "n_name", "i").alias("name"), (F.col("n_regionkey") + 5 * F.col("i")).alias("n_regionkey"))


# ------------------------------------------------------------ streaming


@query(_LATEST + "SELECT measure_id, case_key, outcome, source FROM y WHERE NOT starts_with(measure_id, 'TC:')")
def stream_latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, folded into keyed latest-wins state and compacted; equals the batch merge of the same results."""
    import uuid

    from tracelake.model import RESULTS
    from tracelake.plans.projection import RESULTS_SQL
    from tracelake.streaming.results import scratch
    from tracelake.streaming.state import ResultState, upsert

    folder, glob = sf_dir.rstrip("/"), "events.parquet*"
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    name = f"events_{uuid.uuid4().hex}"
    stream.createOrReplaceTempView(name)
    folder = scratch(spark, name)
    state = ResultState(spark, f"{folder}/state", RESULTS, buckets=64, compact_every=1)
    upsert(spark.sql(RESULTS_SQL.replace("{events}", name)), state, f"{folder}/offsets").awaitTermination()
    return state.read().select("measure_id", "case_key", "outcome", "source")


on_model(
    """, ph AS (SELECT from_id, to_id, CASE WHEN pin < version THEN 'outdated' ELSE 'predated' END AS h FROM l_ JOIN p_ ON p_.id = to_id WHERE NOT external AND version <> 0 AND pin <> version)
    SELECT l_.to_id AS id, l_.from_id, n_.title, coalesce(h, 'ok') AS health FROM l_ JOIN n_ ON n_.id = l_.from_id LEFT JOIN ph ON ph.from_id = l_.from_id AND ph.to_id = l_.to_id""",
    "downstream_mirror", verify.mirror)
on_model(
    _LATEST + """, o AS (SELECT measure_id AS id, arg_min(source, load_ord) AS source FROM y GROUP BY 1),
    ws AS (SELECT measure_id AS id, CASE outcome WHEN 'pass' THEN 1 WHEN 'skipped' THEN 2 WHEN 'inconclusive' THEN 3 ELSE 4 END AS sev, load_ord, source FROM y),
    wu AS (SELECT id, sev, load_ord, source FROM ws UNION SELECT eu.parent, wu.sev, wu.load_ord, wu.source FROM wu JOIN eu ON eu.child = wu.id),
    wb AS (SELECT id, arg_max(source, (sev, -load_ord, source)) AS source FROM wu GROUP BY id)
    SELECT ms.id, coalesce(o.source, wb.source) AS source FROM ms JOIN wb USING (id) LEFT JOIN o USING (id)""",
    "verdict_source", verify.representative)

# ------------------------------------------------------------ results as nodes, all checks

_SYNTHETIC = """, rn AS (SELECT concat('RESULT:', measure_id, CASE WHEN case_key <> '' THEN concat('#', case_key) ELSE '' END) AS id, measure_id, ref,
  CASE WHEN regexp_matches(ref, '~[0-9]+$') THEN cast(regexp_extract(ref, '~([0-9]+)$', 1) AS bigint) END AS pin FROM y),
rp AS (SELECT rn.id AS from_id, p_.id AS to_id, pin, p_.version FROM rn JOIN p_ ON p_.id = rn.measure_id WHERE pin IS NOT NULL AND NOT external AND p_.version <> 0 AND pin <> p_.version)
"""
on_model(
    _LATEST + _SYNTHETIC + "SELECT from_id, to_id, pin, version, CASE WHEN pin < version THEN 'outdated' ELSE 'predated' END AS direction FROM rp",
    "synthetic_pins", lambda m: graph.pin_health(verify.synthetic(m)).filter("from_id LIKE 'RESULT:%'"))
on_model(
    _LATEST + _SYNTHETIC + "SELECT id, measure_id AS to_id FROM rn WHERE measure_id IN (SELECT id FROM n_) OR starts_with(measure_id, 'TC:') UNION ALL SELECT child, parent FROM tc",
    "synthetic_edges", lambda m: graph.trace_edges(verify.synthetic(m)).filter("from_id RLIKE '^(RESULT|TC):'").select(F.col("from_id").alias("id"), "to_id"))
on_model(
    _LATEST + "SELECT measure_id AS id, arg_min(outcome, case_key) AS outcome, arg_min(source, case_key) AS source FROM y WHERE measure_id IN (SELECT id FROM n_) GROUP BY 1",
    "attached_outcome", verify.attached)
_DRAFTS = """, dd AS (SELECT e_.to_id AS id, e_.from_id AS draft FROM e_ JOIN p_ ON p_.id = from_id AND NOT provider UNION SELECT eu.parent, dd.draft FROM dd JOIN eu ON eu.child = dd.id),
dc AS (SELECT id, count(*) AS drafts FROM dd GROUP BY id)
"""
on_model(_LATEST + _DRAFTS + "SELECT id, drafts FROM dc", "ignored_drafts", verify.ignored_drafts)
on_model(
    _STATE + _LATEST + _DRAFTS + _SYNTHETIC + ", cf AS (" + _COVERAGE + """)
    SELECT 'WARNING' AS level, 'broken-ref' AS code, from_id AS req_id, concat('broken reference: ', ref) AS message FROM t_ JOIN p_ ON p_.id = from_id WHERE to_id IS NULL AND NOT contains(sup, ',broken-ref,')
    UNION ALL SELECT 'ERROR', 'parent', id, concat('parent requirement "', parent_id, '" not found') FROM n_ WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM n_)
    UNION ALL SELECT 'WARNING', code, req_id, message FROM cf
    UNION ALL SELECT 'WARNING', 'disposition-reason', id, concat('disposition without reason for "', disposition, '"') FROM n_ WHERE coalesce(disposition, '') NOT IN ('', 'implemented') AND trim(coalesce(disposition_reason, '')) = ''
    UNION ALL SELECT 'ERROR', 'mandatory-disposition', id, 'disposition is required (mandatory-disposition is set)' FROM n_ JOIN d_ USING (doc_path) WHERE mandatory AND coalesce(disposition, '') = ''
    UNION ALL SELECT 'ERROR', 'version-pin', from_id, concat(CASE WHEN pin < version THEN 'outdated' ELSE 'predated' END, ' pin on ', to_id) FROM (SELECT from_id, to_id, pin, version FROM l_ JOIN p_ ON p_.id = to_id WHERE NOT external AND version <> 0 AND pin <> version UNION ALL SELECT from_id, to_id, pin, version FROM rp)
    UNION ALL SELECT 'WARNING', 'missing-verdict', ms.id, concat('missing verdict: no verification result or downstream test-case result covers this measure', CASE WHEN drafts > 0 THEN concat(' (', drafts, ' draft downstreams ignored)') ELSE '' END) FROM ms JOIN p_ ON p_.id = ms.id LEFT JOIN dc ON dc.id = ms.id WHERE gated AND NOT contains(sup, ',missing-verdict,') AND ms.id NOT IN (SELECT id FROM ev)
    UNION ALL SELECT 'ERROR', 'failing-verdict', ms.id, concat('failing verdict: rolled-up verification result is fail: ', failing) FROM ms JOIN p_ ON p_.id = ms.id JOIN vd ON vd.id = ms.id WHERE gated AND sev = 4 AND NOT contains(sup, ',failing-verdict,')
    UNION ALL SELECT 'INFO', 'verdict', p_.id, concat('verified: ', """ + _NAME.format("sev") + """) FROM p_ JOIN vd ON vd.id = p_.id WHERE coalesce(verify, '') <> '' AND coalesce(disposition, '') NOT IN ('deferred', 'rejected')""",
    "check_findings", lambda m: checks.findings(m).select("level", "code", "req_id", "message"))
on_model(
    "SELECT coalesce(file, '') AS file, coalesce(kind, '') AS kind, count(*) AS n FROM (SELECT f.file, CASE WHEN pin < p_.version THEN 'outdated' ELSE 'predated' END AS kind FROM l_ JOIN p_ ON p_.id = to_id JOIN n_ f ON f.id = from_id WHERE NOT external AND p_.version <> 0 AND pin <> p_.version) GROUP BY CUBE (file, kind)",
    "repin_summary", lambda m: graph.repin_summary(graph.repin_deltas(m)).fillna(""))
on_model(
    "SELECT attr, count(*) AS n FROM (SELECT unnest(['status', 'verify', 'disposition', 'disposition-reason', 'version']) AS attr, unnest([status, verify, disposition, disposition_reason, CASE WHEN version <> 0 THEN 'x' END]) AS v FROM n_) WHERE v IS NOT NULL GROUP BY attr",
    "attribute_universe", attributes.universes)
on_model("SELECT doc_path, 'req' AS kind, count(*) AS n FROM n_ GROUP BY ROLLUP (doc_path)", "type_breakdown", attributes.type_breakdown)
on_model(
    "SELECT id, title, n_.doc_path, concat(n_.doc_path, '.html#', id) AS href FROM n_",
    "search_index", views.search_index)
on_model(
    _STATE + _LATEST + f"SELECT p_.id, p_.doc_path, state, {_NAME.format('sev')} AS verdict, (SELECT count(*) FROM t_ WHERE from_id = p_.id) AS up_links, (SELECT count(*) FROM l_ WHERE to_id = p_.id) AS down_links FROM p_ JOIN c ON c.id = p_.id LEFT JOIN vd ON vd.id = p_.id",
    "page_model", views.page_model)
on_model(
    "SELECT id, attr, value, position FROM (SELECT id, unnest(['status', 'verify', 'disposition']) AS attr, unnest([status, verify, disposition]) AS value, unnest([1, 2, 3]) AS position FROM n_) WHERE value IS NOT NULL",
    "attribute_rows", lambda m: views.attribute_rows(m, ["status", "verify", "disposition"]))
