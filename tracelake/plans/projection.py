"""The driver's tables read as requirement documents, in SQL that Spark and DuckDB both run.

Six documents: stakeholder (region), system (nation), software (customer),
suppliers (supplier), parts (part, external), tests (orders with lineitem).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.model import DOCUMENTS, Model

#: doc_path, doc_ord, document_id, level, id_prefix, external, mandatory_disposition, ignore_status, requires_trace_from, upstream_sources
DOCUMENT_ROWS = [
    ("stakeholder", 0, "stakeholder", "stakeholder", "REG-", False, False, False, ["system"], []),
    ("system", 1, "system", "system", "NAT-", False, False, False, ["software"], ["stakeholder"]),
    ("software", 2, "software", "software", "CUS-", False, False, False, ["tests"], ["system"]),
    ("suppliers", 3, "suppliers", "suppliers", "SUP-", False, False, False, None, ["system"]),
    ("parts", 4, "parts", "parts", "PRT-", True, False, False, None, []),
    ("tests", 5, "tests", "tests", "ORD-", False, True, False, [], ["software"]),
]


def _id(prefix: str, key: str) -> str:
    return f"concat('{prefix}-', lpad(cast({key} as string), 9, '0'))"


_NULL = "cast(null as string)"


def _node(doc: str, table: str, prefix: str, key: str, title: str, status: str = _NULL, version: str = "0", verify: str = _NULL, disposition: str = _NULL, reason: str = _NULL, suppress: str = _NULL, own_rtf: str = _NULL, parent: str = _NULL) -> str:
    return (
        f"SELECT '{doc}' AS doc_path, '{doc}/{table}.md' AS file, cast({key} as bigint) AS ord, {_id(prefix, key)} AS id, {title} AS title, {status} AS status, "
        f"cast({version} as int) AS version, {verify} AS verify, {disposition} AS disposition, {reason} AS disposition_reason, "
        f"{suppress} AS suppress, {own_rtf} AS own_rtf, {parent} AS parent_id FROM {{{table}}}"
    )


NODES_SQL = " UNION ALL ".join([
    _node("stakeholder", "region", "REG", "r_regionkey", "r_name", "'approved'"),
    _node("system", "nation", "NAT", "n_nationkey", "n_name", "CASE WHEN n_nationkey % 5 = 0 THEN 'draft' ELSE 'approved' END", "n_nationkey % 4",
          own_rtf=f"CASE n_nationkey % 7 WHEN 5 THEN 'suppliers,nowhere' WHEN 6 THEN '' ELSE {_NULL} END"),
    _node("software", "customer", "CUS", "c_custkey", "c_name", f"CASE c_mktsegment WHEN 'BUILDING' THEN 'draft' WHEN 'MACHINERY' THEN 'Approved' ELSE {_NULL} END", "c_custkey % 4", f"CASE WHEN c_custkey % 2 = 0 THEN 'Test' ELSE {_NULL} END",
          suppress=f"CASE WHEN c_custkey % 13 = 0 THEN 'requires-trace-from-coverage' WHEN c_custkey % 11 = 0 THEN 'missing-verdict,failing-verdict' ELSE {_NULL} END"),
    _node("suppliers", "supplier", "SUP", "s_suppkey", "s_name", version="1", suppress=f"CASE WHEN s_suppkey % 20 = 0 THEN 'untraced' ELSE {_NULL} END",
          parent=f"CASE s_suppkey % 10 WHEN 0 THEN {_NULL} WHEN 9 THEN 'SUP-none' ELSE {_id('SUP', 's_suppkey - s_suppkey % 10')} END"),
    _node("parts", "part", "PRT", "p_partkey", "p_name", version="p_size", suppress=f"CASE WHEN p_partkey % 9 = 0 THEN 'no-downstream' ELSE {_NULL} END"),
    _node("tests", "orders", "ORD", "o_orderkey", "o_orderpriority", f"CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'draft' ELSE {_NULL} END", "1", "'Test'",
          f"CASE o_orderpriority WHEN '5-LOW' THEN 'deferred' WHEN '4-NOT SPECIFIED' THEN {_NULL} ELSE 'implemented' END", "CASE WHEN o_orderkey % 2 = 0 THEN 'phase 2' ELSE ' ' END", suppress=f"CASE WHEN o_orderkey % 150 = 0 THEN 'broken-ref' ELSE {_NULL} END"),
])

REFS_SQL = " UNION ALL ".join([
    f"SELECT {_id('NAT', 'n_nationkey')} AS from_id, 1 AS pos, concat('stakeholder/', {_id('REG', 'n_regionkey')}) AS ref FROM {{nation}}",
    f"SELECT {_id('CUS', 'c_custkey')}, 1, concat('system/', {_id('NAT', 'c_nationkey')}, '~', cast(c_custkey % 4 as string)) FROM {{customer}}",
    f"SELECT {_id('SUP', 's_suppkey')}, 1, {_id('NAT', 's_nationkey')} FROM {{supplier}}",
    f"SELECT {_id('ORD', 'o_orderkey')}, 1, concat({_id('CUS', 'o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 10000000 ELSE 0 END')}, CASE WHEN o_orderkey % 3 = 0 THEN concat('~', cast(o_orderkey % 5 as string)) ELSE '' END) FROM {{orders}}",
    f"SELECT {_id('ORD', 'l_orderkey')}, 1 + l_linenumber, concat('parts/', {_id('PRT', 'l_partkey')}, '~', cast(l_linenumber as string)) FROM {{lineitem}} WHERE l_returnflag = 'R'",
    f"SELECT {_id('ORD', 'l_orderkey')}, 1 + l_linenumber, {_id('SUP', 'l_suppkey')} FROM {{lineitem}} WHERE l_returnflag = 'A'",
])

RESULTS_SQL = (
    f"SELECT concat({_id('CUS', 'user_id')}, CASE WHEN event_id % 4 = 0 THEN '~1' ELSE '' END) AS measure_id, event_type AS case_key, "
    "CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'inconclusive' WHEN 'signup' THEN 'skipped' ELSE 'pass' END AS outcome, "
    "ts AS verified_at, concat('run-', cast(event_id % 10 as string), '.ctrf.json') AS source, cast(event_id as bigint) AS load_ord FROM {events}"
)
#: Test cases of events: each verifies a customer and a nation.
CASES_SQL = (
    "SELECT concat('TC:case-', cast(user_id % 40 as string)) AS measure_id, '' AS case_key, CASE event_type WHEN 'error' THEN 'fail' ELSE 'pass' END AS outcome, ts AS verified_at, "
    f"'cases.ctrf.json' AS source, cast(event_id + 1000000000 as bigint) AS load_ord, concat({_id('CUS', 'user_id + 20')}, ',', {_id('NAT', 'user_id % 25')}) AS verifies FROM {{events}} WHERE event_id % 20 = 3"
)
BLOCKS_SQL = (
    "SELECT cast(conv_id as string) AS file, cast(turn as bigint) AS ord, CASE role WHEN 'system' THEN 2 WHEN 'user' THEN 3 ELSE 4 END AS level, "
    "CASE WHEN turn % 2 = 1 THEN 'req' ELSE 'info' END AS kind, concat('C-', cast(conv_id as string), '-', cast(turn as string)) AS id FROM {conversations}"
)
TABLES = "region nation customer supplier part orders lineitem events conversations documents pages".split()


def on_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def plain(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


def model(spark: SparkSession, sf_dir: str) -> Model:
    from pyspark.sql import functions as F

    nodes = on_spark(spark, sf_dir, NODES_SQL)
    listed = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    nodes = nodes.withColumns({"kind": F.lit("req"), "suppressions": listed("suppress"), "requires_trace_from": listed("own_rtf")}).drop("suppress", "own_rtf")
    results = on_spark(spark, sf_dir, RESULTS_SQL).unionByName(on_spark(spark, sf_dir, CASES_SQL).withColumn("verifies", F.split("verifies", ",")), allowMissingColumns=True)
    return Model(spark.createDataFrame(DOCUMENT_ROWS, DOCUMENTS), nodes, on_spark(spark, sf_dir, REFS_SQL), results)


#: Attributes outside the core columns: texts, numbers, lists and booleans; ``size`` is a number of parts and a text of customers.
ATTRS_SQL = f"""SELECT {_id('PRT', 'p_partkey')} AS id, to_json(named_struct('brand', p_brand, 'size', p_size, 'tags', array(p_type, p_brand), 'exotic', CASE WHEN p_size > 40 THEN p_partkey % 2 = 0 END)) AS attrs FROM {{part}}
UNION ALL SELECT {_id('CUS', 'c_custkey')}, to_json(named_struct('segment', lower(c_mktsegment), 'size', CASE WHEN c_custkey % 3 = 0 THEN 'L' ELSE 'S' END, 'tags', array('MED', cast(c_nationkey as string)), 'rate', c_custkey % 7 + 0.5)) FROM {{customer}}"""


def attributed(spark: SparkSession, sf_dir: str) -> Model:
    """The model whose parts and customers have attributes outside the core columns."""
    m = model(spark, sf_dir)
    return m.with_(nodes=m.nodes.join(on_spark(spark, sf_dir, ATTRS_SQL), "id", "left"))


def _documents() -> str:
    used = {s for r in DOCUMENT_ROWS for s in r[9]}
    row = "SELECT '{}' AS doc_path, {} AS doc_ord, '{}' AS id_prefix, {} AS external, {} AS mandatory, {} AS is_root, {} AS is_leaf, {} AS rtf"
    return " UNION ALL ".join(row.format(r[0], r[1], r[4], r[5], r[6], not r[9] or r[5], r[0] not in used, "'" + ",".join(r[8]) + "'" if r[8] is not None else "cast(null as varchar)") for r in DOCUMENT_ROWS)


#: Common table expressions that the oracles start with.
CTES = f"""WITH RECURSIVE d_ AS ({_documents()}),
n_ AS ({plain(NODES_SQL)}),
r_ AS ({plain(REFS_SQL)}),
v_ AS (SELECT *, cast(null as varchar) AS verifies FROM ({plain(RESULTS_SQL)}) UNION ALL {plain(CASES_SQL)}),
p_ AS (SELECT n_.*, d_.doc_ord, d_.external, d_.is_root, d_.is_leaf, coalesce(own_rtf, d_.rtf) AS eff, concat(',', coalesce(suppress, ''), ',') AS sup, parent_id IS NOT NULL AS is_child, lower(coalesce(nullif(status, ''), 'approved')) = 'approved' AS provider FROM n_ JOIN d_ USING (doc_path)),
b_ AS (SELECT *, CASE WHEN regexp_matches(ref, '~[0-9]+$') THEN cast(regexp_extract(ref, '~([0-9]+)$', 1) AS bigint) END AS pin, regexp_replace(ref, '~[0-9]+$', '') AS bare FROM r_),
q_ AS (SELECT *, CASE WHEN contains(bare, '/') THEN split_part(bare, '/', 1) END AS q, CASE WHEN contains(bare, '/') THEN split_part(bare, '/', 2) ELSE bare END AS lid FROM b_),
t_ AS (SELECT q_.from_id, q_.pos, q_.ref, q_.pin, t.id AS to_id FROM q_ LEFT JOIN n_ t ON t.id = q_.lid AND (q_.q IS NULL OR t.doc_path = q_.q)),
e_ AS (SELECT from_id, to_id, ref, pin, pos, 'trace' AS kind FROM t_ WHERE to_id IS NOT NULL
       UNION ALL SELECT c.id, q.id, NULL, NULL, 2147483647, 'parent' FROM n_ c JOIN n_ q ON q.id = c.parent_id),
l_ AS (SELECT from_id, to_id, arg_max(ref, pos) AS ref, arg_max(pin, pos) FILTER (pin IS NOT NULL) AS pin FROM e_ WHERE kind = 'trace' GROUP BY ALL)
"""
