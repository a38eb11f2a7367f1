"""The core relations every operator works on.

documents  one row per document: doc_path, doc_ord, document_id, level,
           id_prefix, external, mandatory_disposition, ignore_status,
           requires_trace_from (null: none declared; empty: opted out),
           upstream_sources
nodes      one row per requirement, container or info block: doc_path, file,
           ord, kind, id, title, status, version, verify, disposition,
           disposition_reason, suppressions, requires_trace_from, and, where
           requirements nest, parent_id (the enclosing requirement's id)
refs       declared trace references: from_id, pos, ref
results    verification results: measure_id, case_key, outcome, verified_at,
           source, load_ord, and, where results synthesise test cases
           (measure_id ``TC:<case>``), verifies (what the case exercises),
           name, description
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENTS = (
    "doc_path string, doc_ord int, document_id string, level string, id_prefix string, external boolean, mandatory_disposition boolean, "
    "ignore_status boolean, requires_trace_from array<string>, upstream_sources array<string>"
)
NODES = (
    "doc_path string, file string, ord bigint, kind string, id string, title string, status string, version int, verify string, "
    "disposition string, disposition_reason string, suppressions array<string>, requires_trace_from array<string>"
)
REFS = "from_id string, pos int, ref string"
RESULTS = "measure_id string, case_key string, outcome string, verified_at timestamp, source string, load_ord bigint"
SEVERITY = {"pass": 1, "skipped": 2, "inconclusive": 3, "fail": 4}


@dataclass(frozen=True)
class Model:
    documents: DataFrame
    nodes: DataFrame
    refs: DataFrame
    results: DataFrame | None = None
    #: What is derived once for all checks: definitions, resolved references, edges (``graph.prepared``), latest results, reach (``verify``).
    derived: dict[str, object] = field(default_factory=dict, init=False, compare=False, repr=False)

    def with_(self, **frames: DataFrame) -> Model:
        return replace(self, **frames)


def column(df: DataFrame, name: str, kind: str) -> Column:
    """An optional column: null of type ``kind`` where the frame has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def cut(df: DataFrame) -> DataFrame:
    """Cut a loop's lineage through the shared checkpoint folder ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tracelake-"))
    return df.checkpoint()
