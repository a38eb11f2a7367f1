"""The project API: one object over a tree of requirement documents."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import expr
from tracelake.model import cut
from tracelake.operators import attributes, checks, coverage, diff, graph, verify, views
from tracelake.sources import markdown, readers, sinks


class Project:
    """Requirements under ``root``, optionally with test reports; every method returns a DataFrame."""

    def __init__(self, spark: SparkSession, root: str, results: str | None = None, tool: str | None = None):
        """``tool`` is the name in extension keys (``x-<tool>``); without it the only one in use counts, and several are an error."""
        self.spark, self.tool = spark, tool
        self.model, self.blocks, self.schemas = readers.read_tree(spark, root, tool)
        self.warnings: DataFrame | None = None
        if results:
            found, self.warnings = readers.read_reports(spark, results, tool)
            self.model = self.model.with_(results=cut(found))
        self.model = graph.prepared(self.model)

    def check(self, filter: str | None = None, relaxed_versions: bool = False, ignore_unbound: bool = False, disjoint: tuple[str, ...] = ()) -> DataFrame:
        """All findings: level, code, direction, outcome, req_id, file, message.

        A filter limits coverage, disposition, pin and verdict checks, never
        resolution. ``ignore_unbound`` leaves out unbound tests, but no other
        trouble with results. What can't be read is a finding (``parse``,
        ``config``, ``results``), never an error of this method. Attributes named in ``disjoint``, or by the schemas' own
        ``disjoint-check``, must share a value along every edge.
        """
        rows = [("ERROR", "config", "", "", "", "", x) for x in readers.config_errors(self.schemas, self.tool)]
        lost = {d: s.error for d, s in sorted(self.schemas.items()) if isinstance(s, markdown.Unreadable)}
        rows += [("ERROR", "parse", "", "", f"{d}/schema.yaml", f"{d}/schema.yaml", e) for d, e in lost.items()]
        parse = self.blocks.filter("kind = 'error'").select(F.lit("ERROR").alias("level"), F.lit("parse").alias("code"), F.lit("").alias("direction"), F.lit("").alias("outcome"), F.col("file").alias("req_id"), "file", F.col("error").alias("message"))
        names = {*disjoint, *(a for s in self.schemas.values() for a in readers.extension(s, self.tool).get("disjoint-check") or [])}
        listed = lambda a: F.from_json(F.get_json_object("attrs", f"$['{a}']"), "array<string>")
        values = {a: self.blocks.filter("kind = 'req' AND attrs IS NOT NULL").select("id", listed(a).alias("vals")).filter("vals IS NOT NULL") for a in sorted(names)}
        ids = None if filter is None else self.matching(filter)
        out = checks.findings(self.model, ids, relaxed_versions, self.schemas, values).drop("check_ord")
        out = parse.unionByName(out).unionByName(self.spark.createDataFrame(rows, out.select(*parse.columns).schema).select(*parse.columns))
        if self.warnings is not None:
            unbound = F.col("message").startswith("unbound-result:")
            said = self.warnings if not ignore_unbound else self.warnings.filter(~unbound)
            level, code = F.when(unbound, "WARNING").otherwise("ERROR"), F.when(unbound, "unbound-result").otherwise("results")
            out = out.unionByName(said.select(level.alias("level"), code.alias("code"), F.lit("").alias("direction"), F.lit("").alias("outcome"), F.lit("").alias("req_id"), F.col("source").alias("file"), "message"))
        return out

    def documents(self) -> DataFrame:
        """doc_path, title, meta (frontmatter) and what the schema says."""
        return self.model.documents.join(readers.document_meta(self.blocks), "doc_path", "left")

    def attributes(self) -> DataFrame:
        """What a filter may name: attr, declared, found."""
        return attributes.filterable(self.model, self.declared())

    def declared(self) -> dict[str, list[str]]:
        """The attributes that each document's schema declares."""
        return {d: list(s.get("properties") or {}) for d, s in self.schemas.items()}

    def matching(self, filter: str, relaxed: bool = False) -> DataFrame:
        """Ids of the requirements that match; an attribute that no schema declares is an error unless ``relaxed``."""
        return expr.matching_ids(self.model.nodes, filter, relaxed, {a for own in self.declared().values() for a in own})

    def filter_warnings(self, filter: str) -> list[str]:
        """What a relaxed filter warns of: names that no schema declares, and whether any requirement has them."""
        declared = {a for own in self.declared().values() for a in own}
        odd = sorted(set(expr.Filter(filter, self.model.nodes.schema, True, declared=declared).refs) - declared - expr.BUILTIN)
        found = {r["attr"] for r in attributes.universes(self.model).filter(F.col("attr").isin(odd)).collect()} if odd else set()
        return [f'attribute "{a}" is declared by no schema' if a in found else f'unknown attribute "{a}"' for a in odd]

    def histogram(self) -> DataFrame:
        """How often each declared attribute has each text: doc_path, attr, value, n."""
        return attributes.histogram(self.model, self.declared())

    def facets(self) -> DataFrame:
        """Attributes worth choosing from: doc_path, attr, values."""
        return attributes.facets(self.model)

    def ls(self, filter: str | None = None) -> DataFrame:
        n = sinks.requirements(self.blocks)
        return n if filter is None else n.filter(F.col("kind") != "req").unionByName(n.join(self.matching(filter), "id", "left_semi").select(*n.columns))

    def stats(self) -> DataFrame:
        return attributes.document_summary(self.model).join(coverage.summary(self.model).filter("doc_path IS NOT NULL"), "doc_path")

    def export(self, path: str) -> None:
        """requirements, traces, findings and, with results, results as NDJSON folders."""
        sinks.ndjson(sinks.requirements(self.blocks), f"{path}/requirements", ["doc_path", "id", "ord"])
        sinks.ndjson(graph.traces(self.model), f"{path}/traces", ["from_id", "ref"])
        sinks.ndjson(self.check(), f"{path}/findings", ["req_id", "code", "message"])
        if self.model.results is not None:
            sinks.ndjson(verify.nested(self.model), f"{path}/results", ["measure_id"])

    def repin(self, promote_unpinned: bool = False) -> DataFrame:
        return graph.repin_deltas(self.model, promote_unpinned)

    def search(self, query: str) -> DataFrame:
        """The best requirements for a query: id, title, score (less is better; from 5 on fuzzy)."""
        return views.search(self.model.nodes.filter("kind = 'req'"), query)

    def diff(self, other: Project) -> DataFrame:
        """Requirements of ``other`` against these: doc_path, id, category."""
        own = ["status", "version", "verify", "disposition", "disposition_reason", "trace", "attrs"]
        return diff.requirements(self.blocks.filter("kind = 'req'"), other.blocks.filter("kind = 'req'"), ["doc_path", "id"], own)


def at_tag(spark: SparkSession, repository: str, tag: str, shared_dir: str | None = None, tool: str | None = None) -> Project:
    """The project as of a git tag, unpacked under ``shared_dir``, which all executors must see; only a single process does without."""
    if shared_dir is None and not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("shared_dir: name a folder that all executors see")
    target = tempfile.mkdtemp(prefix=f"tag-{tag}-".replace("/", "-"), dir=shared_dir)
    return Project(spark, readers.git_archive(repository, tag, target), tool=tool)

