"""Trace graph: resolution, edges, pins, repin deltas, identity checks, cycles.

All frames stay distributed: references resolve by equi joins (documents, one
row per directory, come to the rows: ``by_document``; heavily referenced
requirements are found by a sketch and join where the references lie), windows
partition by requirement or reference pair, and loops cut their lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import refs as R
from tracelake.model import Model, column, cut
from tracelake.operators import skew
from tracelake.operators.reach import components, tiers


PARENT_POS = (1 << 31) - 1  # parent edges come after all references
FEW_DOCUMENTS = 1 << 17  # up to so many, what is known of documents is broadcast


def by_document(m: Model, left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, a row or a few for each of the model's documents or their tokens.

    A document may hold most of the rows, so ``left`` stays where it lies:
    Spark can't know how few documents are, and would deal the rows out by
    document, or broadcast them. Beyond FEW_DOCUMENTS only the rows of small
    documents are dealt out.
    """
    if "few" not in m.derived:
        m.derived["few"] = m.documents.limit(FEW_DOCUMENTS + 1).count() <= FEW_DOCUMENTS
    if m.derived["few"]:
        return left.join(F.broadcast(right), key, how)
    own = [key] if isinstance(key, str) else key
    return skew.attach(left, right, key, how, skew.hot_keys(left, k=own[-1])["k"])


def rows(m: Model) -> int:
    """Rows of the larger of nodes and references, counted once a model: by them shuffles get their number of tasks."""
    if "rows" not in m.derived:
        m.derived["rows"] = max(m.nodes.count(), m.refs.count())
    return m.derived["rows"]


def definitions(m: Model) -> DataFrame:
    """Requirements, first definition of each id (documents in order, then position).

    Joins on their id run in as many tasks as these are dealt out to.
    """
    if "definitions" in m.derived:
        return m.derived["definitions"]
    at = by_document(m, m.nodes.filter("kind = 'req'"), m.documents.select("doc_path", "doc_ord", "external", "ignore_status"), "doc_path")
    w = Window.partitionBy("id").orderBy("doc_ord", "file", "ord")
    return skew.spread(at, rows(m), "id").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def prepared(m: Model) -> Model:
    """The model with its definitions, resolved references and edges written once, for operators that read them several times.

    What is read back isn't dealt out any more, so definitions are dealt out
    by rows again: else Spark would merge the tasks of every join with them.
    """
    if "edges" not in m.derived:
        if "definitions" not in m.derived:
            m.derived["definitions"] = skew.spread(cut(definitions(m)), rows(m), "id")
        m.derived.setdefault("resolved", cut(resolve(m)))
        m.derived["edges"] = cut(edges(m))
    return m


def duplicate_ids(m: Model) -> DataFrame:
    """Every later definition of an id: id, doc_path, first_doc."""
    at = by_document(m, m.nodes.filter("kind = 'req'"), m.documents.select("doc_path", "doc_ord"), "doc_path")
    w = Window.partitionBy("id").orderBy("doc_ord", "file", "ord")
    at = skew.spread(at, rows(m), "id")
    ranked = at.withColumn("rn", F.row_number().over(w)).withColumn("first_doc", F.first("doc_path").over(w))
    return ranked.filter("rn > 1").select("id", "doc_path", "first_doc")


def document_ids(m: Model) -> DataFrame:
    """document_id, doc_path: of documents that share an id the last one counts."""
    return m.documents.filter("document_id <> ''").groupBy("document_id").agg(F.max_by("doc_path", "doc_ord").alias("doc_path"))


def hot(m: Model) -> dict[str, list]:
    """Ids that are a hot key of references, as their target or their source, and of nesting, as the parent; found once a model."""
    if "hot" not in m.derived:
        found = skew.hot_keys(m.refs, target=R.local_id(R.strip_pin(F.col("ref"))), source="from_id")
        if "parent_id" in m.nodes.columns:
            found |= skew.hot_keys(m.nodes.filter("coalesce(parent_id, '') <> ''"), parent="parent_id")
        m.derived["hot"] = {"target": [], "source": [], "parent": []} | found
    return m.derived["hot"]


def targets(m: Model) -> DataFrame:
    """All declared references: from_id, pos, ref, pin, to_id (null if broken), strict.

    Unqualified ids resolve globally; ``doc/ID`` by document id, then by
    directory. ``strict`` is to_id only where no directory stands in for a document id.
    """
    bare = R.strip_pin(F.col("ref"))
    r = m.refs.select("from_id", "pos", "ref", R.pin(F.col("ref")).alias("pin"), R.qualifier(bare).alias("_q"), R.local_id(bare).alias("_id"))
    by_id = document_ids(m).select(F.col("document_id").alias("_q"), F.col("doc_path").alias("_dir"))
    r = by_document(m, r, by_id, "_q", "left")
    target = definitions(m).select(F.col("id").alias("_id"), F.col("id").alias("to_id"), F.col("doc_path").alias("_at"))
    r = skew.attach(r, target, "_id", "left", hot(m)["target"])
    direct = F.col("_dir").isNotNull() & (F.col("_at") == F.col("_dir"))
    local = F.col("_at") == F.col("_q")
    at = lambda local: F.when(F.coalesce(F.col("_q").isNull() | direct | local, F.lit(False)), F.col("to_id"))
    return r.select("from_id", "pos", "ref", "pin", at(local).alias("to_id"), at(local & F.col("_dir").isNull()).alias("strict"))


def resolve(m: Model, directory_fallback: bool = True) -> DataFrame:
    """All declared references: from_id, pos, ref, pin, to_id (null if broken); with ``directory_fallback`` as the checks do (``targets``)."""
    if directory_fallback and "resolved" in m.derived:
        return m.derived["resolved"]
    return targets(m).select("from_id", "pos", "ref", "pin", F.col("to_id" if directory_fallback else "strict").alias("to_id"))


def parent_edges(m: Model) -> DataFrame:
    """Edges from nested requirements to the requirement around them: from_id, to_id; to_id is null if there is none of that id."""
    own = m.nodes.filter("kind = 'req'").select(F.col("id").alias("from_id"), column(m.nodes, "parent_id", "string").alias("_p")).filter("coalesce(_p, '') <> ''")
    return skew.attach(own, definitions(m).select(F.col("id").alias("_p"), F.col("id").alias("to_id")), "_p", "left", hot(m)["parent"]).select("from_id", "to_id", F.col("_p").alias("parent_id"))


def edges(m: Model) -> DataFrame:
    """Resolved references and, after them, parents as edges: from_id, to_id, ref, pin, pos, kind (trace or parent)."""
    if "edges" in m.derived:
        return m.derived["edges"]
    traces = resolve(m).filter("to_id IS NOT NULL").select("from_id", "to_id", "ref", "pin", "pos", F.lit("trace").alias("kind"))
    if "parent_id" not in m.nodes.columns:
        return traces
    up = parent_edges(m).filter("to_id IS NOT NULL")
    return traces.unionByName(up.select("from_id", "to_id", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("pin"), F.lit(PARENT_POS).alias("pos"), F.lit("parent").alias("kind")))


def trace_edges(m: Model) -> DataFrame:
    return edges(m).filter("kind = 'trace'")


def lost_parents(m: Model) -> DataFrame:
    """Nested requirements whose parent isn't defined: req_id, parent_id."""
    return parent_edges(m).filter("to_id IS NULL").select(F.col("from_id").alias("req_id"), "parent_id")


def broken(m: Model) -> DataFrame:
    own = skew.spread(m.nodes.filter("kind = 'req'").select(F.col("id").alias("from_id"), F.col("file"), "suppressions"), rows(m), "from_id").dropDuplicates(["from_id"])
    bad = resolve(m).filter("to_id IS NULL").join(own, "from_id").filter(~R.suppressed(F.col("suppressions"), "broken-ref"))
    return bad.select(F.lit("WARNING").alias("level"), F.lit("broken-ref").alias("code"), F.col("from_id").alias("req_id"), "file", F.concat(F.lit("broken reference: "), "ref").alias("message"))


def traces(m: Model) -> DataFrame:
    """One row per declared reference: from_id, to_id, doc_path, ref, file, pin, resolved."""
    own = definitions(m).select(F.col("id").alias("from_id"), "doc_path", "file")
    return skew.attach(resolve(m, directory_fallback=False), own, "from_id", "inner", hot(m)["source"]).select("from_id", "to_id", "doc_path", "ref", "file", F.coalesce("pin", F.lit(0)).alias("pin"), F.col("to_id").isNotNull().alias("resolved"))


def last_pin() -> Column:
    """The last pin that any of some references has."""
    return F.max_by("pin", F.when(F.col("pin").isNotNull(), F.col("pos"))).alias("pin")


def last_refs(m: Model) -> DataFrame:
    """For each (from, to): the last reference and the last pin that any of them has."""
    return skew.spread(trace_edges(m), rows(m), "from_id", "to_id").groupBy("from_id", "to_id").agg(F.max_by("ref", "pos").alias("ref"), last_pin())


def linked(m: Model, pairs: DataFrame, *own: str, how: str = "inner") -> DataFrame:
    """``pairs`` (from_id, to_id) with the target's version and external, and the columns ``own`` of the source; rows of heavily used ids stay where they lie."""
    t = definitions(m).select(F.col("id").alias("to_id"), "version", "external")
    s = definitions(m).select(F.col("id").alias("from_id"), *own)
    return skew.attach(skew.attach(pairs, t, "to_id", how, hot(m)["target"]), s, "from_id", "inner", hot(m)["source"])


def direction() -> Column:
    """Of a reference with pin, its target's version and external, its source's suppressions: outdated or predated; null if the pin is as it should be."""
    off = F.expr("pin IS NOT NULL AND NOT coalesce(external, false) AND coalesce(version, 0) <> 0 AND pin <> version") & ~R.suppressed(F.col("suppressions"), "version-pin")
    return F.when(off, F.when(F.col("pin") < F.col("version"), "outdated").otherwise("predated"))


def pin_health(m: Model) -> DataFrame:
    """Pins that differ from the target's version: from_id, to_id, pin, version, direction."""
    x = linked(m, last_refs(m), "suppressions").filter("pin IS NOT NULL").withColumn("direction", direction())
    return x.filter("direction IS NOT NULL").select("from_id", "to_id", "pin", "version", "direction")


def repin_deltas(m: Model, promote_unpinned: bool = False) -> DataFrame:
    """References to rewrite: file, req_id, source_ref, kind, new_ref."""
    x = linked(m, last_refs(m), "file").filter("NOT coalesce(external, false) AND coalesce(version, 0) <> 0")
    kind = F.when(F.col("pin").isNull(), "unpinned").when(F.col("pin") < F.col("version"), "outdated").when(F.col("pin") > F.col("version"), "predated")
    x = x.withColumn("kind", kind).filter("kind IS NOT NULL")
    x = x if promote_unpinned else x.filter("kind <> 'unpinned'")
    x = x.filter("from_id NOT RLIKE '^(RESULT|TC):'")  # synthetic nodes have no file of their own
    return x.select("file", F.col("from_id").alias("req_id"), F.col("ref").alias("source_ref"), "kind", F.concat(R.strip_pin(F.col("ref")), F.lit("~"), F.col("version")).alias("new_ref"))


def degrees(m: Model, in_filter: DataFrame | None = None) -> DataFrame:
    """Distinct neighbours of every requirement, or those in ``in_filter`` (id): id, upstream, downstream."""
    e = edges(m).select("from_id", "to_id").distinct()
    seen = lambda c: F.lit(1) if in_filter is None else F.col(c)
    if in_filter is not None:
        ids = in_filter.select("id", F.lit(1).alias("in")).distinct()
        for c in ("from", "to"):
            e = e.join(ids.withColumnsRenamed({"id": f"{c}_id", "in": f"{c}_in"}), f"{c}_id", "left").fillna(0, [f"{c}_in"])
    ends = e.select(F.col("from_id").alias("id"), seen("to_in").alias("u"), F.lit(0).alias("d")).unionByName(e.select(F.col("to_id").alias("id"), F.lit(0).alias("u"), seen("from_in").alias("d")))
    n = ends.groupBy("id").agg(F.sum("u").alias("upstream"), F.sum("d").alias("downstream"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return definitions(m).select("id").join(n, "id", "left").select("id", zero("upstream"), zero("downstream"))


def ambiguous(m: Model) -> DataFrame:
    """Unqualified references to an id that several directories define (strict mode): from_id, ref, dirs."""
    many = m.nodes.filter("kind = 'req'").groupBy("id").agg(F.countDistinct("doc_path").alias("dirs")).filter("dirs > 1")
    bare = R.strip_pin(F.col("ref"))
    plain = m.refs.filter(R.qualifier(bare).isNull()).select("from_id", "ref", bare.alias("id"))
    return plain.join(many, "id").select("from_id", "ref", "dirs")


def prefix_checks(m: Model) -> DataFrame:
    """Ids without their document's prefix, and files that share a prefix with another: req_id, file, problem."""
    d = m.documents.filter("coalesce(id_prefix, '') <> ''").select("doc_path", "id_prefix")
    x = by_document(m, m.nodes.filter("kind = 'req'"), d, "doc_path").filter(~R.suppressed(F.col("suppressions"), "id-prefix"))
    wrong = x.filter(~F.col("id").startswith(F.col("id_prefix"))).select(F.col("id").alias("req_id"), "file", F.lit("mismatch").alias("problem"))
    owner = x.groupBy("id_prefix").agg(F.min("file").alias("owner"))
    clash = x.select("id_prefix", "file").distinct().join(owner, "id_prefix").filter("file <> owner")
    return wrong.unionByName(clash.select(F.col("id_prefix").alias("req_id"), "file", F.lit("collision").alias("problem")))


def neighbours(m: Model) -> DataFrame:
    """Distinct neighbours in order of first mention: id, direction (up, down), neighbour, position from 1."""
    e = edges(m).join(definitions(m).select(F.col("id").alias("from_id"), "doc_ord", "file", "ord"), "from_id")
    at = F.struct((F.col("kind") == "parent").alias("last"), "doc_ord", "file", "ord", "pos")
    up = e.select(F.col("from_id").alias("id"), F.lit("up").alias("direction"), F.col("to_id").alias("neighbour"), at.alias("at"))
    down = e.select(F.col("to_id").alias("id"), F.lit("down").alias("direction"), F.col("from_id").alias("neighbour"), at.alias("at"))
    first = up.unionByName(down).groupBy("id", "direction", "neighbour").agg(F.min("at").alias("at"))
    return first.select("id", "direction", "neighbour", F.row_number().over(Window.partitionBy("id", "direction").orderBy("at", "neighbour")).alias("position"))


def cyclic_nodes(e: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Ids that lie on a cycle of ``e`` (from_id, to_id); ``suppressed`` (id) are nodes that no cycle is followed through."""
    e = e.select("from_id", "to_id").distinct()
    if suppressed is not None:
        gone = suppressed.select(F.col("id").alias("from_id")).distinct()
        e = e.join(gone, "from_id", "left_anti").join(gone.withColumnRenamed("from_id", "to_id"), "to_id", "left_anti").select("from_id", "to_id")
    return components(e).select("id")


def circular(m: Model) -> DataFrame:
    """Requirements on a cycle of traces and parents; those that suppress ``circular`` break it: id."""
    off = definitions(m).filter(R.suppressed(F.col("suppressions"), "circular")).select("id")
    return cyclic_nodes(edges(m), off)


def chain(links: DataFrame, doc: str) -> DataFrame:
    """The document chain around ``doc`` (links: from_id, to_id of documents): id, depth, direction.

    Breadth first upstream, then downstream over what upstream hasn't reached.
    """
    here = links.sparkSession.createDataFrame([(doc,)], "id string")
    up = cut(tiers(links, here))
    down = tiers(links.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), here).filter("depth > 0")
    down = down.join(up.select("id"), "id", "left_anti").select("id", "depth")
    return up.withColumn("direction", F.when(F.col("depth") == 0, "self").otherwise("up")).unionByName(down.withColumn("direction", F.lit("down")))


def counters(m: Model) -> DataFrame:
    """nodes, trace_edges, parent_edges, documents of the graph, in one row."""
    n, e, d = definitions(m).agg(F.count("*").alias("nodes")), edges(m), m.documents.agg(F.count("*").alias("documents"))
    return n.join(e.agg(F.count_if(F.col("kind") == "trace").alias("trace_edges"), F.count_if(F.col("kind") == "parent").alias("parent_edges"))).join(d)


def repin_summary(deltas: DataFrame) -> DataFrame:
    """References to rewrite counted by file and kind; a null file is the total of a kind, a null kind that of a file."""
    return deltas.cube("file", "kind").agg(F.count("*").alias("n"))
