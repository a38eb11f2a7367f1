"""Content trees from flat, ordered blocks (file, ord, level, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.model import cut

LEVELS = range(1, 7)


def parents(nodes: DataFrame) -> DataFrame:
    """Adds parent_ord: the nearest earlier block with a smaller level; null for roots (level 0 and first of their depth).

    One window per file; a heading level has at most six values, so the last
    position of each smaller level is a running maximum.
    """
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    level = F.col("level")
    zero = F.max(F.when(level == 0, F.col("ord"))).over(w)
    last = {k: F.max(F.when(level == k, F.col("ord"))).over(w) for k in LEVELS}
    near = F.greatest(F.lit(-1).cast("long"), *(F.when(F.lit(k) < level, F.coalesce(v, F.lit(-1).cast("long"))).otherwise(F.lit(-1).cast("long")) for k, v in last.items()))
    root = (level == 0) | (near < 0) | (F.coalesce(zero, F.lit(-1).cast("long")) > near)
    return nodes.withColumn("parent_ord", F.when(~root, near))


def requirement_parents(nodes: DataFrame) -> DataFrame:
    """Adds req_parent_ord: the nearest enclosing requirement; other blocks are passed through. Depth is at most six."""
    t = cut(parents(nodes))
    up = t.select("file", F.col("ord").alias("_at"), F.col("kind").alias("_k"), F.col("parent_ord").alias("_pp"))
    x = t.withColumn("_at", F.col("parent_ord"))
    for _ in LEVELS:
        x = x.join(up, ["file", "_at"], "left").select(*t.columns, F.when(F.col("_k") == "req", F.col("_at")).otherwise(F.col("_pp")).alias("_at"))
    return x.withColumnRenamed("_at", "req_parent_ord")


def promote_containers(nodes: DataFrame) -> DataFrame:
    """Info blocks that have a child become containers."""
    t = parents(nodes)
    has = t.filter("parent_ord IS NOT NULL").select("file", F.col("parent_ord").alias("ord")).distinct().withColumn("_has", F.lit(True))
    return t.join(has, ["file", "ord"], "left").withColumn("kind", F.when((F.col("kind") == "info") & F.col("_has"), "container").otherwise(F.col("kind"))).drop("_has")


def prune(nodes: DataFrame, keep: Column) -> DataFrame:
    """Requirements that fail ``keep`` go; their children attach to what then encloses them."""
    t = cut(parents(nodes).withColumn("_keep", (F.col("kind") != "req") | F.coalesce(keep, F.lit(False))))
    up = t.select("file", F.col("ord").alias("parent_ord"), F.col("_keep").alias("_pk"), F.col("parent_ord").alias("_pp"))
    x = t.filter("_keep").drop("_keep")
    names = x.columns
    for _ in LEVELS:
        x = x.join(up, ["file", "parent_ord"], "left").select(*(F.when(F.col("_pk"), F.col("parent_ord")).otherwise(F.col("_pp")).alias(c) if c == "parent_ord" else F.col(c) for c in names))
    return x


def anchors(nodes: DataFrame, by: str = "doc_path") -> DataFrame:
    """Adds anchor: ``item-N`` for blocks that aren't requirements, in document order; the id for requirements."""
    n = F.count_if(F.col("kind") != "req").over(Window.partitionBy(by).orderBy("file", "ord").rowsBetween(Window.unboundedPreceding, 0))
    return nodes.withColumn("anchor", F.when(F.col("kind") == "req", F.col("id")).otherwise(F.concat(F.lit("item-"), n)))


def by_depth(items: DataFrame) -> DataFrame:
    """Adds depth below the roots to (id, parent_id); a row that no root leads to (a cycle, a parent that isn't there) is an error."""
    x = cut(items.select("id", "parent_id"))
    front = cut(x.filter("parent_id IS NULL").select("id", F.lit(0).alias("depth")))
    out, depth = front, 0
    while True:
        depth += 1
        front = cut(x.join(front.select(F.col("id").alias("parent_id")), "parent_id").select("id", F.lit(depth).alias("depth")))
        if not front.limit(1).count():
            break
        out = out.unionByName(front)
    lost = x.join(out, "id", "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"no root leads to {', '.join(r['id'] for r in lost)}: a cycle or a missing parent")
    return out


def flatten(nodes: DataFrame) -> DataFrame:
    """Requirements in document order, depth first: adds position, from 1 within a file."""
    return nodes.filter("kind = 'req'").withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("ord")))
