"""Snapshot comparison by full outer joins on keys; values compare null-safely."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 12  # rows of a piece of a result whose rows are counted


def requirements(old: DataFrame, new: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """keys, category (added, removed, modified, unchanged) by presence and attribute values."""
    a = old.select(*keys, F.struct(*attrs).alias("_a"))
    b = new.select(*keys, F.struct(*attrs).alias("_b"))
    same = F.col("_a").eqNullSafe(F.col("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("category"))


def attributes(old: DataFrame, new: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """keys, attr, old_value, new_value of every attribute that differs among rows on both sides; null: not set."""

    def unpivot(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias(name)) for a in attrs))
        return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.attr", f"p.{name}")

    x = unpivot(old, "old_value").join(unpivot(new, "new_value"), [*keys, "attr"])
    return x.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def elements(old: DataFrame, new: DataFrame, keys: list[str], attr: str) -> DataFrame:
    """Elements of a list attribute that differ at their place: keys, attr, index, old_value, new_value."""
    own = lambda df, name: df.select(*keys, F.posexplode(attr).alias("index", name))
    both = old.select(*keys).join(new.select(*keys), keys)
    x = own(old.join(both, keys, "left_semi"), "old_value").join(own(new.join(both, keys, "left_semi"), "new_value"), [*keys, "index"], "full_outer")
    return x.filter(~F.col("old_value").eqNullSafe(F.col("new_value"))).select(*keys, F.lit(attr).alias("attr"), "index", F.col("old_value").cast("string").alias("old_value"), F.col("new_value").cast("string").alias("new_value"))


def summary(changes: DataFrame, by: str) -> DataFrame:
    """Categories counted by ``by`` and, with a null ``by``, in total."""
    many = lambda c: F.count_if(F.col("category") == c).alias(c)
    return changes.rollup(by).agg(many("added"), many("removed"), many("modified"), many("unchanged"))


def schemas(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_path, path, change, old_value, new_value of two flattened schemas (doc_path, path, value)."""
    x = old.select("doc_path", "path", F.col("value").alias("old_value"), F.lit(True).alias("_o")).join(new.select("doc_path", "path", F.col("value").alias("new_value"), F.lit(True).alias("_n")), ["doc_path", "path"], "full_outer")
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("changed")
    differs = F.col("_o").isNull() | F.col("_n").isNull() | ~F.col("old_value").eqNullSafe(F.col("new_value"))
    return x.filter(differs).select("doc_path", "path", kind.alias("change"), "old_value", "new_value")


def flatten_schema(doc_path: str, schema: object, path: str = "") -> list[tuple[str, str, str]]:
    """Leaves of a nested schema as (doc_path, path, JSON text); lists keep their index as a path element."""
    import json

    if isinstance(schema, dict) and schema:
        return [r for k in sorted(schema) for r in flatten_schema(doc_path, schema[k], f"{path}.{k}" if path else str(k))]
    if isinstance(schema, list) and schema:
        return [r for i, v in enumerate(schema) for r in flatten_schema(doc_path, v, f"{path}.{i}")]
    return [(doc_path, path, json.dumps(schema, sort_keys=True))]


def submodules(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change, old_sha, new_sha (7 characters) of added, removed and updated submodules (path, sha).

    A path may repeat: each of its old rows meets each new one. Rows that are
    alike are counted and meet once; what they give is written out in pieces
    of CHUNK rows, dealt out evenly.
    """
    a = old.groupBy("path", F.col("sha").alias("o")).agg(F.count("*").alias("_a"))
    b = new.groupBy("path", F.col("sha").alias("n")).agg(F.count("*").alias("_b"))
    x = a.join(b, "path", "full_outer").filter(~F.col("o").eqNullSafe(F.col("n")))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("updated")
    total = F.coalesce("_a", F.lit(1)) * F.coalesce("_b", F.lit(1))
    x = x.select("path", kind.alias("change"), F.left("o", F.lit(7)).alias("old_sha"), F.left("n", F.lit(7)).alias("new_sha"), total.alias("_n"))
    names, step = x.columns[:-1], F.lit(CHUNK).cast("long")
    x = x.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"), step)).alias("_at"))
    x = x.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names, "_at")
    return x.select(*names, F.explode(F.sequence("_at", F.least("_n", F.col("_at") + step - 1))).alias("_row")).drop("_row")
