"""Copies of a model for load tests: ids, references and results renamed alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import refs as R
from tracelake.model import Model


def copies(df: DataFrame, many: int) -> DataFrame:
    """Every row ``many`` times, with its copy's number in ``copy``, from 0; rows multiply where they lie."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))))


def renamed(id_: Column) -> Column:
    """An id of copy k > 0 gets the infix ``-Rk`` before its number; copy 0 keeps its ids."""
    return F.when(F.col("copy") > 0, F.regexp_replace(id_, F.lit("-([0-9]+)$"), F.concat(F.lit("-R"), F.col("copy"), F.lit("-$1")))).otherwise(id_)


def renamed_ref(ref: Column) -> Column:
    """A reference with its id renamed; qualifier and pin stay."""
    bare = R.strip_pin(ref)
    q = R.qualifier(bare)
    return F.concat(F.when(q.isNotNull(), F.concat(q, F.lit("/"))).otherwise(""), renamed(R.local_id(bare)), F.coalesce(F.concat(F.lit("~"), R.pin(ref).cast("string")), F.lit("")))


def replicate(m: Model, many: int) -> Model:
    """``many`` copies of all requirements, references and results in the same documents."""
    nodes = copies(m.nodes, many).withColumns({"id": renamed(F.col("id")), "file": F.when(F.col("copy") > 0, F.concat(F.col("file"), F.lit("."), F.col("copy"))).otherwise(F.col("file"))})
    if "parent_id" in nodes.columns:
        nodes = nodes.withColumn("parent_id", renamed(F.col("parent_id")))
    refs = copies(m.refs, many).withColumns({"from_id": renamed(F.col("from_id")), "ref": renamed_ref(F.col("ref"))})
    results = None if m.results is None else copies(m.results, many).withColumn("measure_id", renamed_ref(F.col("measure_id")))
    return m.with_(nodes=nodes.drop("copy"), refs=refs.drop("copy"), results=None if results is None else results.drop("copy"))
