"""Hot keys: found by a heavy-hitter sketch, joined where their rows lie.

A key with over a SHARE-th of the rows would meet in one task of a shuffle
join. There are fewer than SHARE such keys whatever the table's size, so what
they join with (a row a key, or a few) is small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 512
ROWS = 1 << 20  # rows of a task of a large shuffle, about
_TRACKED = 1 << 13  # items the sketch tracks: it misses no key over 1/(0.75 * _TRACKED) of the rows


def hot_keys(df: DataFrame, **keys: Column | str) -> dict[str, list]:
    """The hot values of several columns of ``df``, by the names given, in one pass; fewer than SHARE each, null never."""
    if not keys:
        return {}
    own = df.select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in keys.items()))
    row = own.agg(F.count("*").alias("_n"), *(F.expr(f"approx_top_k(`{n}`, {SHARE}, {_TRACKED})").alias(n) for n in keys)).first()
    return {n: [x["item"] for x in row[n] if x["item"] is not None and x["count"] * SHARE > row["_n"]] for n in keys}


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to tasks of at most about ROWS of ``rows`` each; as Spark likes where one task would do.

    The number is given outright: Spark merges its own shuffle partitions by
    their compressed bytes, and ids that compress well become tasks of many
    times that in memory.
    """
    parts = rows // ROWS + 1
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if parts == 1 else df.repartition(max(parts, min(own, 4 * parts)), *keys)


def attach(left: DataFrame, right: DataFrame, key: str | list[str], how: str, hot: list) -> DataFrame:
    """``left`` joined with ``right`` on ``key`` (inner, left, left_semi or left_anti); ``right`` has few rows of each key in ``hot``, the hot keys of ``left``.

    Of several keys the last one is that of ``hot``.

    Rows of hot keys, and with a left join rows without a key, stay where they
    are; the others shuffle.
    """
    if not hot:
        return left.join(right, key, how)
    last = F.col(key if isinstance(key, str) else key[-1])
    is_hot = F.coalesce(last.isin(hot), F.lit(False))
    few = right.filter(last.isin(hot))
    return left.filter(is_hot).join(F.broadcast(few), key, how).unionByName(left.filter(~is_hot).join(right.filter(~is_hot), key, how))
