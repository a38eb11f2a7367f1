"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal text are linked. Each linked document starts with a shard
label of its own. Round by round, a join brings the labels that a document's
neighbours have by now; the group moves to the shard that most of its members
are in, among those with room for the others, and quotas (exact running totals
against each shard's capacity) decide which moves happen. Documents of one group
and one first label move alike, so they are one row of the rounds. Groups larger
than a shard are first split into as many parts as shards they need. What is
still apart after the last round, and all documents without links, then fill
the shards up in one order that keeps groups together, so sizes come out even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, cut, table, utf8

ROUNDS = 8
CHUNK_ROWS = 2000  # rows whose running total one window makes, on average


def running(df: DataFrame, by: list[str], order: Column, value: str, total: int, ties: list[Column], depth: int = 0) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over earlier rows of the same ``by``, in the order of a 64-bit ``order``, then ``ties``.

    Rows are cut into chunks by the top bits of ``order``, which should differ
    from row to row; the chunks' sums are summed the same way, and a window runs
    within each chunk, so no window holds a whole group. ``total`` is the number
    of rows of the largest group, about.
    """
    bits = max(0, min(40, (max(1, total) // CHUNK_ROWS).bit_length()))
    o, c, s, e, w = (f"_{x}{depth}" for x in "ocsew")
    rows = df.withColumn(o, order)
    if not bits:
        over = Window.partitionBy(*by).orderBy(o, *ties).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("before", F.sum(value).over(over) - F.col(value)).drop(o)
    rows = rows.withColumn(c, F.shiftright(o, 64 - bits))
    sums = rows.groupBy(*by, c).agg(F.sum(value).alias(s))
    sums = cut(running(sums, by, F.shiftleft(c, 64 - bits), s, 1 << bits, [], depth + 1).select(*by, c, F.col("before").alias(e)))
    own = F.sum(value).over(Window.partitionBy(*by, c).orderBy(o, *ties).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    rows = rows.withColumn(w, own).join(sums, [*by, c])
    return rows.withColumn("before", F.col(e) + F.col(w)).drop(o, c, e, w)


def cut_links(placed: DataFrame, group: list[str], shard: str) -> int:
    """Pairs of documents of one group that lie in different shards."""
    n = placed.groupBy(*group, shard).agg(F.count("*").alias("n")).groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return n.agg(F.coalesce(F.sum(F.expr("(n * n - q) div 2")), F.lit(0))).first()[0]


def propagate(cells: DataFrame, shards: int, room_each: int, rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """Balanced label propagation over ``cells`` (key, start, w, n): the weight and number of a group's documents that start in a shard.

    Returns the cells with their shard ``now``, null for groups still apart,
    and the weight in each shard, which never exceeds ``room_each``.
    """
    spark = cells.sparkSession
    cells = cut(cells)
    many = cells.count()
    stays = running(cells, ["start"], F.xxhash64("key"), "w", many // shards, [F.col("key")])
    cells = cut(stays.select("key", "start", "w", "n", F.when(F.col("before") + F.col("w") <= room_each, F.col("start")).alias("now")))
    for turn in range(rounds):
        load = [0] * shards
        for r in cells.filter("now IS NOT NULL").groupBy("now").agg(F.sum("w").alias("w")).collect():
            load[r["now"]] = r["w"]
        room = spark.createDataFrame([(s, room_each - load[s]) for s in range(shards)], "now int, room long")
        widest = max(range(shards), key=lambda s: -load[s])
        labels = cells.groupBy("key", "now").agg(F.sum("n").alias("votes"), F.sum("w").alias("w"))
        groups = labels.groupBy("key").agg(F.sum("w").alias("gw"), F.count("*").alias("apart"), F.count("now").alias("named")).filter("apart > 1 OR named = 0")
        best = labels.join(F.broadcast(room), "now").join(groups, "key").filter("gw - w <= room")
        best = best.groupBy("key").agg(F.max_by(F.struct("now", "w"), F.struct("votes", F.xxhash64("key", "now", F.lit(turn)))).alias("b"))
        there = labels.filter(F.col("now") == widest).select("key", F.col("w").alias("there"))
        wish = groups.join(best, "key", "left").join(there, "key", "left").select("key", F.coalesce("b.now", F.lit(widest)).alias("to"), (F.col("gw") - F.coalesce("b.w", "there", F.lit(0))).alias("need"))
        wish = cut(wish)
        ranked = running(wish, ["to"], F.xxhash64("key", F.lit(turn)), "need", wish.count(), [F.col("key")])
        moves = cut(ranked.join(F.broadcast(room.withColumnRenamed("now", "to")), "to").filter("before + need <= room").select("key", "to"))
        if not moves.limit(1).count():
            break
        cells = cut(cells.join(moves, "key", "left").select("key", "start", "w", "n", F.coalesce("to", "now").alias("now")))
    apart = cells.groupBy("key").agg(F.countDistinct("now").alias("k"), F.count_if(F.col("now").isNull()).alias("z")).filter("k > 1 OR z > 0").select("key")
    cells = cut(cells.join(apart.withColumn("_gone", F.lit(True)), "key", "left").select("key", "start", "w", "n", F.when(F.col("_gone").isNull(), F.col("now")).alias("now")))
    load = [0] * shards
    for r in cells.filter("now IS NOT NULL").groupBy("now").agg(F.sum("w").alias("w")).collect():
        load[r["now"]] = r["w"]
    return cells, load


def shard(docs: DataFrame, shards: int = 40, law: str = "rows", text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    ``law`` is ``rows`` (counts at most one apart) or ``bytes`` (sizes equal
    but for about a document). Size is the text's UTF-8 bytes (null: none)
    plus 16. Null and empty texts are equal, so linked. Texts of any length,
    rows repeated or with a null id are placed like any other; no documents
    give no rows.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    raw = utf8(text)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), raw.alias("t")).select("doc_id", (F.octet_length("t") + 16).cast("long").alias("size"), F.crc32("t").alias("text_crc32"), F.xxhash64("t").alias("g"), F.xxhash64(F.lit(1), "t").alias("h"))
    base = cut(base.withColumn("weight", F.lit(1).cast("long") if law == "rows" else F.col("size")))
    count, weight = base.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    target = [weight // shards + (s < weight % shards) for s in range(shards)]
    least = weight // shards

    groups = base.groupBy("g", "h").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.max("weight").alias("most")).filter("n > 1")
    parts = F.greatest(F.lit(1), F.ceil((F.col("w") * 1.1 + F.col("most")) / max(1, least))).cast("long")
    groups = cut(groups.select(F.struct("g", "h").alias("key"), "n", F.when(F.col("w") <= least, 1).otherwise(parts).cast("long").alias("parts")))
    own = ["doc_id", "size", "text_crc32", "weight"]
    keyed = cut(attach(base.withColumn("key", F.struct("g", "h")), groups, "key", "n", count).select(*own, "g", "h", "n", "parts"))
    singles = keyed.filter("n IS NULL").select(*own)
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", "g"), "parts")).otherwise(F.lit(0).cast("long"))
    start = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int")
    linked = keyed.filter("n IS NOT NULL").select(*own, F.struct("g", "h", part.alias("part")).alias("key"), start.alias("start"))
    cells, load = propagate(linked.groupBy("key", "start").agg(F.sum("weight").alias("w"), F.count("*").alias("n")), shards, least, rounds)
    spot = cells.select(F.struct("key", "start").alias("cell"), "n", F.col("now").alias("shard"))
    placed = cut(attach(linked.withColumn("cell", F.struct("key", "start")), spot, "cell", "n", count).select(*own, "key", "shard"))

    ends, at = [], 0
    for s in range(shards):
        at += target[s] - load[s]
        ends.append(at)
    left = placed.filter("shard IS NULL")
    sums = left.groupBy("key").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    sums = cut(running(sums, [], F.xxhash64("key"), "w", sums.count(), [F.col("key")]).select("key", "n", F.col("before").alias("first")))
    within = running(left, ["key"], F.xxhash64("doc_id", "text_crc32"), "weight", left.count(), [F.col("doc_id"), F.col("text_crc32")])
    left = attach(within, sums, "key", "n", count).select(*own, (F.col("first") + F.col("before")).alias("before"))
    after = left.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    free = running(singles, [], F.xxhash64("doc_id", "text_crc32"), "weight", count, [F.col("doc_id"), F.col("text_crc32")])
    free = left.unionByName(free.select(*own, (F.col("before") + after).alias("before")))
    place = F.lit(0)
    if shards > 1:
        marks = F.array(*(F.lit(e).cast("long") for e in ends[:-1]))
        place = F.size(F.filter(marks, lambda e: e <= F.col("before")))
    filled = free.select(*own, place.cast("int").alias("shard"))
    everyone = cut(placed.filter("shard IS NOT NULL").select(*own, "shard").unionByName(filled)).withColumn("one", F.lit(1).cast("long"))
    slots = running(everyone, ["shard"], F.xxhash64("doc_id", "text_crc32"), "one", count // shards, [F.col("doc_id"), F.col("size")])
    return slots.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("before").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
