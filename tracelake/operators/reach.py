"""What is reached from where: cycles by contraction, closures over the condensed graph.

Paths without branches cost rounds in proportion to the logarithm of their
length. Every loop writes its state to the shared checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.model import cut

STEPS = 8  # rounds of single steps before paths are doubled
_EDGE = ["from_id", "to_id"]


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges whose source has an incoming and whose target has an outgoing edge."""
    sources, targets = e.select(F.col("from_id").alias("to_id")).distinct(), e.select(F.col("to_id").alias("from_id")).distinct()
    return e.join(sources, "to_id", "left_semi").join(targets, "from_id", "left_semi").select(*_EDGE)


def _followed(single: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Pointers (id, to) followed to their end by doubling.

    Gives the pointers of 1, 2, 4, ... steps, where the end of a chain stays
    itself; (id, end) of all that leave the chain; and (id, comp) of the ids on
    pure cycles of pointers, named by the largest of them. What is neither
    leads into such a cycle.
    """
    n, steps, jump = single.count(), 1, single.withColumn("most", F.greatest("id", "to"))
    tables = [jump]
    while True:
        beyond = jump.join(single.select(F.col("id").alias("to"), F.lit(True).alias("on")), "to", "left")
        beyond = beyond.select("id", "to", "most", F.coalesce("on", F.lit(False)).alias("on"))
        if steps >= n or beyond.filter("on").isEmpty():
            break
        further = jump.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("most").alias("more"))
        jump = cut(jump.join(further, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.greatest("most", "more").alias("most")))
        tables.append(jump)
        steps *= 2
    lost = beyond.filter("on")  # after as many steps as there are pointers: the ids arrived at lie on pure cycles
    ring = lost.select("id", "most").join(lost.select(F.col("to").alias("id")).distinct(), "id").select("id", F.col("most").alias("comp"))
    return tables, beyond.filter("NOT on").select("id", F.col("to").alias("end")), ring


def components(e: DataFrame) -> DataFrame:
    """(id, comp) of the ids on cycles of ``e`` (from_id, to_id): strongly connected components with an edge inside, named by one of their ids.

    Each level drops ids without an incoming or outgoing edge, then contracts
    ids with one outgoing edge into where that leads (``_followed``), turning
    the edges round for the next level, until nothing is left or nothing gives
    way; what then is left, where every id branches both ways, is coloured.
    """
    e = cut(e.select(*_EDGE))
    own = e.filter("from_id = to_id").select(F.col("from_id").alias("id"), F.col("from_id").alias("comp")).distinct()
    e = cut(_trimmed(e.filter("from_id <> to_id").select(*_EDGE)).distinct())
    return _largest(cut(own).unionByName(_components(e, 0)))


def _largest(found: DataFrame) -> DataFrame:
    """A self-loop's id inside a larger component counts with that: one row an id."""
    sized = found.join(found.groupBy("comp").agg(F.count("*").alias("n")), "comp")
    return sized.groupBy("id").agg(F.max_by("comp", F.struct("n", "comp")).alias("comp"))


def _components(e: DataFrame, stuck: int) -> DataFrame:
    before = e.count()
    if not before:
        return e.select(F.col("from_id").alias("id"), F.col("to_id").alias("comp")).limit(0)
    e = cut(_trimmed(e))
    out = cut(e.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n"), F.max("to_id").alias("to")))
    single = cut(out.filter("n = 1").select("id", "to"))
    if single.isEmpty():
        stuck = 0 if e.count() < before else stuck + 1
        return coloured(e) if stuck == 2 else _components(e.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), stuck)
    tables, ends, ring = _followed(single)
    ends, parts = cut(ends), [cut(ring)]
    branching = out.filter("n > 1").select("id")
    gone = single.select("id").join(ends.select("id"), "id", "left_anti")  # leads into a pure cycle
    steps = e.join(branching.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    steps = cut(steps.join(ends.select(F.col("id").alias("to_id"), "end"), "to_id", "left").select("from_id", "to_id", F.coalesce("end", "to_id").alias("end")))
    over = steps.select("from_id", F.col("end").alias("to_id")).distinct().join(branching.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*_EDGE)
    over = cut(over)
    if over.isEmpty():
        return parts[0]
    loops = over.filter("from_id = to_id").select(F.col("from_id").alias("id"), F.col("from_id").alias("comp"))
    inner = cut(_largest(loops.unionByName(_components(over.filter("from_id <> to_id").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), 0))))
    parts.append(inner)
    # ids on a way from a branching id to the next one of its component
    at = lambda c: inner.withColumnsRenamed({"id": c, "comp": f"c_{c}"})
    way = steps.filter("to_id <> end").join(at("from_id"), "from_id").join(at("end"), "end").filter("c_from_id = c_end").select(F.col("to_id").alias("id"), F.col("c_end").alias("comp")).distinct()
    way = cut(way)
    if not way.isEmpty():
        for jump in tables:
            moved = way.join(jump, "id").select(F.col("to").alias("id"), "comp")
            way = cut(way.unionByName(moved).distinct())
        parts.append(way.join(single.select("id"), "id", "left_semi"))
    return reduce(DataFrame.unionByName, parts).distinct()


def coloured(e: DataFrame) -> DataFrame:
    """(id, comp) of cycles by colouring: every id takes the largest id that reaches it; the component of that id is what reaches it back within the colour."""
    found = e.select(F.col("from_id").alias("id"), F.col("to_id").alias("comp")).limit(0)
    while not e.isEmpty():
        ids = e.select(F.col("from_id").alias("id")).union(e.select("to_id")).distinct()
        colour = cut(propagate(e.select(F.col("from_id").alias("child"), F.col("to_id").alias("parent")), ids.withColumn("c", F.col("id")), [], "c"))
        inside = e.join(colour.withColumnsRenamed({"id": "from_id", "c": "cf"}), "from_id").join(colour.withColumnsRenamed({"id": "to_id", "c": "ct"}), "to_id").filter("cf = ct")
        inside = cut(inside.select(*_EDGE))
        whole = cut(tiers(inside.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), colour.filter("id = c").select("id")).select("id"))
        on = inside.join(whole.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(whole.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
        on = on.select(F.col("from_id").alias("id")).union(on.select("to_id")).distinct().join(colour, "id")
        found = found.unionByName(cut(on.select("id", F.col("c").alias("comp"))))
        done = colour.filter("id = c").select("id").unionByName(whole).distinct()
        rest = e.join(done.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(done.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
        e = cut(_trimmed(rest.select(*_EDGE)))
    return found


def propagate(e: DataFrame, seeds: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least fixpoint of (id, keys..., value) under ``value = max`` along edges child -> parent.

    ``e`` (child, parent), ``seeds`` (id, keys..., value). Only entries that
    are new or have risen move on, so each round's join is as small as the
    change, and the maximum is idempotent, so cycles end too. The state is the
    union of the rounds' changes, merged only now and then.
    """
    e = cut(e.select("child", "parent").distinct())
    front = cut(seeds.groupBy("id", *keys).agg(F.max(value).alias(value)))
    parts = [front]
    while front.limit(1).count():
        state = reduce(DataFrame.unionByName, parts)
        if len(parts) > 4:
            state = cut(state.groupBy("id", *keys).agg(F.max(value).alias(value)))
            parts = [state]
        moved = front.withColumnRenamed("id", "child").join(e, "child").select(F.col("parent").alias("id"), *keys, F.col(value).alias("_new"))
        both = moved.withColumn("_old", F.lit(None).cast(state.schema[value].dataType)).unionByName(state.select("id", *keys, F.lit(None).cast(state.schema[value].dataType).alias("_new"), F.col(value).alias("_old")))
        risen = both.groupBy("id", *keys).agg(F.max("_new").alias(value), F.max("_old").alias("_old")).filter(F.col(value).isNotNull() & (F.col("_old").isNull() | (F.col(value) > F.col("_old"))))
        front = cut(risen.select("id", *keys, value))
        parts.append(front)
    return reduce(DataFrame.unionByName, parts).groupBy("id", *keys).agg(F.max(value).alias(value))


def tiers(e: DataFrame, start: DataFrame) -> DataFrame:
    """Breadth-first distance from the ids of ``start`` (id): (id, depth), along from_id -> to_id, until nothing new is reached."""
    e = cut(e.select("from_id", "to_id").distinct())
    front = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    state, depth = front, 0
    while front.limit(1).count():
        depth += 1
        step = front.select(F.col("id").alias("from_id")).join(e, "from_id").select(F.col("to_id").alias("id")).distinct()
        front = cut(step.join(state, "id", "left_anti").withColumn("depth", F.lit(depth)))
        state = state.unionByName(front)
        if depth % 8 == 0:
            state = cut(state)
    return state


@dataclass(frozen=True)
class Reach:
    """What each of some ids reaches: ``pairs`` (id, at), itself included; ids on cycles stand for their component (``members``: id, comp), if there are any."""

    pairs: DataFrame
    members: DataFrame | None = None

    def lift(self, seeds: DataFrame, keys: list[str], value: str) -> DataFrame:
        """(id, keys..., value): the maximum of the seeds (id, keys..., value) over all that reach an id. The seeds move once."""
        if self.members is not None:
            seeds = seeds.join(self.members, "id", "left").withColumn("id", F.coalesce("comp", "id")).drop("comp")
        there = seeds.join(self.pairs, "id").groupBy(F.col("at").alias("id"), *keys).agg(F.max(value).alias(value))
        if self.members is None:
            return there
        each = there.join(self.members.select(F.col("comp").alias("id"), F.col("id").alias("member")), "id", "left")
        return each.withColumn("id", F.coalesce("member", "id")).select("id", *keys, value)


def reach(e: DataFrame, starts: DataFrame) -> Reach:
    """Reach of ``starts`` (id) along ``e`` (child, parent).

    Shallow graphs without cycles in reach take one join a step. Where paths go
    on after ``STEPS`` rounds, cycles are condensed, which leaves a graph
    without any, and its closure comes by doubling, in rounds that grow with
    the logarithm of the depth.
    """
    e = cut(e.select("child", "parent").filter("child <> parent").distinct())
    front = cut(starts.select("id").filter("id IS NOT NULL").distinct().withColumn("at", F.col("id")))
    parts = [front]
    for _ in range(STEPS):
        front = cut(front.join(e.select(F.col("child").alias("at"), "parent"), "at").select("id", F.col("parent").alias("at")).distinct())
        if front.isEmpty():
            return Reach(cut(reduce(DataFrame.unionByName, parts).distinct()))
        parts.append(front)
    members = cut(components(e.select(F.col("child").alias("from_id"), F.col("parent").alias("to_id"))))
    named = lambda df, c: df.join(members.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("comp", c)).drop("comp")
    e = named(named(e, "child"), "parent").filter("child <> parent").distinct()
    starts = named(starts.select("id").filter("id IS NOT NULL"), "id").distinct()
    pairs = cut(e.select(F.col("child").alias("id"), F.col("parent").alias("at")))
    fresh = pairs
    while not fresh.isEmpty():  # pairs over up to twice as many steps
        further = fresh.join(pairs.select(F.col("id").alias("at"), F.col("at").alias("next")), "at").select("id", F.col("next").alias("at"))
        further = further.unionByName(pairs.select("id", F.col("at").alias("mid")).join(fresh.select(F.col("id").alias("mid"), "at"), "mid").select("id", "at")).distinct()
        fresh = cut(further.join(pairs, ["id", "at"], "left_anti"))
        pairs = cut(pairs.unionByName(fresh))
    own = starts.withColumn("at", F.col("id"))
    return Reach(cut(pairs.join(starts, "id", "left_semi").unionByName(own)), members)
