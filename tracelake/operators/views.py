"""Ranked search, facet search, queues, table order, trace matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.model import Model, cut
from tracelake.operators import coverage, graph, schema, verify


def palette(items: DataFrame, query: str, most: int = 40) -> DataFrame:
    """The best ``most`` items (id, title, ord) for a query: exact id, id prefix, title prefix, id or title substring.

    Ranked by tier, then order; one TakeOrderedAndProject.
    """
    q = query.strip().lower()
    i, t = F.lower("id"), F.lower("title")
    tier = F.when(i == q, 0).when(i.startswith(q), 1).when(t.startswith(q), 2).when(i.contains(q), 3).when(t.contains(q), 4)
    return items.withColumn("tier", tier).filter("tier IS NOT NULL").orderBy("tier", "ord").limit(most).select("id", "title", "tier")


def subsequence_score(text: str, query: str) -> int | None:
    """Gaps and start of the first in-order match of all query characters; null without one. Less is better."""
    at, score, last = 0, 0, -1
    for c in query:
        i = text.find(c, at)
        if i < 0:
            return None
        score += i if last < 0 else i - last - 1
        last, at = i, i + 1
    return score


def subsequence(text: Column, query: str) -> Column:
    """``subsequence_score`` as a Column."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"), F.lit(-1).alias("last"))

    def step(s: Column, c: Column) -> Column:
        i = F.call_function("locate", c, text, s["at"] + 1) - 1
        gap = F.when(s["last"] < 0, i).otherwise(i - s["last"] - 1)
        score = F.when(s["score"].isNull() | (i < 0), F.lit(None).cast("int")).otherwise(s["score"] + gap)
        return F.struct((i + 1).cast("int").alias("at"), score.cast("int").alias("score"), i.cast("int").alias("last"))

    return F.aggregate(F.array(*(F.lit(c) for c in query)), start, step)["score"] if query else F.lit(0)


def fuzzy(items: DataFrame, query: str, most: int = 30) -> DataFrame:
    """The best ``most`` items whose id or title holds the query's characters in order: id, title, score."""
    q = query.strip().lower()

    s = items.withColumn("score", subsequence(F.lower(F.concat_ws(" ", "id", "title")), q)).filter("score IS NOT NULL")
    return s.orderBy("score", "ord").limit(most).select("id", "title", "score")


def _places(found: Column, edge: float) -> Column:
    """A contiguous match: by its place, and more if it is inside a word (``found`` is from 1, of a text with ``edge`` before each place)."""
    return F.when(found > 0, (found - 1) * 0.2 + edge)


def _fuzzy_score(text: Column, needle: str) -> Column:
    """How well letters and digits in order fit a text, less is better, null if they don't.

    The best of three readings: all together; together but for signs, after
    the last place of the first two; anywhere, where neighbours and starts of
    words are cheap and gaps are dear.
    """
    low = F.lower(text)
    plain = F.regexp_replace(low, "[^a-z0-9]", "")
    word = lambda at: (at > 0) & F.substr(low, at, F.lit(1)).rlike("[a-z0-9]")  # noqa: E731  the character before place at + 1
    at = F.locate(needle, low)
    together = _places(at, F.when(word(at - 1), 4.0).otherwise(0.0))
    head = needle[:2]
    back = F.locate(head[::-1], F.reverse(plain))
    first = F.when(back > 0, F.length(plain) - back - len(head) + 1)  # from 0, of the head's last place
    begin = F.struct((first + len(head)).cast("int").alias("at"), F.lit(0).cast("int").alias("skim"))

    def skim(s: Column, c: Column) -> Column:
        nxt = F.call_function("locate", c, plain, s["at"] + 1) - 1
        ok = s["at"].isNotNull() & (nxt >= 0)
        return F.struct(F.when(ok, nxt + 1).cast("int").alias("at"), (s["skim"] + nxt - s["at"]).cast("int").alias("skim"))

    chars = lambda x: F.array(*(F.lit(c) for c in x)) if x else F.array().cast("array<string>")
    end = F.aggregate(chars(needle[2:]), begin, skim)
    dense = F.when(end["at"].isNotNull(), first * 0.2 + end["skim"] * 0.15)

    def walk(s: Column, c: Column) -> Column:
        nxt = F.call_function("locate", c, low, s["at"] + 1) - 1
        gap = nxt - s["last"] - 1
        cost = F.when(gap == 0, -2.0).when(gap <= 2, -1.0).otherwise(gap.cast("double")) - F.when(word(nxt), 0.0).otherwise(1.5)
        return F.struct((nxt + 1).cast("int").alias("at"), nxt.cast("int").alias("last"), F.when(nxt >= 0, s["cost"] + cost).alias("cost"))

    sparse = F.aggregate(chars(needle), F.struct(F.lit(0).cast("int").alias("at"), F.lit(-2).cast("int").alias("last"), F.lit(6.0).alias("cost")), walk)["cost"]
    return F.least(together, dense, F.when(sparse >= 0, sparse))


def search(items: DataFrame, query: str) -> DataFrame:
    """The best items (id, title, ord) for a query: id, title, score.

    Scores: 0 the id; 1 the start of the id or of a part of it; 2 in the id; 3
    the start of the title; 4 in the title; from 5 on the query's letters and
    digits in order, if there are two of them: those of the title count 8 more
    than those of the id. At most 30 items then, else 40; ties by order, then id.
    """
    q = query.strip().lower()
    needle = "".join(c for c in q if c.isascii() and c.isalnum())
    i, t = F.lower("id"), F.lower(F.coalesce("title", F.lit("")))
    quoted = "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in q)
    part = i.rlike(f"[^a-z0-9]{quoted}")
    if len(needle) >= 2:
        parts = F.filter(F.split(i, "[^a-z0-9]+"), lambda p: p != "")
        part |= F.exists(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: p.startswith(needle))
    tier = F.when(i == q, 0).when(part | i.startswith(q), 1).when(i.contains(q), 2).when(t.startswith(q), 3).when(t.contains(q), 4)
    score = tier.cast("double")
    if len(needle) >= 2:
        score = F.coalesce(score, 5 + F.least(_fuzzy_score(F.col("id"), needle), _fuzzy_score(F.coalesce("title", F.lit("")), needle) + 8))
    x = items.withColumn("score", score).filter("score IS NOT NULL")
    return x.orderBy("score", "ord", "id").limit(30 if len(needle) >= 2 else 40).select("id", "title", "score")


def facet_search(items: DataFrame, text: str, selected: dict[str, list[str]], searched: list[str]) -> DataFrame:
    """Rows that contain the text in any of ``searched`` and, for every attribute selected, have one of its values."""
    hit = F.lower(F.concat_ws(" ", *searched)).contains(text.strip().lower()) if text.strip() else F.lit(True)
    return items.filter(reduce(lambda a, b: a & b, (F.coalesce(F.col(k).isin(v), F.lit(False)) for k, v in selected.items() if v), hit))


def queue(items: DataFrame, order: list[str], most: int = 50, by: str = "queue") -> DataFrame:
    """The first ``most`` rows of each queue, with its total.

    Totals come from a partial count, and each task keeps only its own first
    rows before they meet, so a long queue is never gathered.
    """
    total = items.groupBy(by).agg(F.count("*").alias("total"))
    local = Window.partitionBy(by, F.pmod(F.xxhash64(*order), F.lit(64))).orderBy(*order)
    some = items.withColumn("_l", F.row_number().over(local)).filter(F.col("_l") <= most).drop("_l")
    top = some.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("position") <= most)
    return top.join(F.broadcast(total), by)


def work(m: Model) -> DataFrame:
    """What needs attention: queue (missing-coverage, unresolved, broken, stale, missing-verdict, failing), id."""
    m = graph.prepared(m)
    named = lambda df, queue, id_="id": df.select(F.lit(queue).alias("queue"), F.col(id_).alias("id"))
    lost = coverage.coverage_state(m).filter("state IN ('missing-coverage', 'unresolved')").select(F.col("state").alias("queue"), "id")
    parts = [named(graph.broken(m), "broken", "req_id"), named(graph.pin_health(m).filter("direction = 'outdated'").select("from_id").distinct(), "stale", "from_id")]
    if m.results is not None:
        ev = cut(verify.evidence(m))
        gated = verify.measures(m).filter("gated")
        parts.append(named(gated.join(ev.select("id").distinct(), "id", "left_anti"), "missing-verdict"))
        parts.append(named(gated.join(verify.verdicts(ev).filter("verdict = 'fail'"), "id"), "failing"))
    return reduce(DataFrame.unionByName, parts, lost)


def natural(text: Column) -> Column:
    """A key that sorts texts as people do: runs of digits by value, letters without case or accents.

    A run of digits becomes its length and itself without leading zeros, so
    that comparing keys compares numbers of any length.
    """
    value = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    run = lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(value(r)).cast("string"), 9, "0"), value(r))).otherwise(r)
    return F.collate(F.array_join(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), run), ""), "UNICODE_CI_AI")


def table_order(column: Column, descending: bool = False) -> list[Column]:
    """Sort keys: empties last either way, numbers by value before texts in natural order."""
    text = F.nullif(F.trim(column.cast("string")), F.lit(""))
    number = text.try_cast("double")
    keys = [F.nanvl(number, F.lit(None)), natural(text)]
    return [text.isNull().asc(), number.isNull().asc(), *(k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys)]


def positions(items: DataFrame, order: list[Column]) -> DataFrame:
    """Adds position, from 1, in the order of the keys.

    A range partitioning sorts; sizes of the partitions before give each row's
    place, so no task sees all rows.
    """
    p = cut(items.repartitionByRange(items.sparkSession.sparkContext.defaultParallelism, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    before = p.groupBy("_part").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = before.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return p.join(F.broadcast(before), "_part").withColumn("position", (rank + F.col("_before")).cast("long")).drop("_part", "_before")


def cells(links: DataFrame) -> DataFrame:
    """The trace matrix in long form: from_id, to_id, linked (1); no limit on rows and columns."""
    return links.select("from_id", "to_id").distinct().withColumn("linked", F.lit(1))


def search_index(m: Model, page: str = ".html") -> DataFrame:
    """Every requirement for a search over all documents: id, title, doc_path, href."""
    return graph.definitions(m).select("id", "title", "doc_path", F.concat("doc_path", F.lit(f"{page}#"), "id").alias("href"))


def attribute_rows(m: Model, properties: list[str]) -> DataFrame:
    """The attributes that a requirement has: id, attr, value, position; ``properties`` in order, then members of ``attrs`` that aren't declared, A to Z."""
    own = [F.struct(F.lit(p).alias("attr"), F.col(schema.COLUMNS.get(p, p)).cast("string").alias("value"), F.lit(i + 1).alias("position")) for i, p in enumerate(properties) if schema.COLUMNS.get(p, p) in m.nodes.columns]
    rows = F.array(*own)
    if "attrs" in m.nodes.columns:
        members = F.map_entries(F.coalesce(F.from_json("attrs", "map<string,string>"), F.create_map().cast("map<string,string>")))
        rest = F.array_sort(F.filter(members, lambda e: ~e["key"].isin(*properties)))
        declared = [F.struct(F.lit(p).alias("attr"), F.element_at(F.from_json("attrs", "map<string,string>"), F.lit(p)).alias("value"), F.lit(i + 1).alias("position")) for i, p in enumerate(properties) if schema.COLUMNS.get(p, p) not in m.nodes.columns]
        rows = F.concat(rows, *([F.array(*declared)] if declared else []), F.transform(rest, lambda e, i: F.struct(e["key"].alias("attr"), e["value"].alias("value"), (i + len(properties) + 1).alias("position"))))
    x = m.nodes.filter("kind = 'req'").select("id", F.explode(rows).alias("r")).select("id", "r.*")
    return x.filter("value IS NOT NULL")


def page_model(m: Model) -> DataFrame:
    """What a requirement's card shows: id, doc_path, state, verdict, up_links (declared), down_links (distinct)."""
    m = graph.prepared(m)
    up = graph.traces(m).groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("up_links"))
    down = graph.last_refs(m).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("down_links"))
    x = coverage.coverage_state(m).select("id", "doc_path", "state").join(up, "id", "left").join(down, "id", "left")
    x = x.join(verify.verdicts(verify.evidence(m)).select("id", "verdict"), "id", "left") if m.results is not None else x.withColumn("verdict", F.lit(None).cast("string"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return x.select("id", "doc_path", "state", "verdict", zero("up_links"), zero("down_links"))


def real_links(m: Model) -> DataFrame:
    """Declared references of authored requirements, without those to synthetic nodes: the rows of ``graph.traces``."""
    t = graph.traces(m)
    synthetic = r"^(RESULT|TC):"
    return t.filter(~F.col("from_id").rlike(synthetic) & ~F.coalesce(F.col("to_id").rlike(synthetic), F.lit(False)))


def chips(status: Column, state: Column, verdict: Column) -> Column:
    """The labels of a card: status, then coverage unless not required, then the verdict."""
    words = {"covered": "covered", "missing-coverage": "missing coverage", "unresolved": "unresolved source"}
    cover = reduce(lambda a, kv: a.when(state == kv[0], kv[1]), list(words.items())[1:], F.when(state == "covered", "covered"))
    return F.filter(F.array(F.coalesce(F.nullif(status, F.lit("")), F.lit("approved")), cover, verdict), lambda x: x.isNotNull())


def matrix(links: DataFrame, most_cells: int = 20_000) -> DataFrame:
    """Rows by id, a column for each target with 1 or null; refused above ``most_cells``."""
    rows, columns = links.agg(F.countDistinct("from_id"), F.countDistinct("to_id")).first()
    if rows * columns > most_cells:
        raise ValueError(f"{rows} x {columns} cells are more than {most_cells}")
    names = [r[0] for r in links.select("to_id").distinct().orderBy("to_id").collect()]
    return links.groupBy("from_id").pivot("to_id", names).agg(F.max(F.lit(1)))
