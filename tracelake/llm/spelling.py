"""Grouping spelling variants: words one edit apart, each led to its commonest neighbour.

The join is an even-partition pigeonhole join at edit distance one. A word is
cut into two segments at half its length and indexed under both; one edit
leaves one of them as it is. A word probes for words of its own length with
its own segments, and for words one code point shorter with the substrings
that their segments would be in it: the prefix where it stands, the suffix
shifted by one. Candidates are verified while the join streams them, so only
pairs one edit apart leave it; a pair that both segments find counts by the
first. Segments shared by many words are split and their probes repeated.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, rows_of, table

LEAST_CHARS = 5
LEAST_COUNT = 3
RATIO = 2  # a form occurs at least so many times as often as the word
SPLIT = 2_000  # words of a segment that one task compares a probe with
WORDS_A_TASK = 10_000  # words, about, whose segments one task of the join holds
ERASE = 97  # of so many hashes of document and word, one loses a letter
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_HELD = 400_000  # distinct words counted before they leave a task


def erased(doc_id: int | None, run: str) -> str:
    """The lower-cased run, or without one code point if ERASE divides the CRC-32 of ``<doc_id>:<run>``; a null id counts as empty."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % ERASE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n): the words of all whole texts, A-Z as a-z, after the erasure, with at least ``least_count`` occurrences.

    Null and empty texts have no words; rows repeated or with a null id count
    like any other. Tasks count before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.record_batch({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return out

        for doc, t in rows_of(batches, "doc_id", "text"):
            if not t:
                continue
            lowered = t.lower() if t.isascii() else t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes lower-case ASCII alone
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for word, n in Counter(_RUN.findall(lowered)).items():
                if not zlib.crc32(word.encode(), start) % ERASE:
                    word = erased(doc, word)
                if len(word) >= least_chars:
                    total[word] += n
            if len(total) > _HELD:
                yield emit()
        yield emit()
        give_back()

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def _entry(length: Column, segment: int, key: Column, rest: Column, first: Column, last: Column) -> Column:
    """One way to find a word: the segment, what else it has, and that rest's first and last half."""
    return F.struct(length.alias("length"), F.lit(segment).alias("segment"), key.alias("key"), rest.alias("rest"), first.alias("first"), last.alias("last"))


def _halves(rest: Column, chars: Column) -> tuple[Column, Column]:
    """First half of ``chars`` code points, and the last code points that are the other half of so many."""
    half = F.floor(chars / 2).cast("int")
    return F.substring(rest, F.lit(1), half), F.substring(rest, half - chars, chars - half)


def near_pairs(words: DataFrame, word: str = "word") -> DataFrame:
    """(a, b): all pairs of distinct words one inserted, deleted or replaced code point apart, each once; b is the longer or, of equal length, the greater one.

    Null and empty words are near nothing. Words may be of any characters and length.
    """
    own = cut(words.select(F.col(word).alias("word")).filter("length(word) > 0").distinct())
    n = F.char_length("word")
    half, shorter = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    sub = lambda start, length: F.substring(F.col("word"), start, length)
    head, tail = sub(F.lit(1), half), sub(half + 1, n - half)
    equal = [_entry(n, 1, head, tail, *_halves(tail, n - half)), _entry(n, 2, tail, head, *_halves(head, half))]
    # in a word one longer: the shorter one's first segment where it stands, its second one place further
    after, before = sub(shorter + 1, n - shorter), sub(F.lit(1), shorter + 1)
    longer = [_entry(n - 1, 1, sub(F.lit(1), shorter), after, *_halves(after, n - 1 - shorter)), _entry(n - 1, 2, sub(shorter + 2, n - 1 - shorter), before, *_halves(before, shorter))]
    keys = ["length", "segment", "key"]
    index = own.select(F.col("word").alias("a"), F.explode(F.array(*equal)).alias("e")).select("a", "e.*")
    probe = own.select(F.col("word").alias("b"), n.alias("chars"), F.explode(F.array(*equal, *longer)).alias("e")).select("b", "chars", "e.*").filter("length > 0")
    large = cut(index.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT).select(*keys, F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")))
    index = index.join(large, keys, "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    probe = probe.join(large, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    keys.append("part")
    spark = words.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), own.count() // WORDS_A_TASK)
    i, p = index.repartition(tasks, *keys).alias("i"), probe.repartition(tasks, *keys).alias("p")
    same = F.col("chars") == F.col("p.length")
    close = (F.col("i.first") == F.col("p.first")) | (F.col("i.last") == F.col("p.last"))
    once = F.when(same, F.col("a") < F.col("b")).otherwise((F.col("i.segment") == 1) | ~F.startswith(F.col("p.rest"), F.col("i.rest")))
    found = [F.col(f"i.{k}") == F.col(f"p.{k}") for k in keys]
    pairs = i.join(p, [*found, close, once, F.levenshtein(F.col("i.rest"), F.col("p.rest"), 1) == 1])
    return pairs.select("a", "b")


def _roots(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by pointer jumping; only links that haven't ended move."""
    open_, done = links.select("word", F.col("form").alias("to")), None
    for _ in range(rounds):
        open_ = cut(open_)
        step = open_.join(open_.select(F.col("word").alias("to"), F.col("to").alias("next")), "to", "left")
        ended = step.filter("next is null").select("word", F.col("to").alias("root"))
        if done is not None:  # links whose end is known already
            known = step.filter("next is null").select("word", "to").join(done.select(F.col("word").alias("to"), "root"), "to", "left")
            ended = known.select("word", F.coalesce("root", "to").alias("root"))
        ended = cut(ended)
        done = ended if done is None else done.unionByName(ended)
        open_ = step.filter("next is not null").select("word", F.col("next").alias("to"))
        if open_.isEmpty():
            return done
    raise RuntimeError(f"chains of forms did not end in {rounds} rounds")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of the distinct ``words`` (word, n).

    form: the near word of largest n, ties by code points, if it occurs at
    least ``ratio`` (over 1) times as often; root: the end of the chain of
    forms, the word itself if it has none. No words give no rows.
    """
    words = cut(words.select("word", "n"))
    pairs = cut(near_pairs(words))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")
    weighed = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = weighed.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    led = words.join(best, "word", "left").withColumn("leads", -F.col("best.less") >= ratio * F.col("n"))
    led = cut(led.select("word", F.expr("if(leads, best.near, null)").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.expr("if(leads, -best.less, null)").alias("form_n")))
    roots = _roots(led.filter("form is not null"))
    return led.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


# CRC-32 (reflected polynomial 0xEDB88320) of the UTF-8 bytes of characters below U+0100
OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) t(i)
),
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
    ) GROUP BY doc_id, run
),
bytes AS (
    SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
        lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + (ord(x) >> 6) AS BIGINT), CAST(128 + (ord(x) & 63) AS BIGINT)] END)) AS b FROM runs
),
hashed AS (
    SELECT run, n, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table
),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
    ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM near GROUP BY word),
led AS (
    SELECT w.word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
    FROM words w LEFT JOIN best USING (word)
),
chain AS (SELECT word, coalesce(form, word) AS at FROM led UNION SELECT c.word, l.form FROM chain c JOIN led l ON l.word = c.at WHERE l.form IS NOT NULL)
SELECT l.word, l.form, c.at AS root, l.n, l.n_near, l.form_n
FROM led l JOIN chain c ON c.word = l.word JOIN led e ON e.word = c.at WHERE e.form IS NULL
"""
