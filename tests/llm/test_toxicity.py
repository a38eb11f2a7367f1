"""Toxicity: the scan against brute force, held-out quality, odd texts."""

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tracelake.llm import toxicity as T


def brute(s):
    """Maximal segments by definition: the best segment (shortest on ties), then the same left and right of it."""
    def go(a, b):
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if not best or best[0] <= 0:
            return []
        i, j = best[3:]
        return [*go(a, i), (i, j, best[0]), *go(j, b)]

    return go(0, len(s))


@given(st.lists(st.sampled_from([-7, -4, -2, -1, 1, 2, 3, 5, 8, 13]), max_size=14))
def test_scan_finds_every_maximal_segment(s):
    got = T.segments(np.array(s, float))
    assert got == [(a, b, float(x)) for a, b, x in brute(s)]


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = T.op9_toxicity(spark, d).collect()
    assert len(rows) == len(lang)
    en = [r for r in rows if r["held_out"] and r["doc_id"] in toxic and lang[r["doc_id"]] == "en"]
    hit = [r["predicted"] for r in en if toxic[r["doc_id"]]]
    false = [r["predicted"] for r in en if not toxic[r["doc_id"]]]
    print(np.mean(hit), np.mean(false), len(hit))
    assert np.mean(hit) > 0.85 and np.mean(false) < 0.01


def test_held_out_recall_of_each_language(spark):
    d = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in T.op9_toxicity(spark, d).collect() if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    rate = {(x, y): np.mean([r["predicted"] for r in rows if lang[r["doc_id"]] == x and toxic[r["doc_id"]] == y]) for x in ("en", "de", "fr", "es") for y in (0, 1)}
    print(rate)
    assert all(rate[x, 0] < 0.02 for x in ("en", "de", "fr", "es"))
    assert rate["en", 1] > 0.9 and rate["de", 1] > 0.5 and rate["fr", 1] > 0.5 and rate["es", 1] > 0


def test_odd_texts(spark):
    docs = [(i, f"you vile beast x{i} y{i} " * 3 + "and the rest of it") for i in range(40)] + [(i, f"a calm day x{i} and the rest of it " * 3) for i in range(40, 200)]
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (None, "vile beast " * 9), (1, docs[1][1]), (902, "the calm day " * 60_000 + "vile beast vile beast vile beast")], "doc_id long, text string")
    model = T.train(df, labels)
    got = {r["doc_id"]: r for r in T.score(df, model).collect()}
    assert got[5]["predicted"] == 1 and got[100]["predicted"] == got[900]["predicted"] == got[901]["predicted"] == 0 and got[None]["predicted"] == 1
    p = got[902]["passages"]
    assert p and "vile beast" in df.filter("doc_id = 902").first()["text"][p[0]["start"] : p[0]["end"]]
    extra = df.withColumn("score", df.doc_id)
    assert T.clean(extra, model).columns == extra.columns and T.clean(extra, model).filter("doc_id = 5").count() == 0
    assert T.score(df.limit(0), model).count() == 0
    assert {r["predicted"] for r in T.score(df, T.train(df, labels.limit(0))).collect()} <= {0, 1}
