"""Language id: held-out accuracy, the table form of the convolution, odd texts."""

import numpy as np

from tracelake.llm import language_id as L


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = L.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_tables_equal_convolution():
    net = L.ByteConv(["a", "b"], seed=3)
    rng = np.random.default_rng(0)
    rows = np.zeros((5, L.WINDOW + 3), np.uint8)
    rows[:, : L.WINDOW] = rng.integers(0, 256, (5, L.WINDOW))
    e = net.p["emb"][rows]
    z = sum(e[:, j : j + L.WINDOW] @ net.p["conv"][j] for j in range(4)) + net.p["bias"]
    logit = np.maximum(z.max(axis=1), 0) @ net.p["out"] + net.p["off"]
    want = np.exp(logit) / np.exp(logit).sum(axis=1, keepdims=True)
    assert np.allclose(net.probabilities(rows), want, atol=1e-5)


def test_odd_texts(spark):
    rows = [(1, "the of and ing", "en"), (2, "der die und ein", "de"), (3, None, "de"), (4, "", None), (5, "12 % 3", "en"), (6, "the " * 30000, "en"), (7, "½ ² ① 3", "de"), (None, "die und", None), (2, "der die und ein", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["lang_pred"]) for r in L.identify(df.withColumn("score", df.doc_id), L.train(df)).collect()}
    assert {d for d, p in got if p == "und"} == {3, 4, 5, 7}
    assert L.identify(df.limit(0), L.train(df)).count() == 0
    assert {r["lang_pred"] for r in L.identify(df, L.train(df.limit(0))).collect()} == {"und"}
