"""The pipeline's stages, each against a plain version on the rows it was given."""

import pytest

import corpus_pipeline as P
from tests.llm.test_decontaminate import plain, tokens
from tests.llm.test_jaccard_join import brute
from tests.llm.test_packing import check

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for _, f in P.STAGES[:-1]:
        docs = f(spark, docs, D).cache()
        out.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert docs.columns == spark.read.parquet(f"{D}/documents.parquet").columns
    out.append(P.STAGES[-1][1](spark, docs, D).collect())
    return out


def test_stages(spark, kept):
    everyone = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    clean, once, apart, safe, packed = kept
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{D}/labels.parquet").filter("toxic = 1").collect()}
    assert len(clean) >= 0.8 * len(everyone) and len(set(everyone) - set(clean) - toxic) <= 0.05 * len(everyone)
    last = {}
    for d, t in clean.items():
        last[t] = max(d, last.get(t, d))
    assert once == {d: t for t, d in last.items()}
    assert set(apart) == {d for d, (_, c) in brute(sorted(once.items()), 5, 80, 100).items() if d == c}
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    seeds = {tuple(w[j : j + 5]) for w in items for j in range(len(w) - 4)}
    for d, t in apart.items():
        w = tokens(t)
        shares = any(tuple(w[j : j + 5]) in seeds for j in range(len(w) - 4))
        if not shares:
            assert d in safe
        elif len(w) < 2000:
            assert (d in safe) == all(plain(w, i, min(5, len(i))) < 0.8 * len(i) for i in items)
    check(packed, sorted(safe.items()))


def test_run(spark):
    assert P.run(spark, D).count() > 0


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a calm text of nine words that stands alone"), (3, "a calm text of nine words that stands alone"), (None, "text without an id but words"), (4, long), (5, long + " end"), (6, "   ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, dedup_sha string, score double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    got = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {None, 2, 3, 4, 6}
    assert sorted((r["doc_id"], r["start"]) for r in got if r["doc_id"] != 4 and r["doc_id"] is not None) == [(2, 0), (3, 0), (6, 0)]
    assert sum(r["length"] for r in got if r["doc_id"] == 4) == next(r["doc_tokens"] for r in got if r["doc_id"] == 4)
