"""Secret scan: base spans against a plain reading of the patterns, odd texts, added findings."""

import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st

from tracelake.llm import secret_scan as S

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain(t):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, t, re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_documents(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = S.op10_secret_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(text) and sum(r["n_assign"] for r in rows) > 5
    for r in rows:
        want = plain(text[r["doc_id"]])
        assert hashlib.sha256(",".join(want).encode()).hexdigest() == r["base_sha256"]
        got = r["spans"].split(",") if r["spans"] else []
        assert [s for s in got if not s.startswith("model:")] == want
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))


@given(st.text(st.sampled_from(list("ab01fF+/_.=-\"': AKIZpasswordtoken_é\n")), max_size=80))
def test_spans_and_candidates(t):
    got = S.base_spans(t)
    assert [f"{S.KINDS[k]}:{a}:{b}" for a, b, k in got] == plain(t)
    runs = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", t) if len(m[0]) >= S.LEAST and re.search("[0-9]|[a-z][A-Z]", m[0])]
    assert S.candidates(t) == runs


def test_model_adds_findings_and_keeps_base_ones(spark):
    import random

    rnd = random.Random(3)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    docs = [(i, f"the line has password={hexes(18)} in it") for i in range(150)]
    docs += [(i, f"see page item-{rnd.randint(1, 9)}-of-the-list-{rnd.randint(1, 9)} there") for i in range(150, 400)]
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "x " * 40_000 + f"line has passwort={hexes(18)}G in"), (None, "token=abcdefghijkl")], "doc_id long, text string")
    net = S.train(df)
    got = {r["doc_id"]: r for r in S.digest(S.scan(df, net)).collect()}
    assert got[900]["spans"] == got[901]["spans"] == "" and got[3]["n_assign"] == 1 and got[None]["spans"] == "assign:0:18"
    fresh = [f"the line has passwort={hexes(17)} in it" for _ in range(100)]
    views = [S._view(t, *c) for t in fresh for c in S.candidates(t)]
    assert S.windows(5, 20) == [(5, 20)] and S.windows(0, 130) == [(0, 56), (56, 112), (74, 130)] and S.windows(3, 115) == [(3, 59), (59, 115)]
    x = S.np.frombuffer(b"".join(views), S.np.uint8).reshape(len(views), -1).astype(S.np.int64)
    assert (net.probability(x) >= net.threshold).mean() > 0.9
    assert sum("model" in got[i]["spans"] for i in range(150, 400)) < 5
    long = spark.createDataFrame([(1, "passwort=" + "lorem-ipsum-dolor-" * 5 + hexes(60) + "G" + "-sit-amet-dolor" * 5, 0), (2, None, 1), (2, None, 1)], "doc_id long, text string, findings int")
    assert [len(r["findings"]) > 0 for r in S.scan(long, net).orderBy("doc_id").collect()] == [True, False, False]
    assert S.scan(df.limit(0), net).count() == 0 and S.train(df.limit(0)).threshold > 1
    assert S.redact("a key=1 b", [(2, 7), (4, 6)]) == "a [secret] b"
