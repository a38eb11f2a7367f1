"""N-gram Jaccard join against brute force."""

import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import jaccard_join as J


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    sets = {d: shingle_set(t, n) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for d, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(d)
    near = {p for ds in index.values() for p in combinations(sorted(ds), 2)}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if den * both >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def run(spark, rows, n, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["id"]: (r["n_shingles"], r["component"]) for r in J.components(df, n, num, den).collect()}


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_documents(spark, n, num, den):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows, n, num, den) == brute(rows, n, num, den)


def test_chains_and_edges(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):  # a chain: each differs a little from the one before it
        base[int(rng.integers(300))] = f"x{i}"
        rows.append((i, " ".join(base)))
    rows += [(100, None), (101, ""), (102, "one"), (103, "ONE"), (104, "a b"), (105, "A\tb "), (106, "a b c"), (107, "a b c"), (108, "z " * 50)]
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)
    assert run(spark, [], 3, 90, 100) == {}


def test_keep_one_keeps_columns(spark):
    df = spark.createDataFrame([(3, "a b c d", None, 1), (1, "a b c d", "en", 2), (None, "a b c d", "en", 3), (5, None, None, 4)], "doc_id long, text string, component string, x int")
    got = {r["x"] for r in J.keep_one(df).collect()}
    assert got == {2, 3, 4}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.randoms())
def test_signatures_never_miss(size, changes, rnd):
    pe = J.PartEnum(80, 100)
    rng = np.random.default_rng(rnd.randint(0, 2**32))
    a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    b = np.unique(np.r_[a[min(changes, len(a)) // 2 :], rng.integers(0, 1 << 63, changes - changes // 2, dtype=np.uint64)])
    if pe.linked(a, b) and not np.array_equal(a, b) and len(b):
        assert set(pe.signatures(a).tolist()) & set(pe.signatures(b).tolist())


def test_large_group_over_many_components(spark):
    """Near copies round one text, many just too far apart to link: signatures of many documents span components."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(90):
        w = list(base)
        for j in rng.choice(200, 7, replace=False):
            w[j] = f"x{d}_{j}"
        rows.append((d, " ".join(w)))
    want = brute(rows, 3, 80, 100)
    assert 1 < len({c for _, c in want.values()})
    assert run(spark, rows, 3, 80, 100) == want


def test_common_passage_makes_no_pairs(spark, monkeypatch):
    """Documents that share a passage but no rare words share signatures, but don't meet; groups dealt out over several rows lose no link."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(d, f"{passage} " + " ".join(f"w{d}_{i}" for i in range(30))) for d in range(60)]
    rows += [(100 + d, passage + " " + " ".join(f"x{d}_{j}" if j in rng.choice(24, 2) else f"q{j}" for j in range(24))) for d in range(60)]
    want = brute(rows, 3, 80, 100)
    assert 1 < len({c for d, (_, c) in want.items() if d >= 100}) < 60
    met = []
    across = J._across

    def watched(*args):
        out = across(*args).cache()
        met.extend(tuple(r) for r in out.collect())
        return out

    monkeypatch.setattr(J, "_across", watched)
    monkeypatch.setattr(J, "GROUP_DOCS", 7)
    assert run(spark, rows, 3, 80, 100) == want
    assert not [p for p in met if min(p) < 60]


def test_a_pair_of_many_common_features_comes_once(spark, monkeypatch):
    """Near copies too far apart to link share most of their rare features; groups of three rows tell when they have met before."""
    rng = np.random.default_rng(9)
    rows = []
    for d in range(60):
        changed = set(rng.choice(200, 4, replace=False).tolist())
        rows.append((d, " ".join(f"x{d}_{j}" if j in changed else f"w{j}" for j in range(200))))
    made = []
    groups = J._within_groups

    def watched(*args):
        out = groups(*args)
        made.extend(tuple(r) for r in out.collect())
        return out

    monkeypatch.setattr(J, "_within_groups", watched)
    monkeypatch.setattr(J, "GROUP_DOCS", 20)
    assert run(spark, rows, 3, 80, 100) == brute(rows, 3, 80, 100)
    assert len(set(made)) > 100 and len(made) < 2 * len(set(made))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.randoms())
def test_rarest_features_never_miss(size, changes, rnd):
    pe = J.PartEnum(80, 100)
    rng = np.random.default_rng(rnd.randint(0, 2**32))
    a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    b = np.unique(np.r_[a[min(changes, len(a)) // 2 :], rng.integers(0, 1 << 63, changes - changes // 2, dtype=np.uint64)])
    counts = rng.integers(0, 9, J.SLOTS).astype(np.uint16)
    if len(b) and pe.linked(a, b):
        assert set(pe.rarest(a, counts).tolist()) & set(pe.rarest(b, counts).tolist())
