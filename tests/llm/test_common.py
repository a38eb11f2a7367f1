"""Components, joins and hashing shared by the operators."""

import numpy as np
import pytest

from tracelake.llm import common as C


@pytest.mark.parametrize("local", [True, False])
def test_min_label(spark, local):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(-40, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(60)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r["id"]: r["component"] for r in C.min_label(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}


def test_attach_splits_hot_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(2, 1), (None, 2)], "k long, x long")
    right = spark.createDataFrame([(1, 3000, "a"), (2, 1, "b")], "k long, n long, v string")
    got = C.attach(left, right, "k", "n", 3002)
    assert got.count() == 3002 and {(r["k"], r["v"]) for r in got.collect()} == {(1, "a"), (2, "b"), (None, None)}


def test_words_by_blocks_equal_whole(monkeypatch):
    text = "Ab c\tdé " * 500 + "x" * 3000 + " End"
    whole = C.words(text)
    monkeypatch.setattr(C, "BLOCK", 512)
    parts = C.words(text)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert [text.encode()[a:b].decode() for a, b in zip(*whole[1:])] == text.split()
    assert not len(C.words(None)[0]) and not len(C.shingles(C.words("")[0], 3))
    assert len(C.shingles(C.words("a b")[0], 3)) == 1
