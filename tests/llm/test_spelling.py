"""Spelling variants: equal to a version that compares every two words."""

import zlib
from collections import Counter

import pytest

from tracelake.llm import spelling as S


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("split", [2_000, 2])
def test_equals_comparing_all(spark, monkeypatch, split):
    monkeypatch.setattr(S, "SPLIT", split)
    few = ["aabbb", "aabb", "abbb", "aabbbb", "aabab", "ababa", "babab", "étééé", "étéé", "éteéé", "a", "b", "ab", "ba", "", "x" * 300, "x" * 301, "x" * 299, "x" * 150 + "y" + "x" * 150]
    words = {w: 1 + zlib.crc32(w.encode()) % 50 for w in few if w}
    for k in range(300):  # many words of three letters in few lengths
        w = "".join("abc"[(k * 7919 >> j) % 3] for j in range(5 + k % 3))
        words[w] = 3 + k * k % 101
    words |= {f"chain{'abcdefghij'[: i + 1]}": 2 ** (12 - i) for i in range(10)}
    frame = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, form string")
    assert got(S.variants(frame)) == plain(words)
    pairs = [tuple(sorted(r)) for r in S.near_pairs(frame).collect()]
    assert len(pairs) == len(set(pairs))


def test_query_equals_the_plain_version_on_counts(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    words: Counter = Counter()
    for d, t in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        run = ""
        for c in lowered + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{d}:{run}".encode())
                words[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    words = {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}
    rows = got(S.op11_spelling_variants(spark, sf_dir))
    assert {r[0]: r[3] for r in rows} == words
    some = {w: n for w, n in words.items() if len(w) in (7, 8, 9)}
    assert got(S.variants(spark.createDataFrame(list(some.items()), "word string, n long"))) == plain(some)


def test_odd_documents(spark):
    rows = [(None, "Maison maison MAISON Ècole x"), (1, None), (2, ""), (3, "maison " * 30_000), (3, "maison"), (4, "日本 abcdé×ábcd"), (4, "abcdé×ábcd"), (4, "abcdé×ábcd")]
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n int")
    assert S.erased(None, "maison") == "maison" and S.erased(3, "maison") == "mison"  # 97 divides the hash of the second
    found = {r["word"]: r["n"] for r in S.word_counts(docs).collect()}
    assert found == {"maison": 3, "mison": 30_001, "abcdé×ábcd": 3}
    assert S.variants(S.word_counts(docs.limit(0))).count() == 0
    assert {r["word"]: (r["form"], r["n_near"]) for r in S.variants(S.word_counts(docs)).collect()} == {"maison": ("mison", 1), "mison": (None, 1), "abcdé×ábcd": (None, 0)}
