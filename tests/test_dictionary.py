"""Large dictionaries against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import dictionary, match
from tessera.operators.dictionary import Dictionary, pattern_hits


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("letters", [b"ab", b"abcdef"])
def test_hits_against_brute_force(monkeypatch, small, letters):
    if small:  # texts in pieces, pairs a few at a time
        monkeypatch.setattr(dictionary, "BLOCK", 13)
        monkeypatch.setattr(dictionary, "PAIRS", 5)
    r = random.Random(len(letters) + small)
    word = lambda n: bytes(r.choice(letters) for _ in range(n))
    for _ in range(80):
        patterns = sorted({word(r.randrange(1, r.choice([4, 12, 40]))) for _ in range(r.randrange(1, 60))})
        texts = [word(r.randrange(0, 80)) for _ in range(20)] + [b"", None]
        found = Dictionary.of(patterns).of_rows(texts)
        assert [x.tolist() for x in found] == [[i for i, p in enumerate(patterns) if p in (t or b"")] for t in texts]


def test_overlapping_and_nested_patterns():
    patterns = [b"a" * n for n in (1, 2, 8, 9, 15, 16, 17, 100)] + [b"aaaaaaaab", b"baaaaaaaa", "\u00e9t\u00e9".encode()]
    found = Dictionary.of(patterns).of_rows([b"a" * 16, b"a" * 99 + b"b", "un \u00e9t\u00e9".encode(), b"baaaaaaa", None])
    assert [x.tolist() for x in found] == [[0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 4, 5, 6, 8], [10], [0, 1], []]
    with pytest.raises(ValueError, match="empty"):
        Dictionary.of([b"a", b""])


def test_a_hundred_thousand_patterns():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    patterns = sorted({" ".join(r.choice(words) for _ in range(r.randrange(2, 4))).encode() for _ in range(100_500)})
    texts = [" ".join(r.choice(words) for _ in range(30)).encode() for _ in range(100)] + [b" ".join(r.sample(patterns, 20)) for _ in range(20)]
    assert len(patterns) >= 100_000
    known = set(patterns)
    lengths = sorted({len(p) for p in patterns})
    want = [sorted(t[i : i + n] for n in lengths for i in range(len(t) - n + 1) if t[i : i + n] in known) for t in texts]
    found = Dictionary.of(patterns).of_rows(texts)
    assert [[patterns[i] for i in x] for x in found] == [sorted(set(w)) for w in want] and sum(map(len, found)) >= 400


def test_table_paths_agree(spark, monkeypatch):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcDE") for _ in range(r.randrange(0, 5)))
    texts = spark.createDataFrame([(i, " ".join(word() for _ in range(12)), "x") for i in range(80)] + [(100, None, "x"), (101, "", "x")], "id long, t string, _hits string")
    table = spark.createDataFrame([(i, word(), f"v{i}") for i in range(120)], "pos int, pattern string, value string")

    def results():
        pairs = sorted(map(tuple, match.containing(texts.withColumn("l", F.lower("t")), "l", table.select(F.lower("pattern").alias("p"), "pos"), "p").select("id", "p", "pos").collect()))
        return pairs, *[sorted((x.id, x.value) for x in match.match_table(texts, "id", "t", table, longest).collect()) for longest in (False, True)]

    few = results()
    monkeypatch.setattr(match, "SMALL", 3)
    assert results() == few
    monkeypatch.setattr(match, "MOST", 3)
    assert results() == few
    lower = [(x.id, (x.t or "").lower()) for x in texts.collect()]
    rules = [(x.pos, x.pattern.lower(), x.value) for x in table.collect() if x.pattern]
    assert few[1] == sorted((i, min(((p, v) for p, k, v in rules if k in t), default=(0, None))[1]) for i, t in lower)
    assert few[2] == sorted((i, min(((-len(k), p, v) for p, k, v in rules if k in t), default=(0, 0, None))[2]) for i, t in lower)


def test_hits_keep_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "abc", "q"), (1, "abc", "q"), (None, None, None)], "id long, t string, _row string")
    out = pattern_hits(df, "t", Dictionary.of([b"b", b"c", b"x"]))
    assert out.columns == ["id", "t", "_row", "hits"] and sorted((x.id or 0, x.hits) for x in out.collect()) == [(0, []), (1, [0, 1]), (1, [0, 1])]
    assert pattern_hits(df.filter("false"), "t", Dictionary.of([b"b"])).count() == 0
