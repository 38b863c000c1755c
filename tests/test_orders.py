"""Orders of text keys and ties, medians, limits, rules and manifests on small frames."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import features, match, splits, text
from tessera.operators.prefix import cumulative, medians, ordinal


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_places_in_orders_of_text(spark, by):
    r = random.Random(1)
    data = [(f"NCT{r.randrange(10**9):09d}", r.choice("ab")) for _ in range(3000)]
    got = ordinal(spark.createDataFrame(data, "k string, g string").repartition(5), by, "k", "n").collect()
    for g in {"a", "b"} if by else {None}:
        part = sorted((x.n, x.k) for x in got if g in (None, x.g))
        assert [k for _, k in part] == sorted(k for k, h in data if g in (None, h)) and [n for n, _ in part] == list(range(1, len(part) + 1))


def test_a_key_that_most_rows_share_is_spread(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 != 0, F.lit(7)).when(F.col("id") % 20 == 0, None).otherwise(9).alias("k"), F.lit(1).alias("one"))
    got = cumulative(df, [], "k", {"n": "one"}, ties=["id"])
    order = sorted(((-1 if r.k is None else r.k), r.id) for r in df.collect())
    assert [(r.k or -1, r.id) for r in got.orderBy("n").collect()] == order
    plan = cumulative(df, [], "k", {"n": "one"}, ties=["id"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("Window")[1].split("Exchange")[0]


def test_long_keys_keep_their_order(spark):
    keys = [2**53 + i for i in range(200)]
    df = spark.createDataFrame([(k,) for k in random.Random(2).sample(keys, 200)], "k long")
    assert [r.k for r in ordinal(df, [], "k", "n").orderBy("n").collect()] == keys
    with pytest.raises(ValueError):
        cumulative(df.withColumn("t", F.col("k").cast("string")), [], "t", {"n": "k"}, descending=True)


def test_medians(spark):
    r = random.Random(3)
    data = [(g, float(r.randrange(40))) for g in "abc" for _ in range(101 if g == "a" else 100)] + [("c", None), ("d", 5.0), ("e", None)]
    got = dict(rows(medians(spark.createDataFrame(data, "g string, x double"), ["g"], "x")))
    assert got == {g: statistics.median(x for h, x in data if h == g and x is not None) for g in "abcd"}
    train = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "x double, y double")
    assert rows(features.impute(train, train.limit(1).withColumn("x", F.lit(None).cast("double")), ["x", "y"])) == [(2.0, None, 1)]


def test_limit_takes_the_first_rows_where_these_have_two_classes(spark):
    df = spark.createDataFrame([(f"NCT{i:03d}", int(i % 5 == 0)) for i in range(40)], "id string, y int")
    assert [r.id for r in splits.class_limit(df, "id", "y", 10).orderBy("id").collect()] == [f"NCT{i:03d}" for i in range(10)]
    late = df.withColumn("y", (F.col("id") >= "NCT030").cast("int"))
    assert [r.id for r in splits.class_limit(late, "id", "y", 10).orderBy("id").collect()] == [f"NCT{i:03d}" for i in (*range(5), *range(30, 35))]
    assert splits.class_limit(late, "id", "y", 40).count() == splits.class_limit(late, "id", "y", 1).count() == 40
    assert splits.class_limit(df.withColumn("y", F.lit(1)), "id", "y", 10).count() == 40
    assert splits.class_limit(df.filter("false"), "id", "y", 10).count() == 0


def test_rules_keep_equal_rows(spark):
    df = spark.createDataFrame([("t", "red ring"), ("t", "red ring"), ("t", "red ring"), ("t", None), (None, "ring"), ("u", "ring")], "k string, text string")
    rules = spark.createDataFrame([("t", 1, "ring", 0.9), ("t", 0, "RED", 0.7), ("u", 0, "bolt", 0.5)], "k string, pos int, keyword string, score double")
    got = match.mixed_match(df, rules, "k", "text", "score", 0.1)
    assert got.columns == ["k", "text", "score"]
    assert rows(got) == rows(spark.createDataFrame([("t", "red ring", 0.7)] * 3 + [("t", None, 0.1), (None, "ring", 0.1), ("u", "ring", 0.1)], "k string, text string, score double"))


def test_empty_patterns_match_nothing(spark):
    one = spark.createDataFrame([("abc",)], "t string")
    assert one.select(match.first_match(F.col("t"), ["", "b"], ["EMPTY", "B"])).first()[0] == "B"
    assert one.select(match.first_match(F.col("t"), [""], default="none")).first()[0] == "none"
    assert one.select(match.canonical_text(F.col("t"), [("", "T", "m"), ("c", "U", "m")])["target"]).first()[0] == "U"


def test_inner_folds_keep_to_the_outer_train_rows(spark):
    df = spark.range(100).select("id", (2000 + F.floor(F.col("id") / 10)).cast("int").alias("year"))
    outer = splits.expanding_folds(df, "id", "year", [(2008, 2009)])
    train = outer.filter("role = 'train'")
    inner = splits.expanding_folds(df.join(train.select("id"), "id", "left_semi"), "id", "year", [(2004, 2005), (2006, 2007)])
    assert splits.violations(inner, df, "id", "year", outer=train).isEmpty()
    leaked = inner.unionByName(outer.filter("role = 'validation'"))
    assert [(r.problem, r.n) for r in splits.violations(leaked, df, "id", outer=train).filter("problem like 'outside%'").collect()] == [("outside the outer train rows", 20)]


def test_vocabulary_and_groups_of_text(spark):
    df = spark.createDataFrame([(f" W{i % 300:03d}",) for i in range(1000)], "t string")
    assert rows(features.vocabulary(df, ["t"])) == [("t", f"w{i:03d}", i + 2) for i in range(300)]
    g = spark.createDataFrame([(f"g{i % 90}", i % 2) for i in range(900)], "g string, y int")
    per = splits.group_folds(g, "g", "y", 3, "s").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in per) == [30, 30, 30]


def test_tfidf_against_plain_python(spark):
    import math
    import re

    docs = [(0, "The red ring and the blue bolt"), (1, "a red RING, red bolt"), (2, None), (3, ""), (4, "blue ring x yz"), (5, "The red ring and the blue bolt")]
    stops = ["the", "and"]
    tokens = {i: [w for w in re.findall(r"\b\w\w+\b", (t or "").lower()) if w not in stops] for i, t in docs}
    terms = {i: w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] for i, w in tokens.items()}
    total, df = {}, {}
    for i in terms:
        for t in terms[i]:
            total[t] = total.get(t, 0) + 1
        for t in set(terms[i]):
            df[t] = df.get(t, 0) + 1
    kept = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:6]
    want = {}
    for i in terms:
        x = {t: (1 + math.log(terms[i].count(t))) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in set(terms[i]) & set(kept)}
        norm = math.sqrt(sum(v * v for v in x.values()))
        want |= {(i, t): 2 * v / norm for t, v in x.items()}
    got = {(r.id, r.term): r.weight for r in text.tfidf(spark.createDataFrame(docs, "id int, text string"), "id", "text", top=6, stop_words=stops, weight=2.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("seed", range(5))
def test_stratified_group_folds_are_as_even_as_a_greedy_deal(spark, seed):
    import random
    import statistics

    r = random.Random(seed)
    groups = {f"g{i}": (r.choice([1, 1, 1, 2, 5, 30]), r.random()) for i in range(150)}
    data = [(g, int(r.random() < share)) for g, (n, share) in groups.items() for _ in range(n)]
    df = spark.createDataFrame(data, "g string, y int").repartition(5)
    got = splits.stratified_group_folds(df, "g", "y", 4, "s").collect()
    assert sorted(x.g for x in got) == sorted(groups)
    counts = {g: [0, 0] for g in groups}
    for g, y in data:
        counts[g][y] += 1
    assert all(x.n == sum(counts[x.g]) and x.positives == counts[x.g][1] for x in got)

    def spread(folds):
        held = [[sum(counts[g][c] for g, f in folds.items() if f == k) for c in (0, 1)] for k in range(4)]
        totals = [sum(h[c] for h in held) for c in (0, 1)]
        return sum(statistics.pstdev([h[c] / totals[c] for h in held]) for c in (0, 1))

    # plain greedy over the groups: those whose classes differ most first, each where the shares then vary least
    totals = [sum(c[k] for c in counts.values()) for k in (0, 1)]
    held, plain = [[0, 0] for _ in range(4)], {}
    for g in sorted(counts, key=lambda g: -statistics.pstdev(counts[g])):
        def after(k, g=g):
            new = [[h[c] + (counts[g][c] if f == k else 0) for c in (0, 1)] for f, h in enumerate(held)]
            return sum(statistics.pstdev([h[c] / totals[c] for h in new]) for c in (0, 1)), sum(held[k])

        plain[g] = min(range(4), key=after)
        for c in (0, 1):
            held[plain[g]][c] += counts[g][c]
    assert spread({x.g: x.fold for x in got}) <= spread(plain) * 1.05 + 0.002


def test_stratified_group_folds_of_odd_tables(spark):
    df = spark.createDataFrame([(None, 1), (None, 0), ("a", None), ("b", 1)], "g string, y int")
    got = {x.g: x.n for x in splits.stratified_group_folds(df, "g", "y", 2, "s").collect()}
    assert got == {None: 2, "a": 1, "b": 1}
    assert splits.stratified_group_folds(df.filter("false"), "g", "y", 2, "s").count() == 0
    assert splits.deal_profiles([(1, 1, 10)], 3) == [[4, 3, 3]] and splits.deal_profiles([(1, 1, 10)], 3, 2) == [[4, 3, 3]] and sum(splits.deal_profiles([(0, 1, 1), (3, 0, 2)], 5)[1]) == 2
