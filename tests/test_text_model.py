"""Terms learned from train rows alone, weights of unseen rows, and the model over them."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models, text, textmodel

STOPS = ("the", "and")


def grams(t):
    w = [x for x in re.findall(r"\b\w\w+\b", (t or "").lower()) if x not in STOPS]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plain_weights(train, rows, top, min_df=2, weight=1.0):
    bags = [grams(t) for t in train]
    df, total = {}, {}
    for bag in bags:
        for t in bag:
            total[t] = total.get(t, 0) + 1
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-total[t], t))[:top]
    idf = {t: math.log((1 + len(train)) / (1 + df[t])) + 1 for t in kept}
    out = []
    for t in rows:
        bag = grams(t)
        x = {g: (1 + math.log(bag.count(g))) * idf[g] for g in set(bag) & idf.keys()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        out.append({g: v / norm * weight for g, v in x.items()})
    return kept, out


def sentences(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["the", "and", "Ä1", "x"]
    return [" ".join(r.choice(words) for _ in range(r.randrange(0, 25))) for _ in range(n)]


def test_weights_of_unseen_rows_against_plain_python(spark):
    train, later = [*sentences(60, 1), None, ""], [*sentences(30, 2), None, "", "unseen words only", "w1 " * 500]
    kept, want = plain_weights(train, later, 80, weight=3.0)
    # columns that clash with names of the operator's own
    fitted = text.fit_terms(spark.createDataFrame([(t,) for t in train], "t string"), "t", top=80, stop_words=STOPS)
    assert list(fitted.terms) == kept
    rows = spark.createDataFrame([(i, t, "a") for i, t in enumerate(later)], "_row int, t string, _terms string")
    out = text.term_weights(rows, fitted, "t", "weights", 3.0)
    assert out.columns == ["_row", "t", "_terms", "weights"]
    for r in out.collect():
        assert [x["index"] for x in r.weights] == sorted(x["index"] for x in r.weights)
        assert all(kept[x["index"]] == x.term for x in r.weights)
        assert {x.term: x.weight for x in r.weights} == pytest.approx(want[r["_row"]], abs=1e-12)


def test_weighing_exchanges_nothing(spark):
    fitted = text.Terms(("a1", "b1"), (1.0, 2.0), ())
    plan = text.term_weights(spark.range(5).select(F.lit("a1 b1 c1").alias("t")), fitted, "t")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_counts_leave_tasks_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(t,) for t in sentences(80, 4)], "t string")
    whole = text.fit_terms(rows, "t", top=70, stop_words=STOPS)
    monkeypatch.setattr(text, "HELD", 20)
    assert text.fit_terms(rows, "t", top=70, stop_words=STOPS) == whole


def test_no_terms_at_all(spark):
    rows = spark.createDataFrame([(None, 1), ("", 0)], "t string, label int")
    fitted = text.fit_terms(rows, "t")
    assert fitted.terms == () and [r.weights for r in text.term_weights(rows, fitted, "t").collect()] == [[], []]
    assert text.fit_terms(rows.filter("false"), "t").terms == ()
    with pytest.raises(ValueError, match="no term"):
        textmodel.fit_text(rows, "label", "t")


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(9)
    rows = []
    for i, t in enumerate(sentences(300, 3)):
        y = int(("w1 " in t) + r.gauss(0, 0.3) > 0.4)
        rows.append((i, t if i % 37 else None, r.gauss(y, 1) if i % 11 else None, 5.0, y))
    return spark.createDataFrame(rows, "id long, t string, a double, b double, label int").repartition(3).cache()


@pytest.mark.parametrize("numeric", [(), ("a", "b")])
def test_text_model_meets_its_optimum(labelled, numeric):
    model = textmodel.fit_text(labelled, "label", "t", numeric, c=2.0, top=50, stop_words=STOPS)
    rows = sorted(labelled.collect(), key=lambda r: r.id)
    kept, weights = plain_weights([r.t for r in rows], [r.t for r in rows], 50, weight=3.0 if numeric else 1.0)
    x = np.array([[w.get(t, 0.0) for t in kept] for w in weights])
    if numeric:
        a = np.array([np.nan if r.a is None else r.a for r in rows])
        block = np.column_stack([np.where(np.isnan(a), np.nanmedian(a), a), np.full(len(a), 5.0), np.isnan(a)])
        deviation = block.std(0)
        x = np.hstack([x, (block - block.mean(0)) / np.where(deviation > 0, deviation, 1.0)])
        assert model.names == [*kept, "a", "b", "a_indicator"]
    y = np.array([r.label for r in rows])
    p = 1 / (1 + np.exp(-(x @ np.array(model.coefficients) + model.intercept)))
    assert x.T @ (p - y) + np.array(model.coefficients) / 2.0 == pytest.approx(np.zeros(x.shape[1]), abs=2e-3)
    assert [r.probability for r in model(labelled).orderBy("id").collect()] == pytest.approx(p, abs=1e-9)


def test_vocabulary_is_learned_from_train_rows_alone(spark):
    rows = [(i, "lung cancer egfr" if i % 2 else "breast cancer her2", i / 20, i % 2) for i in range(20)]
    train = spark.createDataFrame(rows, "id int, t string, a double, label int")
    model = textmodel.text_fitter("label", "t", ["a"])(train)
    before = model.terms
    later = spark.createDataFrame([(99, "unseenvalidationword", None)], "id int, t string, a double")
    (r,) = model(later).collect()
    assert 0 < r.probability < 1 and model.terms == before and "unseenvalidationword" not in model.terms.terms
    out = models.out_of_fold(train.withColumn("t", F.when(F.col("id") == 3, "unseenvalidationword").otherwise(F.col("t"))), "id", "label", textmodel.text_fitter("label", "t", ["a"]), 3)
    assert out.count() == 20 and out.filter("probability IS NULL OR isnan(probability)").isEmpty()


def test_top_coefficients_are_terms(spark, labelled):
    model = textmodel.fit_text(labelled, "label", "t", ["a"], top=50, stop_words=STOPS)
    top = models.top_coefficients(model, model.names, spark, 15).collect()
    assert len(top) == 30 and {r.feature for r in top} <= set(model.names) and any(r.feature.startswith("w1") for r in top if r.sign == "positive")


def test_rare_bigrams_do_not_leave_tasks(spark, monkeypatch):
    """Only bigrams whose bucket reaches the last word that is kept are counted one by one; the vocabulary is that of counting all."""
    r = random.Random(21)
    train = [" ".join(f"w{int(r.paretovariate(0.6)) % 3000:04d}" for _ in range(r.randrange(0, 80))) for _ in range(300)]
    sent = []
    mapped = text.map_arrow
    monkeypatch.setattr(text, "map_arrow", lambda *args: sent.append(mapped(*args)) or sent[-1])
    fitted = text.fit_terms(spark.createDataFrame([(t,) for t in train], "t string"), "t", top=40, stop_words=STOPS)
    assert list(fitted.terms) == plain_weights(train, [], 40)[0] and any(" " in t for t in fitted.terms)
    bigrams = sum(len({g for g in grams(t) if " " in g}) for t in train)
    assert sum(x.filter("term LIKE '% %'").count() for x in sent) < bigrams / 10


def test_candidates_of_a_fold_share_a_vocabulary(spark, labelled, monkeypatch):
    learned = []
    fit = textmodel.fit_terms
    monkeypatch.setattr(textmodel, "fit_terms", lambda *args: learned.append(fit(*args)) or learned[-1])
    folds = labelled.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("fold"), "id").select(F.lit("m").alias("mode"), "fold", F.when(F.col("id") % 2 == F.col("fold"), "validation").otherwise("train").alias("role"), "id")
    candidates = {"text": textmodel.text_fitter("label", "t", top=30, iterations=5), "both": textmodel.text_fitter("label", "t", ["a"], top=30, iterations=5)}
    got = models.cross_validate(labelled, folds, "id", "label", candidates)
    assert len(learned) == 2 and {(r.fold, r.candidate): r["count"] for r in got.groupBy("fold", "candidate").count().collect()} == {(f, c): 150 for f in (0, 1) for c in candidates}
    alone = candidates["both"](labelled.filter("id % 2 = 1"))(labelled.filter("id % 2 = 0"))
    both = got.filter("fold = 0 AND candidate = 'both'").join(alone.select("id", F.col("probability").alias("p")), "id")
    assert both.count() == 150 and both.filter("abs(probability - p) > 1e-9").isEmpty()
