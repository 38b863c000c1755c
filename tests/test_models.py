"""Fits against closed forms and plain Python, and runners with candidates whose scores are known."""

import logging
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, models


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(21)
    rows = []
    for i in range(240):
        x, z = r.gauss(0, 1), r.gauss(0, 1)
        rows.append((i, x, z, float(2 * x - z + r.gauss(0, 0.3) + 1), int(x + 0.5 * z + r.gauss(0, 0.8) > 0), "abc"[i % 3], 2000 + i // 60))
    return spark.createDataFrame(rows, "id long, x double, z double, t double, y int, s string, year int").repartition(3).cache()


def arrays(df, *columns):
    return (np.array([r[c] for r in df.orderBy("id").collect()]) for c in columns)


def test_ridge_meets_its_closed_form(data):
    model = models.ridge(models.assembled(data, ["x", "z"]), "t", alpha=7.0)
    x, z, t = arrays(data, "x", "z", "t")
    a = np.column_stack((x, z))
    a0, t0 = a - a.mean(0), t - t.mean()
    w = np.linalg.solve(a0.T @ a0 + 7.0 * np.eye(2), a0.T @ t0)
    assert model.coefficients.toArray() == pytest.approx(w, abs=1e-6)
    assert model.intercept == pytest.approx(t.mean() - a.mean(0) @ w, abs=1e-6)
    err = t - (a @ w + model.intercept)
    got = models.regression_scores(model.transform(models.assembled(data, ["x", "z"])), "t").first()
    assert (got.n, got.mse, got.r2) == (240, pytest.approx((err**2).mean(), abs=1e-6), pytest.approx(1 - (err**2).sum() / (t0**2).sum(), abs=1e-6))


@pytest.mark.parametrize("balanced", [False, True])
def test_weighted_logistic_meets_its_optimum(data, balanced):
    model = models.logistic(models.assembled(data, ["x", "z"]), "y", c=0.5, balanced=balanced)
    x, z, y = arrays(data, "x", "z", "y")
    a = np.column_stack((x, z))
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    slope = weight * (1 / (1 + np.exp(-(a @ model.coefficients.toArray() + model.intercept))) - y)
    assert a.T @ slope + model.coefficients.toArray() / 0.5 == pytest.approx(np.zeros(2), abs=1e-3)
    assert slope.sum() == pytest.approx(0, abs=1e-3)


def test_linear_attribution_and_coefficients(spark, data):
    model = models.logistic(models.assembled(data, ["x", "z"]), "y")
    got = {r.feature: r.mean_abs for r in models.linear_attribution(data, model, ["x", "z"]).collect()}
    for k, c in enumerate(("x", "z")):
        (v,) = arrays(data, c)
        assert got[c] == pytest.approx(abs(model.coefficients[k]) * np.abs(v - v.mean()).mean())

    class Fitted:
        coefficients = [0.5, -2.0, 0.5, -3.0, 1.0]

    found = models.top_coefficients(Fitted, list("abcde"), spark, 2).collect()
    assert [(r.sign, r.rank, r.feature, r.coefficient) for r in found] == [("negative", 1, "d", -3.0), ("negative", 2, "b", -2.0), ("positive", 1, "e", 1.0), ("positive", 2, "c", 0.5)]
    shares = models.importance(model, ["x", "z"], spark, flagged=["z"])
    assert shares.agg(F.sum("share")).first()[0] == pytest.approx(1) and shares.filter("flagged").first().feature == "z"


def isotonic(p, y):
    """Pool adjacent violators over the distinct scores; between them the line."""
    xs = sorted(set(p))
    blocks = [[sum(y[p == x]), sum(p == x), [x]] for x in xs]
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][0] / out[-2][1] > out[-1][0] / out[-1][1]:
            s, n, at = out.pop()
            out[-1] = [out[-1][0] + s, out[-1][1] + n, out[-1][2] + at]
    value = {x: s / n for s, n, at in out for x in at}
    return lambda q: np.interp(q, xs, [value[x] for x in xs])


def test_calibration_pools_adjacent_violators(data):
    rows = models.assembled(data, ["x", "z"])
    folds = models.stratified_folds(rows, "id", "y", 3, "cal")
    got = np.array([r.probability for r in models.calibrated(rows, "y", "id")(rows).orderBy("id").collect()])
    parts = []
    for k in range(3):
        base = models.logistic(rows.join(folds.filter(F.col("fold") != k).select("id"), "id"), "y")
        held = models.scored(base, rows.join(folds.filter(F.col("fold") == k).select("id"), "id"))
        p, y = arrays(held, "probability", "y")
        (every,) = arrays(models.scored(base, rows), "probability")
        parts.append(isotonic(p, y)(every))
    assert got == pytest.approx(np.mean(parts, axis=0), abs=1e-6)


def knows(train):
    """A scorer that gives 1 to rows it was fitted on and 0 to others."""
    ids = train.select("id", F.lit(1.0).alias("_seen"))
    return lambda df: df.join(ids, "id", "left").withColumn("probability", F.coalesce("_seen", F.lit(0.0))).drop("_seen")


def test_out_of_fold_rows_are_scored_by_models_that_did_not_see_them(data):
    got = models.out_of_fold(data, "id", "y", knows, 4)
    assert got.count() == got.select("id").distinct().count() == 240 and got.agg(F.max("probability")).first()[0] == 0
    train, test = data.filter("year < 2003"), data.filter("year = 2003")
    second = models.two_stage(train, test, "id", "y", knows, lambda cols: lambda a: lambda b: b.withColumn("probability", F.lit(a.agg(F.max("stage1")).first()[0])), ["x"])
    assert {(r.stage1, r.probability) for r in second.collect()} == {(0.0, 0.0)} and second.count() == 60


def constant(column):
    return lambda train: lambda df: df.withColumn("probability", F.col(column))


@pytest.fixture(scope="module")
def scored_rows(spark, data):
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    return data.withColumn("good", F.col("y") * 0.5 + noise * 0.4).withColumn("bad", noise).cache()


def test_runners_choose_on_validation_rows(scored_rows):
    from tessera.operators.splits import expanding_folds

    # before 2003 "bad" orders perfectly, in 2003 "good" does
    df = scored_rows.withColumn("a", F.when(F.col("year") < 2003, F.col("bad")).otherwise(F.col("good"))).withColumn("b", F.when(F.col("year") < 2003, F.col("good")).otherwise(F.col("bad")))
    train, test = df.filter("year < 2003"), df.filter("year = 2003")
    manifest = expanding_folds(train, "id", "year", [(2001, 2001), (2002, 2002)])
    candidates = {"a": constant("a"), "b": constant("b")}
    kept = []
    got = {r.role: r for r in models.holdout(train, test, "id", "y", manifest, candidates, "a", lambda x: kept.append(x) or x).collect()}
    assert got["selected"].candidate == "b" and got["reference"].candidate == "a" and len(kept) == 1
    assert got["reference"].roc_auc == 1 and got["selected"].roc_auc < 1 and got["baseline"].roc_auc == 0.5
    scores = models.fold_scores(models.cross_validate(train, manifest, "id", "y", candidates)).collect()
    assert {(r.fold, r.candidate): r.auc for r in scores if r.candidate == "b"} == {(0, "b"): 1.0, (1, "b"): 1.0}
    outer = expanding_folds(df, "id", "year", [(2003, 2003)])
    nested = models.nested_validate(df, outer, lambda t: expanding_folds(t, "id", "year", [(2001, 2002)]), "id", "y", candidates)
    assert {r.candidate for r in nested.collect()} == {"b"} and nested.count() == 60


def test_grid_goes_on_after_a_failed_fit(data, caplog):
    def broken(df, label):
        raise RuntimeError("no convergence")

    train, test = data.filter("year < 2003"), data.filter("year = 2003")
    with caplog.at_level(logging.WARNING):
        got = models.grid(train, test, ["y"], {"one": ["x"], "two": ["x", "z"]}, {"broken": (broken, {}), "logistic": (models.logistic, {})})
    assert sorted((r.features, r.model) for r in got.collect()) == [("one", "logistic"), ("two", "logistic")]
    assert sum("broken" in m and "no convergence" in m for m in caplog.messages) == 2
    with pytest.raises(ValueError):
        models.grid(train, test, ["y"], {"one": ["x"]}, {"broken": (broken, {})})


def test_a_failed_combination_is_no_result(data, monkeypatch):
    from tessera.plans import models as plans

    def broken(df, label):
        raise RuntimeError("no convergence")

    def nan_scores(df, label):
        return "nan"

    scored = models.scored
    monkeypatch.setattr(models, "scored", lambda model, df: df.withColumn("probability", F.when(F.col("id") != 200, 0.5).otherwise(None)) if model == "nan" else scored(model, df))
    monkeypatch.setattr(plans, "_parts", lambda spark, folder: tuple(data.withColumn("label", F.col("y")).filter(where) for where in ("year < 2003", "year = 2003")))
    monkeypatch.setattr(plans, "_SETS", {"one": ["x"], "two": ["x", "z"]})
    monkeypatch.setattr(plans, "_MODELS", {"broken": (broken, {}), "logistic": (models.logistic, {}), "nan": (nan_scores, {})})
    got = {(r.features, r.model): r for r in plans.grid(data.sparkSession, "").collect()}
    assert len(got) == 6 and all((r.roc_auc is None) == (r.error is not None) == (m != "logistic") for (_, m), r in got.items())
    assert "no convergence" in got["one", "broken"].error and "not all scores" in got["two", "nan"].error
    with pytest.raises(ValueError, match="label, one, broken: .*no convergence"):
        plans.best_of_grid(data.sparkSession, "")
    monkeypatch.setattr(plans, "_MODELS", {"logistic": (models.logistic, {})})
    best = plans.best_of_grid(data.sparkSession, "").collect()
    assert [(r.label, r.model) for r in best] == [("label", "logistic")] and best[0].roc_auc == max(r.roc_auc for r in got.values() if r.roc_auc)
    few = models.grid(data.filter("year < 2003").withColumn("one", F.lit(1)), data.filter("year = 2003").withColumn("one", F.lit(1)), ["one", "y"], {"one": ["x"]}, {"logistic": (models.logistic, {})}, report=True)
    assert {r.label: r.error for r in few.collect()} == {"y": None, "one": "rows or classes are too few"}


def test_segments_and_subsets_need_rows_and_classes(data):
    rare = data.withColumn("s", F.when(F.col("id") % 60 == 0, "rare").otherwise(F.col("s")))
    train, test = rare.filter("year < 2003"), rare.filter("year = 2003")
    fit = models.fitter(models.logistic, ["x", "z"], "y")
    assert sorted(r.s for r in models.segment_models(train, test, "s", "y", fit).collect()) == ["a", "b", "c"]
    got = models.sensitivity(train, test, ["y"], {"both": ["x", "z"]}, {"all": F.lit(True), "rare": F.col("s") == "rare", "a": F.col("s") == "a"}, (models.logistic, {})).collect()
    assert sorted(r.subset for r in got) == ["a", "all"] and next(r.n for r in got if r.subset == "all") == 60


def test_trees_and_networks_learn_on_held_out_rows(data):
    train, test = data.filter("year < 2003"), data.filter("year = 2003")
    for make, options in ((models.forest, {"trees": 20}), (models.boosted, {"rounds": 10})):
        out = models.fitter(make, ["x", "z"], "y", **options)(train)(test)
        assert metrics.roc_auc(out, "y", "probability").first()[0] > 0.75
    net = models.perceptron(train, "y", ["x", "z"], ["s"], iterations=40)
    unseen = test.withColumn("s", F.lit("new"))
    assert metrics.roc_auc(net(unseen), "y", "probability").first()[0] > 0.75


def test_counterfactual_against_plain_python(spark):
    rows = [(i, x, c, l) for i, (x, c, l) in enumerate([(0.2, -1.0, 0.5), (0.95, 0.4, 0.95), (None, 0.0, 0.1), (0.5, 1.0, None), (0.3, None, 0.2)])]
    df = spark.createDataFrame(rows, "id long, x double, c double, l double")

    def p(x, c, lever):
        return 0.1 * (x or 0) + 0.2 * (c or 0) ** 2 - 0.05 * (lever or 0)

    score = lambda d: d.withColumn("probability", 0.1 * F.coalesce("x", F.lit(0.0)) + 0.2 * F.coalesce("c", F.lit(0.0)) * F.coalesce("c", F.lit(0.0)) - 0.05 * F.coalesce("l", F.lit(0.0)))
    got = {r.lever: r for r in models.counterfactual(df, "id", {"l": ["c"], "x": []}, score).collect()}
    up = lambda v: None if v is None else min(v + 0.1, 1)
    d = {
        "l": [p(x, min((0.0 if c in (None, -1.0) else c) + 0.1, 1), up(lever)) - p(x, c, lever) for _, x, c, lever in rows],
        "x": [p(up(x), c, lever) - p(x, c, lever) for _, x, c, lever in rows],
    }
    for lever, v in d.items():
        r = got[lever]
        want = (np.mean(v), np.median(v), np.std(v), np.max(v), 100 * np.mean(np.array(v) > 0))
        assert (r.mean_delta_p, r.median_delta_p, r.std_delta_p, r.max_delta_p, r.pct_positive) == pytest.approx(want)
