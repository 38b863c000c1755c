"""Batched Newton fits against closed forms, single fits and each other; bootstrap matrices against the plain way; exact medians."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import batched, bootstrap, models, prefix
from tessera.operators.batched import Linear, fit_all, nested_rows, ranked, rows_of, validate_all
from tessera.operators.splits import Stratified, expanding_folds, rotated, stratified_folds
from tessera.sources.scratch import written


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        x, z = r.gauss(0, 1), r.gauss(3, 20)
        rows.append((i, x if i % 9 else None, z if i % 5 else float("nan"), 7.0, int((x or 0) + z / 20 + r.gauss(0, 1) > 0.3), "abcd"[i % 4], 2000 + i // 80))
    return spark.createDataFrame(rows, "id long, x double, z double, w double, y int, s string, year int").repartition(5).cache()


def design(rows, scaled, train):
    raw = np.array([[np.nan if v is None else v for v in (r.x, r.z, r.w)] for r in rows])
    missing = np.isnan(raw)
    if not scaled:
        return np.column_stack([np.where(missing, -1.0, raw), np.ones(len(raw))])
    full = np.hstack([np.where(missing, np.nanmedian(raw[train], axis=0), raw), missing[:, missing[train].any(0)]])
    deviation = full[train].std(0)
    return np.column_stack([(full - full[train].mean(0)) / np.where(deviation > 1e-9, deviation, 1.0), np.ones(len(raw))])


@pytest.mark.parametrize("spec", [{}, {"c": 0.03}, {"scaled": True}, {"balanced": True, "scaled": True, "c": 5.0}, {"ridge": True, "scaled": True, "c": 0.2}, {"ridge": True}])
def test_each_fit_meets_its_optimum(data, spec):
    manifest = expanding_folds(data, "id", "year", [(2002, 2002), (2003, 2004)])
    got = {(r.fold, r.id): r.probability for r in validate_all(data, manifest, "id", "y", {"m": Linear(("x", "z", "w"), label="y", **spec)}).collect()}
    rows = sorted(data.collect(), key=lambda r: r.id)
    y = np.array([r.y for r in rows])
    for fold, (first, last) in enumerate([(2002, 2002), (2003, 2004)]):
        train = np.array([r.year < first for r in rows])
        a = design(rows, spec.get("scaled", False), train)
        weight = np.ones(len(y))
        if spec.get("balanced"):
            n, pos = train.sum(), y[train].sum()
            weight = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
        penalty = np.diag([1 / spec.get("c", 1.0)] * (a.shape[1] - 1) + [0.0])
        b = np.zeros(a.shape[1])
        for _ in range(60):
            m = a[train] @ b
            p = m if spec.get("ridge") else 1 / (1 + np.exp(-m))
            bend = weight[train] * (1.0 if spec.get("ridge") else p * (1 - p))
            b -= np.linalg.lstsq(a[train].T @ (bend[:, None] * a[train]) + penalty, a[train].T @ (weight[train] * (p - y[train])) + penalty @ b, rcond=None)[0]
        want = a @ b if spec.get("ridge") else 1 / (1 + np.exp(-(a @ b)))
        held = [i for i, r in enumerate(rows) if first <= r.year <= last]
        assert {i for f, i in got if f == fold} == set(held)
        assert [got[fold, i] for i in held] == pytest.approx(want[held], abs=1e-6)


def test_batched_folds_equal_single_fits(data):
    manifest = expanding_folds(data, "id", "year", [(2002, 2002), (2004, 2004)])
    both = {"batched": Linear(("x", "z"), 0.5, balanced=True, label="y"), "single": models.fitter(models.logistic, ["x", "z"], "y", c=0.5, balanced=True)}
    out = models.cross_validate(data, manifest, "id", "y", both).groupBy("mode", "fold", "id").pivot("candidate", ["batched", "single"]).agg(F.first("probability")).collect()
    assert len(out) == 160 and max(abs(r.batched - r.single) for r in out) < 1e-4
    one = Linear(("x", "z"), 0.5, balanced=True, label="y")
    train, test = data.filter("year < 2004"), data.filter("year = 2004")
    alone = {r.id: r.probability for r in one(train)(test).collect()}
    assert {r.id: r.batched for r in out if r.fold == 1} == pytest.approx(alone, abs=1e-9)


def test_number_of_jobs_does_not_depend_on_the_number_of_fits(spark, data):
    folds = stratified_folds(data, "id", "y", 5, "s").select("id", "fold").cache()

    def jobs(k, candidates, group):
        each = folds.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"), "id", "fold")
        manifest = each.select(F.lit("m").alias("mode"), F.col("k").alias("fold"), F.when(F.col("k") == F.col("fold"), "validation").otherwise("train").alias("role"), "id")
        spark.sparkContext.setJobGroup(group, group)
        validate_all(data, manifest, "id", "y", candidates).collect()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    one = {"a": Linear(("x", "z"), 0.3, scaled=True, label="y")}
    many = {f"c{c}": Linear(("x", "z"), c, scaled=True, label="y") for c in (0.1, 0.3, 0.2, 0.25, 0.15)}
    # 25 fits against 2: a few steps more of the slowest fit at most
    assert jobs(5, many, "many") < 2 * jobs(2, one, "one")


def test_nested_choice_uses_inner_folds_of_each_outer_fold(data):
    rows = data.withColumn("good", F.col("y") + F.coalesce("x", F.lit(0.0)))
    outer = expanding_folds(rows, "id", "year", [(2003, 2003), (2004, 2004)])
    candidates = {"bad": Linear(("w",), label="y"), "good": Linear(("good",), label="y")}
    got = models.nested_validate(rows, outer, lambda t: expanding_folds(t, "id", "year", [(2001, 2002)]), "id", "y", candidates)
    assert {(r.fold, r.candidate): r["count"] for r in got.groupBy("fold", "candidate").count().collect()} == {(0, "good"): 80, (1, "good"): 80}


CANDIDATES = {
    "wide": Linear(("x", "z"), 0.5, scaled=True, label="y"), "same": Linear(("x", "z"), 0.5, scaled=True, label="y"), "narrow": Linear(("x",), 0.1, label="y"),
    "balanced": Linear(("x", "z", "w"), 2.0, balanced=True, label="y"), "constant": Linear(("w",), label="y"), "line": Linear(("x", "z"), ridge=True, scaled=True, label="y"),
}


@pytest.mark.parametrize("sizes", [{}, {"SAMPLE": 60, "RANGE": 30, "HELD": 50}])
def test_stratified_inner_folds_equal_a_manifest_of_them(spark, data, monkeypatch, sizes):
    """Inner parts, ranked scores and choices as by the plain way, however small the sample, the ranges and the batches are."""
    outer = written(expanding_folds(data, "id", "year", [(2003, 2003), (2004, 2004)]).unionByName(rotated(stratified_folds(data, "id", "y", 3, "o"), "s", 3)))
    inner, kept, tables = Stratified("id", "y", 3, "i"), [], []
    plain = models.nested_validate(data, outer, lambda t: inner(t), "id", "y", CANDIDATES, lambda x: kept.append(x.collect()) or x)
    want = {(r["mode"], r.fold, r.id): (r.candidate, r.label, r.probability) for r in plain.collect()}
    for name, value in sizes.items():
        monkeypatch.setattr(batched, name, value)
    monkeypatch.setattr(batched, "written", lambda df: tables.append(written(df)) or tables[-1])
    found = models.nested_validate(data, outer, inner, "id", "y", CANDIDATES, lambda x: kept.append(x.collect()) or x)
    got = {(r["mode"], r.fold, r.id): (r.candidate, r.label, r.probability) for r in found.collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} and len(got) == 80 + 80 + 400
    assert [got[k][2] for k in want] == pytest.approx([v[2] for v in want.values()], abs=1e-7)
    assert sorted(kept[0]) == sorted(kept[1]) and len(kept[0]) == 5
    # rows are written twice whatever the number of folds and candidates, and nothing else is
    assert [t.count() for t in tables] == [400, 400]


def test_folds_beyond_one_word_of_membership(data):
    outer = written(rotated(stratified_folds(data, "id", "y", 20, "o"), "s", 20))
    rows, m = nested_rows(data, outer, 4, "i", "y", ("x",))
    table = rows.table.toArrow()
    ids = table.column("id").to_numpy()
    train, valid = (batched._members(table.column(c).combine_chunks(), len(rows.folds)) for c in ("train", "valid"))
    assert (m, len(rows.folds), train.shape, valid.sum()) == (20, 100, (400, 100), 400 + 19 * 400)
    for k in (0, 7, 19):
        here = outer.filter(F.col("fold") == k)
        inner = Stratified("id", "y", 4, "i")(data.join(here.filter("role = 'train'").select("id"), "id", "left_semi")).collect()
        for j in range(4):
            for role, members in (("train", train), ("validation", valid)):
                assert set(ids[members[:, 20 + 4 * k + j]]) == {r.id for r in inner if (r.fold, r.role) == (j, role)}
        assert {"train": set(ids[train[:, k]]), "validation": set(ids[valid[:, k]])} == {role: {r.id for r in here.collect() if r.role == role} for role in ("train", "validation")}


def test_ranked_scores_equal_the_metrics_of_all_predictions(spark, data, monkeypatch):
    outer = written(expanding_folds(data, "id", "year", [(2003, 2004)]))
    manifest = written(Stratified("id", "y", 4, "i")(data.filter("year < 2003")))
    want = {(r.fold, r.candidate): (r.auc, r.brier) for r in models.fold_scores(models.cross_validate(data, manifest, "id", "y", CANDIDATES)).collect()}
    monkeypatch.setattr(batched, "RANGE", 7)
    rows, m = nested_rows(data, outer, 4, "i", "y", ("x", "z", "w"))
    pairs = [(k, name) for k in range(m, len(rows.folds)) for name in CANDIDATES]
    got = ranked(rows, fit_all(rows, [(k, CANDIDATES[name]) for k, name in pairs])).select("i", F.round("auc", 6).alias("auc"), F.round("brier", 6).alias("brier")).collect()
    found = {(rows.folds[pairs[r.i][0]][1], pairs[r.i][1]): (r.auc, r.brier) for r in got}
    assert found.keys() == want.keys() and len(want) == 24
    assert [x for k in want for x in found[k]] == pytest.approx([x for k in want for x in want[k]], abs=2e-6)


def test_equal_rows_score_equally_and_equal_means_tie(spark, data):
    fits = fit_all(rows_of(data, None, "y", ("x", "z", "w")), [(0, Linear(("x", "z"), label="y")), (0, Linear(("x", "z"), 0.1, scaled=True, label="y"))])
    x = np.random.default_rng(1).normal(size=(1, 3)).repeat(1003, 0)
    assert all(len(np.unique(fits.scores(i, x[:n]))) == 1 for i in (0, 1) for n in (1, 7, 1003))
    assert len({fits.scores(1, x[:n])[0] for n in (1, 7, 1003)}) == 1
    scores = [("m", k, c, a, b) for c, b, each in (("first", 0.3, (0.1, 0.2, 0.3)), ("second", 0.2, (0.3, 0.2, 0.1))) for k, a in enumerate(each)]
    assert models.choose(spark.createDataFrame(scores, "mode string, fold int, candidate string, auc double, brier double").coalesce(1)).first().candidate == "second"


def test_labels_that_are_missing_are_an_error(data):
    with pytest.raises(ValueError, match="not finite"):
        fit_all(rows_of(data.withColumn("y", F.when(F.col("id") != 5, F.col("y"))), None, "y", ("x",)), [(0, Linear(("x",), label="y"))])


def test_segments_at_once_equal_one_by_one(data):
    train, test = data.filter("year < 2003"), data.filter("year >= 2003")
    a, b = (models.segment_models(train, test, "s", "y", fit, 10, 5).orderBy("s").collect() for fit in (Linear(("x", "z"), label="y"), models.fitter(models.logistic, ["x", "z"], "y")))
    assert [r.s for r in a] == [r.s for r in b] == list("abcd")
    assert [r.roc_auc for r in a] == pytest.approx([r.roc_auc for r in b], abs=0.01)


def test_fits_need_both_classes(data):
    with pytest.raises(ValueError, match="lack a class"):
        fit_all(rows_of(data.filter("y = 1"), None, "y", ("x",)), [(0, Linear(("x",), label="y"))])


# --- bootstrap ----------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["multinomial", "poisson"])
def test_win_matrices_equal_weighted_histograms(spark, monkeypatch, kind):
    r = random.Random(1)
    rows = [(r.choice("abcdefgh"), r.randrange(2) if c else 1, r.randrange(30) / 10, r.choice([None, 0.5, 1.0]), r.randrange(3)) for c in [1] * 700 + [0] * 20]
    df = spark.createDataFrame(rows, "g string, y int, p double, q double, fold int").repartition(4)

    def values():
        per = bootstrap._replicate_aucs(df, "y", ["p", "q"], "g", 40, "s", kind, ["fold"]).collect()
        return {(x.replicate, x.fold, x.which): x.auc for x in per}

    matrices = values()
    monkeypatch.setattr(bootstrap, "MATRIX", 3)
    histograms = values()
    assert matrices.keys() == histograms.keys() and len(matrices) == 240
    assert matrices == pytest.approx(histograms, abs=1e-12)


def test_wins_across_batches_and_ranges(spark):
    r = random.Random(2)
    rows = [(r.randrange(3), r.randrange(5), round(r.gauss(0, 1), 1), r.randrange(4), r.randrange(4)) for _ in range(3000)]
    small = spark.createDataFrame(rows, "_g int, _c int, score double, pos long, neg long").groupBy("_g", "_c", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        w, pos, neg = bootstrap._win_matrices(small, 3, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = np.zeros((3, 5, 5))
    held = small.collect()
    for a in held:
        for b in held:
            if a["_g"] == b["_g"]:
                want[a["_g"], a["_c"], b["_c"]] += a.pos * b.neg * (1.0 if a.score > b.score else 0.5 if a.score == b.score else 0.0)
    assert w == pytest.approx(want)
    assert pos.sum() == sum(r[3] for r in rows) and neg.sum() == sum(r[4] for r in rows)


# --- medians ------------------------------------------------------------------------------


def test_medians_are_exact(spark, monkeypatch):
    r = random.Random(3)
    kinds = {"ties": lambda: float(r.randrange(-2, 3)), "wide": lambda: r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300), "even": lambda: r.gauss(0, 1), "one": lambda: 4.0}
    rows = [(k, None if i % 50 == 0 else float("nan") if i % 51 == 0 else f()) for k, f in kinds.items() for i in range(4001 if k == "wide" else 4000)] + [("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    want = {k: statistics.median(v for g, v in rows if g == k and v is not None and v == v) for k in [*kinds, "two"]}
    assert {x.k: x.median for x in prefix.medians(df, ["k"], "v").collect()} == want
    monkeypatch.setattr(prefix, "SKETCH", 100)  # wide bounds, so that most values are between them
    assert {x.k: x.median for x in prefix.medians(df, ["k"], "v").collect()} == want
    wide = spark.createDataFrame([(float(i % 7) if i % 3 else None, float(-i), None) for i in range(1000)], "a double, b double, c double")
    middle, missing = prefix.column_medians(wide, ["a", "b", "c"])
    assert middle == {"a": statistics.median(float(i % 7) for i in range(1000) if i % 3), "b": -499.5, "c": None} and missing == {"a": 334, "b": 0, "c": 1000}
    assert prefix.column_medians(wide.filter("false"), ["a"]) == ({"a": None}, {"a": 0})
