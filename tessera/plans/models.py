"""Queries: model fits, grids, validation, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import models as M
from tessera.operators.batched import Linear
from tessera.operators.splits import Stratified, expanding_folds, rotated, stratified_folds
from tessera.operators.textmodel import text_fitter
from tessera.plans.base import cohort, query, table
from tessera.sources.scratch import written

_X = ["p", "x1", "x2", "x3", "x4"]


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = cohort(spark, sf_dir).filter("label >= 0").select("id", "customer", "region", "year", "drug", "target", "label", "label_b", *_X)
    c = written(c)
    return c.filter("year <= 1999"), c.filter("year > 1999")


def _scored(spark: SparkSession, sf_dir: str, make, **options: object) -> DataFrame:  # noqa: ANN001
    train, test = _parts(spark, sf_dir)
    return M.fitter(make, _X, "label", **options)(train)(test).select("id", "label", "probability")


@query()
def logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, M.logistic, c=0.5, balanced=True)


@query()
def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, M.forest)


@query()
def boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, M.boosted)


@query()
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    apply = M.calibrated(M.assembled(train, _X), "label", "id")
    return apply(M.assembled(test, _X)).select("id", "label", "probability")


@query()
def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    columns = ["p", "x2", "x3", "x4"]
    model = M.ridge(M.assembled(train.filter("x1 IS NOT NULL"), columns), "x1")
    return M.regression_scores(model.transform(M.assembled(test.filter("x1 IS NOT NULL"), columns)), "x1")


@query()
def mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    kinds = {"numeric": (["p", "x2"], []), "entity": ([], ["drug", "target"]), "both": (["p", "x2"], ["drug", "target"])}
    parts = [M.perceptron(train, "label", n, e)(test).select(F.lit(k).alias("inputs"), "id", "label", "probability") for k, (n, e) in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(" SELECT id, (SELECT round(avg(label), 9) FROM c WHERE label >= 0 AND year <= 1999) AS probability FROM c WHERE label >= 0 AND year > 1999")
def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    return M.prevalence(train, test, "label").select("id", F.round("probability", 9).alias("probability"))


@query(", n AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS np FROM c WHERE label >= 0 AND year <= 1999) SELECT id, round(CASE WHEN label = 1 THEN n / (2 * np) ELSE n / (2 * (n - np)) END, 9) AS weight, round(CASE WHEN label = 1 THEN (n - np) / np ELSE 1 END, 9) AS ratio FROM c, n WHERE label >= 0 AND year <= 1999")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _parts(spark, sf_dir)
    both = M.class_weights(M.class_weights(train, "label").withColumnRenamed("weight", "w"), "label", "ratio")
    return both.select("id", F.round("w", 9).alias("weight"), F.round("weight", 9).alias("ratio"))


@query(" SELECT id, 0.5 * p + 0.5 * q AS probability FROM c")
def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir)
    return M.ensemble(c.select("id", F.col("p").alias("probability")), c.select("id", F.col("q").alias("probability")), "id")


@query(
    """, r AS (SELECT drug, target AS candidate, round(avg(p), 2) AS auc, round(avg(q), 2) AS brier FROM c GROUP BY ALL)
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY drug ORDER BY auc DESC, brier, candidate) = 1"""
)
def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cohort(spark, sf_dir).groupBy("drug", F.col("target").alias("candidate")).agg(F.round(F.avg("p"), 2).alias("auc"), F.round(F.avg("q"), 2).alias("brier"))
    return M.best(r, ["drug"], M.by_auc())


_MODELS = {"logistic": (M.logistic, {}), "forest": (M.forest, {})}
_SETS = {"composite": ["p", "x2"], "hybrid": _X}


@query()
def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of every combination; one that failed has no metrics and says why in ``error``."""
    train, test = _parts(spark, sf_dir)
    return M.grid(train, test, ["label"], _SETS, _MODELS, report=True)


@query()
def best_of_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all combinations; an error if any failed, as the best of the others may not be the best."""
    return M.best(M.whole(grid(spark, sf_dir)), ["label"], M.by_auc("roc_auc", "brier", "model"))


@query()
def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _parts(spark, sf_dir)
    return M.out_of_fold(train, "id", "label", M.fitter(M.logistic, _X, "label"), 3).select("id", "label", "probability")


@query()
def two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    first = M.fitter(M.logistic, ["p", "x2"], "label")
    return M.two_stage(train, test, "id", "label", first, lambda cols: M.fitter(M.logistic, cols, "label"), ["region", "x4"]).select("id", "label", "stage1", "probability")


@query()
def segment_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    return M.segment_models(train, test, "drug", "label", Linear(tuple(_X)))


#: Two penalties for each of six: column sets, with and without scaling, and with balanced classes.
_CANDIDATES = {
    f"{name}_c{c}": Linear(tuple(columns), c, **options)
    for name, columns, options in (
        ("wide", _X, {}), ("narrow", ["x2"], {}), ("scores", ["p", "x2"], {}), ("wide_scaled", _X, {"scaled": True}), ("evidence_scaled", ["x1", "x3", "x4"], {"scaled": True}), ("wide_balanced", _X, {"scaled": True, "balanced": True}),
    )
    for c in (0.03, 1.0)
}


@query()
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _parts(spark, sf_dir)
    folds = expanding_folds(train, "id", "year", [(1997, 1997), (1998, 1999)])
    return M.fold_scores(M.cross_validate(train, folds, "id", "label", _CANDIDATES))


@query()
def nested_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _parts(spark, sf_dir)
    outer = expanding_folds(train, "id", "year", [(1997, 1997), (1998, 1998), (1999, 1999)])
    grouped = stratified_folds(train, "id", "label", 3, "outer")
    outer = outer.unionByName(rotated(grouped, "stratified", 3))

    return M.nested_validate(train, written(outer), Stratified("id", "label", 3, "inner"), "id", "label", _CANDIDATES)


@query()
def holdout_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    folds = expanding_folds(train, "id", "year", [(1998, 1999)])
    return M.holdout(train, test, "id", "label", folds, _CANDIDATES, "narrow_c1.0")


@query()
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _parts(spark, sf_dir)
    return M.importance(M.forest(M.assembled(train, _X), "label"), _X, spark, flagged=["x1", "x3"])


@query()
def top_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _parts(spark, sf_dir)
    return M.top_coefficients(M.logistic(M.assembled(train, _X), "label"), _X, spark)


@query()
def linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    columns = ["p", "x2", "x4"]
    return M.linear_attribution(test, M.logistic(M.assembled(train, columns), "label"), columns)


@query()
def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    score = M.fitter(M.logistic, _X, "label")(train)
    return M.counterfactual(test, "id", {"x2": ["x1", "x3"], "x4": []}, score)


@query()
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    masks = {"mapped": F.col("drug") != "unmapped", "has_x1": F.col("x1").isNotNull()}
    return M.sensitivity(train, test, ["label"], {"hybrid": _X}, masks, (M.logistic, {}))


@query()
def evidence_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    rich = F.col("x1").isNotNull() & F.col("x3").isNotNull()
    return M.sensitivity(train, test, ["label"], {"hybrid": _X}, {"full": F.lit(True), "evidence_rich": rich}, (M.logistic, {}))


@query()
def shuffled_folds_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _parts(spark, sf_dir)
    manifest = rotated(stratified_folds(train, "id", "label", 3, "cv"), "stratified", 3)
    return M.fold_scores(M.cross_validate(train, manifest, "id", "label", _CANDIDATES))


#: Text by itself and beside numbers, with the penalties of the text candidates; numbers alone are the reference.
_TEXT = {
    "numeric_reference": Linear(("n_chars", "lines", "digits"), 0.3, scaled=True, label="quality"),
    "text_only_c10": text_fitter("quality", "text", c=10.0),
    "text_numeric_c1": text_fitter("quality", "text", ("n_chars", "lines", "digits"), c=1.0),
}


def _labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    docs = docs.withColumn("lines", F.size(F.split("text", "\n"))).withColumn("digits", F.length(F.regexp_replace("text", "[^0-9]", "")) / F.col("n_chars"))
    return written(docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"))


@query()
def text_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document scored by a model over terms and numbers that did not see it."""
    return M.out_of_fold(_labelled_texts(spark, sf_dir), "doc_id", "quality", _TEXT["text_numeric_c1"], 3).select("doc_id", "quality", "probability")


@query()
def text_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _TEXT["text_numeric_c1"](_labelled_texts(spark, sf_dir))
    return M.top_coefficients(model, model.names, spark)


@query()
def text_nested_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled_texts(spark, sf_dir)
    outer = written(rotated(stratified_folds(rows, "doc_id", "quality", 2, "outer").withColumnRenamed("doc_id", "id"), "stratified", 2))
    return M.nested_validate(rows, outer, Stratified("doc_id", "quality", 2, "inner"), "doc_id", "quality", _TEXT)
