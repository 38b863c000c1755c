"""Model fits with Spark ML, their grids, validation and explanations.

Linear candidates are fitted all at once (``batched``), others a few folds at a time over tables written once; every fit is distributed.
Joins by row id have a merge hint: a manifest's files are so small that Spark would send them to all executors, by way of the driver.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import capped
from tessera.operators.batched import Linear, nested_all, validate_all
from tessera.operators.features import impute, scale
from tessera.operators.metrics import metric_bundle
from tessera.operators.prefix import medians
from tessera.operators.splits import Stratified, stratified_folds
from tessera.sources.scratch import written

log = logging.getLogger(__name__)
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]
#: Folds that are fitted at a time. A fit's passes are short jobs, so that one fit alone leaves cores idle between them.
AT_ONCE = 3


def at_once[T](spark: SparkSession, jobs: Sequence[Callable[[], T]]) -> list[T]:
    """What ``jobs`` return, in their order; the first error of one is raised."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def class_weights(df: DataFrame, label: str, kind: str = "balanced") -> DataFrame:
    """``df`` with ``weight``: n / (2 n_class), or negatives over positives for the positive class (``ratio``)."""
    n, pos = df.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    if kind == "ratio":
        return df.withColumn("weight", F.when(F.col(label) == 1, (n - pos) / max(1, pos)).otherwise(1.0))
    return df.withColumn("weight", F.when(F.col(label) == 1, n / (2 * max(1, pos))).otherwise(n / (2 * max(1, n - pos))))


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the vector ``features``; missing values are -1."""
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(-1.0)).alias(c) for c in columns]
    rest = [c for c in df.columns if c not in columns]
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df.select(*rest, *filled))


def scored(model: Model, df: DataFrame) -> DataFrame:
    """``df`` with the positive class's ``probability``; the model's own columns go."""
    out = model.transform(df).withColumn("_p", vector_to_array("probability")[1])
    return out.drop("rawPrediction", "prediction", "probability").withColumnRenamed("_p", "probability")


def logistic(df: DataFrame, label: str, c: float = 1.0, balanced: bool = False, iterations: int = 100) -> Model:
    """L2 logistic regression whose penalty is 1 / (2c) against the sum of losses."""
    train = class_weights(df, label) if balanced else df.withColumn("weight", F.lit(1.0))
    total = train.agg(F.sum("weight")).first()[0]
    return LogisticRegression(labelCol=label, weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-8).fit(train)


def forest(df: DataFrame, label: str, trees: int = 200, depth: int = 5, least: int = 8, balanced: bool = True, seed: int = 42) -> Model:
    train = class_weights(df, label) if balanced else df.withColumn("weight", F.lit(1.0))
    return RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy="sqrt", seed=seed).fit(train)


def boosted(df: DataFrame, label: str, rounds: int = 100, depth: int = 3, step: float = 0.05, least: int = 10, subsample: float = 0.8, seed: int = 42) -> Model:
    return GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=least, subsamplingRate=subsample, seed=seed).fit(df)


def ridge(df: DataFrame, label: str, alpha: float = 1.0) -> Model:
    """Linear regression with penalty alpha / 2 against the sum of squares."""
    n, sd = df.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    return LinearRegression(labelCol=label, regParam=alpha / n * (sd or 1.0), elasticNetParam=0.0, standardization=False, solver="normal").fit(df)


def regression_scores(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row: n, mse, r2."""
    err = (F.col(label) - F.col(prediction)) * (F.col(label) - F.col(prediction))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(err).alias("mse"), (1 - F.try_divide(F.sum(err), F.var_pop(label) * F.count(F.lit(1)))).alias("r2"))


def calibrated(df: DataFrame, label: str, id_: str, folds: int = 3, c: float = 1.0, seed: str = "cal") -> Callable[[DataFrame], DataFrame]:
    """Mean of ``folds`` logistic models, each put through an isotonic fit on the fold it did not see."""
    parts = stratified_folds(df, id_, label, folds, seed).select(id_, "fold")
    rows = written(df.join(parts.hint("merge"), id_))
    pairs = []
    for k in range(folds):
        base = logistic(rows.filter(F.col("fold") != k), label, c)
        held = scored(base, rows.filter(F.col("fold") == k))
        pairs.append((base, IsotonicRegression(labelCol=label, featuresCol="probability").fit(held)))

    def apply(new: DataFrame) -> DataFrame:
        out = new
        for k, (base, iso) in enumerate(pairs):
            out = iso.transform(scored(base, out)).withColumnRenamed("prediction", f"_c{k}").drop("probability")
        mean = reduce(Column.__add__, [F.col(f"_c{k}") for k in range(folds)]) / folds
        return out.withColumn("probability", mean).drop(*[f"_c{k}" for k in range(folds)])

    return apply


def perceptron(train: DataFrame, label: str, numeric: Sequence[str] = (), entities: Sequence[str] = (), hidden: Sequence[int] = (8,), iterations: int = 100, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """A multilayer perceptron on scaled numbers, one-hot entities, or both; unseen entities are zero vectors."""
    def prepared(df: DataFrame) -> DataFrame:
        return scale(impute(train, train, numeric), impute(train, df, numeric), numeric) if numeric else df

    stages: list = []
    for e in entities:
        stages += [StringIndexer(inputCol=e, outputCol=f"{e}_i", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{e}_i"], outputCols=[f"{e}_v"], dropLast=True)]
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"{e}_v" for e in entities]], outputCol="features"))
    base = prepared(train)
    features = Pipeline(stages=stages).fit(base)
    vectors = features.transform(base)
    width = len(vectors.select("features").first()[0])
    net = MultilayerPerceptronClassifier(labelCol=label, layers=[width, *hidden, 2], maxIter=iterations, seed=seed).fit(vectors)
    extra = [x for e in entities for x in (f"{e}_i", f"{e}_v")]
    return lambda df: scored(net, features.transform(prepared(df))).drop("features", *extra)


def prevalence(train: DataFrame, df: DataFrame, label: str) -> DataFrame:
    """``df`` with the train share of positives as ``probability``."""
    return df.withColumn("probability", F.lit(train.agg(F.avg(label)).first()[0]))


def ensemble(a: DataFrame, b: DataFrame, id_: str) -> DataFrame:
    """(id, probability): mean of two models' probabilities."""
    joined = a.select(id_, F.col("probability").alias("_a")).join(b.select(id_, F.col("probability").alias("_b")), id_)
    return joined.select(id_, (0.5 * F.col("_a") + 0.5 * F.col("_b")).alias("probability"))


def fitter(make: Callable[..., Model], columns: Sequence[str], label: str, **options: object) -> Fit:
    """A fit on ``columns`` as a function from train rows to a scorer."""

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model = make(assembled(train, columns), label, **options)
        return lambda df: scored(model, assembled(df, columns)).drop("features")

    return fit


def sizes(df: DataFrame, label: str) -> tuple[int, int]:
    n, pos = df.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    return n, pos


def trainable(train: DataFrame, test: DataFrame, label: str, least_train: int = 10, least_test: int = 5) -> bool:
    (n, p), (m, q) = sizes(train, label), sizes(test, label)
    return n >= least_train and m >= least_test and 0 < p < n and 0 < q < m


def grid(train: DataFrame, test: DataFrame, labels: Sequence[str], sets: Mapping[str, Sequence[str]], models: Mapping[str, tuple[Callable[..., Model], dict]], report: bool = False) -> DataFrame:
    """(label, features, model, metrics) of every combination that has rows and classes enough.

    A combination whose fit or scores fail (a score that is null or NaN too) is left out and named in the log; an error only if
    none is left. With ``report`` every combination has a row: one that fails, or whose label lacks rows or classes, has no metrics
    but says why in ``error``, which is null for all others. ``whole`` refuses results with such rows.
    """
    rows, missing = [], []

    def leave_out(label: str, set_name: str, name: str, why: str) -> None:
        log.warning("left out %s, %s, %s: %s", label, set_name, name, why)
        missing.append((label, set_name, name, why))

    for label in labels:
        a, b = (written(df.filter(F.col(label).isin(0, 1))) for df in (train, test))
        fine = trainable(a, b, label)
        for set_name, columns in sets.items():
            for name, (make, options) in models.items():
                if not fine:
                    leave_out(label, set_name, name, "rows or classes are too few")
                    continue
                try:
                    scores = fitter(make, columns, label, **options)(a)(b).withColumn("probability", F.coalesce("probability", F.lit(float("nan"))))
                    found = written(metric_bundle(scores, label, "probability").select(F.lit(label).alias("label"), F.lit(set_name).alias("features"), F.lit(name).alias("model"), "*"))
                    if math.isnan(found.first()["brier"]):
                        raise ValueError("not all scores are numbers")
                    rows.append(found)
                except Exception as e:  # a fit may fail in many ways; the others go on
                    leave_out(label, set_name, name, f"{type(e).__name__}: {e}".partition("\n")[0])
    if not rows:
        raise ValueError("no label has rows and classes enough, or all fits failed")
    found = reduce(DataFrame.unionByName, rows)
    if not report:
        return found
    failed = train.sparkSession.createDataFrame(missing, "label string, features string, model string, error string")
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def whole(results: DataFrame) -> DataFrame:
    """The results of ``grid`` with ``report``, without ``error``; an error that names the combinations that failed, if any did."""
    failed = [f"{r['label']}, {r['features']}, {r['model']}: {r['error']}" for r in results.filter("error IS NOT NULL").collect()]  # one row per combination at most
    if failed:
        raise ValueError(f"the grid is not whole; {'; '.join(failed)}")
    return results.drop("error")


def best(results: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first result of each group in ``order``; end it with the name, so that ties are settled."""
    return results.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def by_auc(auc: str = "auc", brier: str = "brier", name: str = "candidate") -> list[Column]:
    return [F.col(auc).desc(), F.col(brier).asc(), F.col(name).asc()]


def out_of_fold(df: DataFrame, id_: str, label: str, fit: Fit, folds: int = 5, seed: str = "oof") -> DataFrame:
    """``df`` with ``probability`` of a model that did not see the row."""
    rows = written(df.join(stratified_folds(df, id_, label, folds, seed).select(id_, "fold").hint("merge"), id_))

    def part(k: int) -> DataFrame:
        return fit(rows.filter(F.col("fold") != k).drop("fold"))(rows.filter(F.col("fold") == k).drop("fold"))

    return reduce(DataFrame.unionByName, at_once(df.sparkSession, [partial(part, k) for k in range(folds)]))


def two_stage(train: DataFrame, test: DataFrame, id_: str, label: str, first: Fit, second: Callable[[Sequence[str]], Fit], columns: Sequence[str], folds: int = 3) -> DataFrame:
    """``test`` scored by a second model over ``columns`` and the first model's score, out of fold on train."""
    a = out_of_fold(train, id_, label, first, folds).withColumnRenamed("probability", "stage1")
    b = first(train)(test).withColumnRenamed("probability", "stage1")
    return second(list(dict.fromkeys(["stage1", *columns])))(a)(b)


def segment_models(train: DataFrame, test: DataFrame, segment: str, label: str, fit: Fit, least_train: int = 30, least_test: int = 10) -> DataFrame:
    """(segment, metrics) of one model for each value with rows and classes enough in both parts.

    Fits that are ``Linear`` are made for all values at once, others one after another.
    """
    def fine(df: DataFrame, least: int) -> DataFrame:
        g = df.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("k"))
        return g.filter((F.col("n") >= least) & (F.col("k") == 2) & F.col(segment).isNotNull()).select(segment)

    common = fine(train, least_train).intersect(fine(test, least_test))
    if isinstance(fit, Linear):
        both = train.select(segment, label, *fit.columns, F.lit("train").alias("role")).unionByName(test.select(segment, label, *fit.columns, F.lit("validation").alias("role")))
        rows = written(both.join(common, segment).withColumn("_id", F.monotonically_increasing_id()))
        if rows.isEmpty():
            raise ValueError("no segment has rows and classes enough")
        manifest = rows.select(F.lit("segment").alias("mode"), F.col(segment).alias("fold"), "role", F.col("_id").alias("id"))
        return metric_bundle(validate_all(rows, manifest, "_id", label, {"fit": fit}).withColumnRenamed("fold", segment), "label", "probability", [segment])
    values = [r[0] for r in common.orderBy(segment).collect()]
    parts = []
    for v in values:
        out = fit(train.filter(F.col(segment) == v))(test.filter(F.col(segment) == v))
        parts.append(metric_bundle(out, label, "probability").withColumn(segment, F.lit(v)))
    if not parts:
        raise ValueError("no segment has rows and classes enough")
    return reduce(DataFrame.unionByName, parts)


def cross_validate(df: DataFrame, manifest: DataFrame, id_: str, label: str, candidates: Mapping[str, Fit], pairs: Sequence[tuple[tuple, str]] | None = None) -> DataFrame:
    """(mode, fold, candidate, id, label, probability): each candidate fitted on every fold's train rows alone.

    ``Linear`` candidates of all folds are fitted at once, others a few folds at a time; what a candidate's ``sharing`` keeps
    (as a vocabulary of a fold's train rows) serves all candidates of that fold. ``pairs`` ((mode, fold), candidate) are those to fit; all if not given.
    """
    linear = {n: fit for n, fit in candidates.items() if isinstance(fit, Linear)}
    wanted = lambda fold, name: pairs is None or (fold, name) in pairs
    parts = []
    if linear and (pairs is None or any(name in linear for _, name in pairs)):
        parts.append(validate_all(df, manifest, id_, label, linear, None if pairs is None else [p for p in pairs if p[1] in linear]))
    others = {n: fit for n, fit in candidates.items() if n not in linear}
    folds = [tuple(r) for r in manifest.select("mode", "fold").distinct().orderBy("mode", "fold").collect()] if others else []

    def fitted(mode: object, fold: object, fits: Mapping[str, Fit]) -> list[DataFrame]:
        here = manifest.filter((F.col("mode") == mode) & (F.col("fold") == fold))
        ids = {role: here.filter(F.col("role") == role).select(F.col("id").alias(id_)) for role in ("train", "validation")}
        train, held = (written(df.join(ids[r].hint("merge"), id_, "left_semi")) for r in ("train", "validation"))
        shared, out = {}, []
        for name, fit in fits.items():
            score = (fit.sharing(shared) if hasattr(fit, "sharing") else fit)(train)
            out.append(score(held).select(F.lit(mode).alias("mode"), F.lit(fold).alias("fold"), F.lit(name).alias("candidate"), F.col(id_).alias("id"), F.col(label).alias("label"), "probability"))
        return out

    fits = [(f, {n: fit for n, fit in others.items() if wanted(f, n)}) for f in folds]
    for found in at_once(df.sparkSession, [partial(fitted, *f, here) for f, here in fits if here]):
        parts += found
    return reduce(DataFrame.unionByName, parts)


def fold_scores(predictions: DataFrame) -> DataFrame:
    """(mode, fold, candidate, n, auc, average_precision, brier)."""
    found = metric_bundle(predictions, "label", "probability", ["mode", "fold", "candidate"])
    return found.select("mode", "fold", "candidate", "n", F.col("roc_auc").alias("auc"), F.col("pr_auc").alias("average_precision"), "brier")


def choose(scores: DataFrame, by: Sequence[str] = ("mode",)) -> DataFrame:
    """(by, candidate, auc, brier): the best mean AUC, then the lowest Brier, then the name.

    Means have 12 digits, so that equal ones are equal in whatever order the folds are added up.
    """
    means = scores.groupBy(*by, "candidate").agg(F.round(F.avg("auc"), 12).alias("auc"), F.round(F.avg("brier"), 12).alias("brier"))
    return best(means, by, by_auc())


def nested_validate(df: DataFrame, outer: DataFrame, inner: Callable[[DataFrame], DataFrame], id_: str, label: str, candidates: Mapping[str, Fit], keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Outer predictions of the candidate that inner folds of the outer train rows chose.

    The inner folds of all outer folds are validated together. ``keep`` stores the table (mode, candidate, auc, brier) of choices,
    ``mode`` being the number of the outer fold (e.g. writes and rereads it), before any outer fold is scored. With ``Stratified`` inner folds and
    ``Linear`` candidates alone no manifest of the inner folds is made: their numbers stand beside each row.
    """
    if isinstance(inner, Stratified) and (inner.id_, inner.label) == (id_, label) and all(isinstance(fit, Linear) for fit in candidates.values()):
        chosen_of = lambda scores: {int(r["mode"]): r["candidate"] for r in keep(choose(scores)).collect()}  # noqa: E731 one row per outer fold
        return nested_all(df, outer, inner.k, inner.seed, id_, label, candidates, chosen_of)
    folds = [tuple(r) for r in outer.select("mode", "fold").distinct().orderBy("mode", "fold").collect()]
    manifests = []
    for k, (mode, fold) in enumerate(folds):
        here = outer.filter((F.col("mode") == mode) & (F.col("fold") == fold))
        train = df.join(here.filter("role = 'train'").select(F.col("id").alias(id_)).hint("merge"), id_, "left_semi")
        manifests.append(inner(train).select(F.concat(F.lit(f"{k}|"), F.col("mode").cast("string")).alias("mode"), "fold", "role", "id"))
    scores = fold_scores(cross_validate(df, written(reduce(DataFrame.unionByName, manifests)), id_, label, candidates))
    chosen = keep(choose(scores.withColumn("mode", F.substring_index("mode", "|", 1)), ("mode",))).collect()  # one row per outer fold
    return cross_validate(df, outer, id_, label, candidates, [(folds[int(r["mode"])], r["candidate"]) for r in chosen])


def holdout(train: DataFrame, test: DataFrame, id_: str, label: str, manifest: DataFrame, candidates: Mapping[str, Fit], reference: str, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """(role, candidate, metrics) on the held-out rows of the reference, the candidate chosen on validation folds, and the prevalence."""
    chosen = keep(choose(fold_scores(cross_validate(train, manifest, id_, label, candidates)))).first()["candidate"]
    rows = [(r, n, candidates[n](train)(test)) for r, n in (("reference", reference), ("selected", chosen))]
    rows.append(("baseline", "prevalence", prevalence(train, test, label)))
    return reduce(DataFrame.unionByName, [metric_bundle(out, label, "probability").select(F.lit(r).alias("role"), F.lit(n).alias("candidate"), "*") for r, n, out in rows])


def importance(model: Model, columns: Sequence[str], spark, flagged: Sequence[str] = ()) -> DataFrame:  # noqa: ANN001
    """(feature, importance, flagged, share): tree importances or absolute coefficients."""
    values = model.featureImportances if hasattr(model, "featureImportances") else [abs(x) for x in model.coefficients]
    rows = [(c, float(values[i]), c in flagged) for i, c in enumerate(columns)]
    total = sum(r[1] for r in rows) or 1.0
    return spark.createDataFrame([(*r, r[1] / total) for r in rows], "feature string, importance double, flagged boolean, share double")


def top_coefficients(model: Model, columns: Sequence[str], spark, n: int = 15) -> DataFrame:  # noqa: ANN001
    """(sign, rank, feature, coefficient): the ``n`` lowest and the ``n`` highest coefficients, ties by the column's place."""
    values = [float(x) for x in model.coefficients]
    order = sorted(range(len(columns)), key=lambda i: (values[i], i))
    rows = [(sign, k + 1, columns[i], values[i]) for sign, part in (("negative", order[:n]), ("positive", order[::-1][:n])) for k, i in enumerate(part)]
    return spark.createDataFrame(rows, "sign string, rank int, feature string, coefficient double")


def linear_attribution(df: DataFrame, model: Model, columns: Sequence[str]) -> DataFrame:
    """(feature, mean_abs): mean |coefficient x (value - mean)| over the rows."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    aggs = [F.struct(F.lit(c).alias("feature"), F.avg(F.abs(F.lit(float(model.coefficients[i])) * (F.col(c) - F.lit(means[c])))).alias("mean_abs")) for i, c in enumerate(columns)]
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def counterfactual(df: DataFrame, id_: str, levers: Mapping[str, Sequence[str]], score: Callable[[DataFrame], DataFrame], step: float = 0.1) -> DataFrame:
    """(lever, mean, median, deviation, largest change, share of rises in %) of scores with a lever's columns raised.

    A constituent that is missing (null or -1) starts from 0; a lever that is null stays so; all stop at 1. All
    levers are scored in one pass over rows x levers.
    """
    columns = list(dict.fromkeys(c for name, parts in levers.items() for c in (name, *parts) if c in df.columns))
    long = df.withColumn("lever", F.explode(F.array(*map(F.lit, levers))))

    def moved(c: str) -> Column:
        x = F.col(c).cast("double")
        parts = [n for n, p in levers.items() if c in p]
        from_zero = F.when(F.coalesce(x, F.lit(-1.0)) == -1, 0.0).otherwise(x)
        out = F.when(F.col("lever").isin(*parts), F.least(from_zero + step, F.lit(1.0))) if parts else F.when(F.lit(False), x)
        return out.when(F.col("lever") == c, capped(x + step)).otherwise(x)

    after = score(long.withColumns({c: moved(c) for c in columns})).select(id_, "lever", F.col("probability").alias("_after"))
    both = after.join(score(df).select(id_, F.col("probability").alias("_before")), id_).withColumn("d", F.col("_after") - F.col("_before"))
    both = written(both.select("lever", "d"))
    middle = medians(both, ["lever"], "d").withColumnRenamed("median", "median_delta_p")
    found = both.groupBy("lever").agg(
        F.avg("d").alias("mean_delta_p"), F.stddev_pop("d").alias("std_delta_p"), F.max("d").alias("max_delta_p"), (100 * F.avg((F.col("d") > 0).cast("double"))).alias("pct_positive")
    )
    return found.join(middle, "lever").select("lever", "mean_delta_p", "median_delta_p", "std_delta_p", "max_delta_p", "pct_positive")


def sensitivity(train: DataFrame, test: DataFrame, labels: Sequence[str], sets: Mapping[str, Sequence[str]], masks: Mapping[str, Column], model: tuple[Callable[..., Model], dict]) -> DataFrame:
    """(subset, label, features, metrics) of one model over labels, feature sets and subsets."""
    parts = []
    for name, mask in masks.items():
        a, b = train.filter(mask), test.filter(mask)
        fine = [c for c in labels if trainable(a.filter(F.col(c).isin(0, 1)), b.filter(F.col(c).isin(0, 1)), c)]
        if fine:
            parts.append(grid(a, b, fine, sets, {"model": model}).withColumn("subset", F.lit(name)))
    if not parts:
        raise ValueError("no subset has rows and classes enough")
    return reduce(DataFrame.unionByName, parts)
