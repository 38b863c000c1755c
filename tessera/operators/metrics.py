"""Ranking, calibration and subgroup metrics per group, from histograms of the scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import cumulative
from tessera.sources.scratch import written


def histogram(df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, score, pos, neg): weights of each class at each distinct score."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("neg"))


def auc_of(hist: DataFrame, by: Sequence[str] = (), undefined: float | None = None, blocks: int = 64) -> DataFrame:
    """(by, auc): ties count half; ``undefined`` where a class is absent. ``blocks`` as in ``cumulative``."""
    run = cumulative(hist, list(by), "score", {"upto": "neg"}, blocks=blocks)
    area = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    both = F.sum("pos") * F.sum("neg")
    return run.groupBy(*by).agg(F.when(both > 0, area / F.when(both > 0, both)).otherwise(F.lit(undefined).cast("double")).alias("auc"))


def ap_of(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, average_precision)."""
    run = cumulative(hist, list(by), "score", {"tp": "pos", "fp": "neg"}, descending=True)
    total = F.sum("pos")
    return run.groupBy(*by).agg(F.try_divide(F.sum(F.try_divide(F.col("pos") * F.col("tp"), F.col("tp") + F.col("fp"))), total).alias("average_precision"))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), undefined: float | None = None, weight: str | None = None) -> DataFrame:
    return auc_of(histogram(df, label, score, by, weight), by, undefined)


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return ap_of(histogram(df, label, score, by), by)


def confusion(df: DataFrame, label: str, score: str, by: Sequence[str] = (), cut: float = 0.5) -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label"), (F.col(score) >= cut).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _bundle_totals(hist: DataFrame, keys: Sequence[str], cut: float = 0.5) -> DataFrame:
    """(keys, n, positives, brier, f1, balanced_accuracy, and the sums that ``_ranked`` needs) from the counts of ``metric_bundle``."""
    hit = F.col("score") >= cut
    tp, fp, fn, tn = (F.coalesce(F.sum(F.when(c, n)), F.lit(0.0)) for c, n in ((hit, F.col("pos")), (hit, F.col("_known") - F.col("pos")), (~hit, F.col("pos")), (~hit, F.col("_known") - F.col("pos"))))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    recalls = (F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)) + F.coalesce(F.try_divide(tn, tn + fp), F.lit(0.0))) / 2
    # rows without a score come first in either order, NaN last
    ends = [F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0.0)).alias(f"_{c}_{name}") for name, of in (("null", F.col("score").isNull()), ("nan", F.isnan("score"))) for c in ("pos", "neg")]
    return hist.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum("pos").cast("long").alias("positives"), F.try_divide(F.sum("_squares"), F.sum("_both")).alias("brier"), f1.alias("f1"), recalls.alias("balanced_accuracy"),
        F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"), *ends,
    )


def _ranked(hist: DataFrame, keys: list[str], totals: DataFrame, undefined: float | None) -> DataFrame:
    """(keys, auc, average_precision) by one running sum: what stands at a score or above is the rest of what stands up to it."""
    run = cumulative(hist, keys, "score", {"_upto_pos": "pos", "_upto_neg": "neg"}).join(F.broadcast(totals), keys)

    def above(c: str) -> Column:
        here = F.col(f"_{c}") - F.col(f"_{c}_nan") + F.col(f"_{c}_null") - F.col(f"_upto_{c}") + F.col(c)
        return F.when(F.col("score").isNull(), F.col(c)).when(F.isnan("score"), F.col(f"_{c}")).otherwise(here)

    area, both = F.sum(F.col("pos") * (F.col("_upto_neg") - F.col("neg") / 2)), F.first("_pos") * F.first("_neg")
    tp, fp = above("pos"), above("neg")
    precision = F.try_divide(F.sum(F.try_divide(F.col("pos") * tp, tp + fp)), F.first("_pos"))
    return run.groupBy(*keys).agg(F.when(both > 0, area / F.when(both > 0, both)).otherwise(F.lit(undefined).cast("double")).alias("auc"), precision.alias("average_precision"))


def metric_bundle(df: DataFrame, label: str, score: str, by: Sequence[str] = (), undefined: float | None = None, digits: int = 6) -> DataFrame:
    """(by, n, positives, roc_auc, pr_auc, brier, f1, balanced_accuracy), rounded.

    The rows are read once: counts by distinct score are written, and all metrics come from them. Groups are few.
    """
    keys = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    y, error = F.col(label), F.col(score) - F.col(label)
    hist = base.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(y == 1, 1.0).otherwise(0.0)).alias("pos"), F.sum(F.when(y == 0, 1.0).otherwise(0.0)).alias("neg"),
        F.count(F.lit(1)).alias("_n"), F.count(y).alias("_known"), F.sum(error * error).alias("_squares"), F.count(error).alias("_both"),
    )
    hist = written(hist)
    totals = _bundle_totals(hist, keys)
    joined = totals.join(_ranked(hist, keys, totals, undefined), keys)
    named = {"roc_auc": "auc", "pr_auc": "average_precision", "brier": "brier", "f1": "f1", "balanced_accuracy": "balanced_accuracy"}
    return joined.select(*by, "n", "positives", *[F.round(c, digits).alias(n) for n, c in named.items()])


def calibration(df: DataFrame, label: str, score: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(by, bin, n, mean_score, positive_rate) of equal bins (lo, hi]; empty ones are absent."""
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.col(score) * bins))).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def _curve(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    keys = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    hist = histogram(base, label, score, keys)
    totals = hist.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return cumulative(hist, keys, "score", {"tp": "pos", "fp": "neg"}, descending=True).join(totals, keys)


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, fpr, tpr) at each distinct score."""
    return _curve(df, label, score, by).select(*by, F.col("score").alias("threshold"), F.try_divide("fp", "_n").alias("fpr"), F.try_divide("tp", "_p").alias("tpr"))


def pr_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, precision, recall) at each distinct score."""
    return _curve(df, label, score, by).select(*by, F.col("score").alias("threshold"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "_p").alias("recall"))


def reversed_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, auc, reversed_auc): a model that ranks the wrong way shows in the second."""
    keys = list(by) or ["_all"]
    base = (df if by else df.withColumn("_all", F.lit(0))).withColumn("_r", 1 - F.col(score))
    both = roc_auc(base, label, score, keys).join(roc_auc(base, label, "_r", keys).withColumnRenamed("auc", "reversed_auc"), keys)
    return both.select(*by, "auc", "reversed_auc")


def subgroup_metrics(df: DataFrame, label: str, score: str, groupings: Sequence[str], least: int = 20, pool: int | None = None) -> DataFrame:
    """``metric_bundle`` by (subgroup, value) of several groupings in one pass.

    With ``pool``, values of fewer rows than that are ``other``. Groups under ``least`` rows or
    of one class are left out.
    """
    pairs = F.array(*[F.struct(F.lit(g).alias("subgroup"), F.coalesce(F.col(g).cast("string"), F.lit("unknown")).alias("value")) for g in groupings])
    long = df.select(label, score, F.explode(pairs).alias("x")).select(label, score, "x.*")
    if pool is not None:
        sizes = long.groupBy("subgroup", "value").agg(F.count(F.lit(1)).alias("_c"))
        long = long.join(sizes, ["subgroup", "value"]).withColumn("value", F.when(F.col("_c") < pool, "other").otherwise(F.col("value"))).drop("_c")
    found = metric_bundle(long, label, score, ["subgroup", "value"])
    return found.filter((F.col("n") >= least) & (F.col("positives") > 0) & (F.col("positives") < F.col("n")))


def fold_summary(scores: DataFrame, by: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
    """Mean and sample deviation of each metric over the folds."""
    return scores.groupBy(*by).agg(*[f for c, n in metrics.items() for f in (F.avg(c).alias(f"mean_{n}"), F.stddev_samp(c).alias(f"sd_{n}"))])


def paired_delta(scores: DataFrame, reference: str, keys: Sequence[str], candidate: str, metric: str) -> DataFrame:
    """``scores`` with the reference candidate's metric of the same fold and the difference."""
    ref = scores.filter(F.col(candidate) == reference).select(*keys, F.col(metric).alias(f"reference_{metric}"))
    return scores.join(ref, list(keys), "left").withColumn(f"{metric}_difference", F.col(metric) - F.col(f"reference_{metric}"))
