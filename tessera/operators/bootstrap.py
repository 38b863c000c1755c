"""Bootstrap intervals by row or cluster, reproducible without a driver's random numbers.

Scores are first reduced to (cluster, score) histograms, these to what each cluster's positives win over
each cluster's negatives; a replicate multiplies by how often clusters were drawn. Draw j of replicate r hits cluster md5(seed, r, j) mod K,
which is an exact multinomial (``kind`` "multinomial", up to ``EXACT`` clusters, an error beyond). With
``kind`` "poisson" a cluster's count is a Poisson(1) number of md5(seed, r, cluster): another
estimator, for any number of clusters. Which one is drawn is never chosen by size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import auc_of
from tessera.operators.prefix import ordinal
from tessera.sources.arrow import map_arrow
from tessera.sources.scratch import written

EXACT = 100_000
#: Most clusters, and most numbers in all win matrices, that replicates are scored by matrices with.
MATRIX, ENTRIES = 1000, 1_000_000


def _hash(*parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("long")


def draws(clusters: DataFrame, replicates: int, seed: str, kind: str = "multinomial") -> DataFrame:
    """(replicate, cluster, times) for a table of distinct ``cluster``; clusters never drawn are absent."""
    if kind not in ("multinomial", "poisson"):
        raise ValueError(f"draws are multinomial or poisson, not {kind}")
    spark = clusters.sparkSession
    if kind == "multinomial":
        k = clusters.count()
        if k > EXACT:
            raise ValueError(f"{k} clusters are more than {EXACT}, the most for multinomial draws; use kind='poisson'")
        numbered = ordinal(clusters.withColumn("_h", _hash("order", F.col("cluster"))), [], "_h", "_i", ties=["cluster"])
        each = spark.range(replicates * k).select(F.floor(F.col("id") / k).alias("replicate"), F.pmod("id", F.lit(k)).alias("j"))
        hit = each.select("replicate", (F.pmod(_hash(seed, F.col("replicate"), F.col("j")), F.lit(k)) + 1).alias("_i"))
        times = hit.groupBy("replicate", "_i").agg(F.count(F.lit(1)).alias("times"))
        return times.join(numbered.select("cluster", "_i"), "_i").select("replicate", "cluster", "times")
    u = _hash(seed, F.col("replicate"), F.col("cluster")) / float(2**32)
    bound, times = 0.0, F.lit(0)
    for n in range(12):
        bound += exp(-1) / factorial(n)
        times = F.when(u >= bound, n + 1).otherwise(times)
    every = clusters.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    return every.select("replicate", "cluster", times.alias("times")).filter("times > 0")


def _interval(values: DataFrame, column: str, by: Sequence[str], replicates: int) -> DataFrame:
    return values.groupBy(*by).agg(
        F.percentile(column, F.lit(0.025)).alias("ci_low"), F.percentile(column, F.lit(0.975)).alias("ci_high"), F.count(column).alias("valid_replicates")
    ).withColumn("repeats", F.lit(replicates))


def _weighted_hist(df: DataFrame, label: str, scores: Sequence[str], cluster: str, drawn: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(replicate, extra, which, score, pos, neg)."""
    long = df.select(*extra, F.col(cluster).alias("cluster"), F.col(label).alias("_y"), F.explode(F.array(*[F.struct(F.lit(s).alias("which"), F.col(s).alias("score")) for s in scores])).alias("x"))
    small = long.groupBy("cluster", *extra, "x.which", "x.score").agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    mine = small.alias("a").join(drawn.alias("b"), F.col("a.cluster").eqNullSafe(F.col("b.cluster"))).select("a.*", "replicate", "times")
    return mine.groupBy("replicate", *extra, "which", "score").agg(F.sum(F.col("pos") * F.col("times")).alias("pos"), F.sum(F.col("neg") * F.col("times")).alias("neg"))


def _add_wins(won: np.ndarray, pos: np.ndarray, neg: np.ndarray, cluster: np.ndarray, score: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
    """Add what rows in order of the score win over those before them and over ``neg``, and their counts."""
    place = np.cumsum(np.append(False, score[1:] != score[:-1]))
    level = np.zeros((place[-1] + 1, len(neg)))
    np.add.at(level, (place, cluster), n)
    below = neg + np.cumsum(level, 0) - level / 2
    some = p > 0
    np.add.at(won, cluster[some], p[some, None] * below[place[some]])
    np.add.at(pos, cluster, p)
    neg += level.sum(0)


def _win_matrices(small: DataFrame, groups: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(W, P, N) of counts (_g, _c, score, pos, neg): W[g, a, b] = pairs in which a positive of cluster a scores above a negative of cluster b, ties half.

    Counts are dealt by ranges of the score. A task takes its range in order and adds what positives win within it;
    pairs across ranges need only the ranges' counts by cluster, which the driver adds with the sum of the
    matrices, one task's at a time.
    """
    ranged = small.repartitionByRange("score").sortWithinPartitions("score")
    step = max(64, (1 << 20) // k)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        won, pos, neg = np.zeros((groups, k, k)), np.zeros((groups, k)), np.zeros((groups, k))
        lowest, held = None, None
        for columns in chain(([b.column(c).to_numpy() for c in ("_g", "_c", "score", "pos", "neg")] for b in batches), [None]):
            rows = held if columns is None else columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if rows is None or not len(rows[2]):
                continue
            score = rows[2]
            lowest = score[0] if lowest is None else lowest
            end = len(score) if columns is None else int(np.searchsorted(score, score[-1]))  # the last score may go on
            first = 0
            while first < end:  # whole scores, some rows at a time
                stop = end if first + step >= end else max(int(np.searchsorted(score, score[first + step])), int(np.searchsorted(score, score[first], "right")))
                g, c, s, p, n = (x[first:stop] for x in rows)
                for i in np.unique(g):
                    m = g == i
                    _add_wins(won[i], pos[i], neg[i], c[m], s[m], p[m], n[m])
                first = stop
            held = [x[end:] for x in rows]
        if lowest is not None:
            g, c = np.indices((groups, k)).reshape(2, -1)
            row = pa.ListArray.from_arrays(pa.array(np.arange(groups * k + 1) * k, pa.int32()), pa.array(won.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), lowest)), pa.array(g), pa.array(c), pa.array(pos.ravel()), pa.array(neg.ravel()), row], ["lowest", "g", "a", "pos", "neg", "won"])

    parts = map_arrow(ranged, sums, "lowest double, g bigint, a bigint, pos double, neg double, won array<double>")
    w, counts = np.zeros((groups, k, k)), {}
    for r in written(parts).toLocalIterator():
        w[r["g"], r["a"]] += r["won"]
        p, n = counts.setdefault(r["lowest"], (np.zeros((groups, k)), np.zeros((groups, k))))
        p[r["g"], r["a"]], n[r["g"], r["a"]] = r["pos"], r["neg"]
    pos, neg = np.zeros((groups, k)), np.zeros((groups, k))
    for low in sorted(counts):
        p, n = counts[low]
        w += p[:, :, None] * neg[:, None, :]
        pos, neg = pos + p, neg + n
    return w, pos, neg


def _replicate_aucs(df: DataFrame, label: str, scores: Sequence[str], cluster: str, replicates: int, seed: str, kind: str, keys: Sequence[str] = ()) -> DataFrame:
    """(replicate, keys, which, auc) of every replicate; ``auc`` is null where a class is missing.

    Up to MATRIX clusters, with as many groups as ENTRIES allow, a replicate's AUC is t W t / (t P x t N) for how often each cluster was
    drawn, so no replicate sees a row or a score; beyond, scores are summed for each replicate. The values are the same.
    """
    spark = df.sparkSession
    clusters = df.select(F.col(cluster).alias("cluster")).distinct()
    drawn = draws(clusters, replicates, seed, kind)
    names = [r[0] for r in clusters.orderBy("cluster").limit(MATRIX + 1).collect()]
    found = [tuple(r) for r in df.select(*keys).distinct().limit(ENTRIES + 1).collect()] if keys else [()]
    if len(names) > MATRIX or len(names) ** 2 * len(found) * len(scores) > ENTRIES:
        return auc_of(_weighted_hist(df, label, scores, cluster, drawn, keys), ["replicate", *keys, "which"], blocks=1)
    if not names:
        return drawn.select("replicate", *[F.lit(None).alias(c) for c in keys], F.lit(None).cast("string").alias("which"), F.lit(None).cast("double").alias("auc"))
    groups = [(i, *g, s) for i, (g, s) in enumerate((g, s) for g in found for s in scores)]
    key_fields = [f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema] if keys else []
    group_table = F.broadcast(spark.createDataFrame(groups, f"_g int, {''.join(key_fields)}which string"))
    cluster_table = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"_c int, cluster {df.schema[cluster].dataType.simpleString()}"))

    def same(*columns: str) -> list[Column]:
        return [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]

    each = F.explode(F.array(*[F.struct(F.lit(s).alias("which"), F.coalesce(F.col(s).cast("double"), F.lit(float("-inf"))).alias("score")) for s in scores]))
    long = df.select(*keys, F.col(cluster).alias("cluster"), F.col(label).alias("_y"), each.alias("x")).select(*keys, "cluster", "_y", "x.which", "x.score")
    small = long.groupBy(*keys, "which", "cluster", "score").agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    small = small.alias("a").join(group_table.alias("b"), same(*keys, "which")).select("a.*", "_g").alias("a").join(cluster_table.alias("b"), same("cluster"))
    wins = spark.sparkContext.broadcast(_win_matrices(small.select("_g", "_c", "score", "pos", "neg"), len(groups), len(names)))  # ENTRIES numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, pos, neg = wins.value
        for batch in batches:
            lists = batch.column("t")
            flat = lists.flatten()
            times = np.zeros((len(lists), w.shape[1]))
            times[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), flat.field("_c").to_numpy()] = flat.field("times").to_numpy()
            for i in range(len(w)):
                pairs = (times @ pos[i]) * (times @ neg[i])
                auc = np.divide(((times @ w[i]) * times).sum(1), pairs, out=np.full(len(times), np.nan), where=pairs > 0)
                number = pa.array(np.full(len(times), i, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("replicate"), number, pa.array(auc, pa.float64(), from_pandas=True)], ["replicate", "_g", "auc"])

    by_replicate = drawn.alias("a").join(cluster_table.alias("b"), same("cluster")).groupBy("replicate").agg(F.collect_list(F.struct("_c", "times")).alias("t"))
    return map_arrow(by_replicate, score, "replicate bigint, _g int, auc double").join(group_table, "_g").select("replicate", *keys, "which", "auc")


def bootstrap_auc(df: DataFrame, label: str, score: str, cluster: str, replicates: int = 2000, seed: str = "boot", kind: str = "multinomial") -> DataFrame:
    """One row: n, positives, auc, ci_low, ci_high, valid_replicates, repeats. Replicates of one class are skipped."""
    per = _replicate_aucs(df, label, [score], cluster, replicates, seed, kind)
    whole = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("positives"))
    return totals.crossJoin(auc_of(whole)).crossJoin(_interval(per, "auc", [], replicates))  # one row each


def paired_bootstrap(df: DataFrame, label: str, a: str, b: str, cluster: str, replicates: int = 2000, seed: str = "boot", kind: str = "multinomial") -> DataFrame:
    """(which, ci_low, ci_high, valid_replicates, repeats) of both scores and ``difference`` (a - b), on the same draws."""
    per = _replicate_aucs(df, label, [a, b], cluster, replicates, seed, kind)
    wide = per.groupBy("replicate").agg(F.max(F.when(F.col("which") == a, F.col("auc"))).alias("_a"), F.max(F.when(F.col("which") == b, F.col("auc"))).alias("_b"))
    pairs = F.array(F.struct(F.lit(a).alias("which"), F.col("_a").alias("x")), F.struct(F.lit(b).alias("which"), F.col("_b").alias("x")), F.struct(F.lit("difference").alias("which"), (F.col("_a") - F.col("_b")).alias("x")))
    return _interval(wide.select(F.explode(pairs).alias("p")).select("p.*"), "x", ["which"], replicates)


def fold_bootstrap(df: DataFrame, label: str, score: str, reference: str, fold: str, cluster: str, replicates: int = 2000, seed: str = "boot", by: Sequence[str] = (), kind: str = "multinomial") -> DataFrame:
    """(by, ci_low, ci_high, ...) of the mean over folds of score's AUC less the reference's.

    A replicate counts only if every fold of its group has both classes.
    """
    keys = [*by, fold]
    per = _replicate_aucs(df, label, [score, reference], cluster, replicates, seed, kind, keys)
    wide = per.groupBy("replicate", *keys).agg(F.max(F.when(F.col("which") == score, F.col("auc"))).alias("_a"), F.max(F.when(F.col("which") == reference, F.col("auc"))).alias("_b"))
    folds = df.select(*keys).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_folds"))
    means = wide.groupBy("replicate", *by).agg(F.avg(F.col("_a") - F.col("_b")).alias("x"), F.count(F.col("_a") - F.col("_b")).alias("_got"))
    whole = means.join(folds, list(by)) if by else means.crossJoin(folds)  # one row
    return _interval(whole.filter(F.col("_got") == F.col("_folds")), "x", by, replicates)


def gate(summary: DataFrame, delta: str = "mean_difference", low: str = "ci_low", brier: str = "brier_difference", least: float = 0.05) -> DataFrame:
    """One row: accepted only if in every mode the gain is enough, its interval above 0 and Brier no worse."""
    fine = (F.col(delta) >= least) & (F.col(low) > 0) & (F.col(brier) <= 0)
    return summary.agg(F.count(F.lit(1)).alias("modes"), F.count_if(fine).alias("modes_passed"), F.bool_and(F.coalesce(fine, F.lit(False))).alias("accepted"))
