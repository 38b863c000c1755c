"""Leakage-aware splits and samples. Folds are rows of a manifest (mode, fold, role, id)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import entity_key, hash_order, pair_key
from tessera.operators.checks import require_unique
from tessera.operators.prefix import ordinal
from tessera.sources.scratch import written


def temporal_role(year: Column, cutoff: int) -> Column:
    """train up to the cutoff, test after it, null (in neither) without a year."""
    return F.when(year <= cutoff, "train").when(year > cutoff, "test")


def expanding_folds(df: DataFrame, id_: str, year: str, windows: Sequence[tuple[int, int | None]], mode: str = "temporal") -> DataFrame:
    """Train on years before each window, validate within it; ``None`` leaves a window open."""
    spark: SparkSession = df.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(windows)], "fold int, first int, last int"))
    y = F.col(year)
    role = F.when(y < F.col("first"), "train").when((y >= F.col("first")) & (F.col("last").isNull() | (y <= F.col("last"))), "validation")
    return df.select(id_, year).join(table, F.lit(True)).withColumn("role", role).filter("role IS NOT NULL").select(F.lit(mode).alias("mode"), "fold", "role", F.col(id_).alias("id"))


def fold_guard(manifest: DataFrame, labels: DataFrame, id_: str, label: str, least: int = 10) -> DataFrame:
    """(mode, fold, role) of parts with fewer than ``least`` rows or one class; empty is fine."""
    joined = manifest.join(labels.select(F.col(id_).alias("id"), label), "id")
    return joined.groupBy("mode", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("classes")).filter((F.col("n") < least) | (F.col("classes") < 2))


def _numbered(df: DataFrame, by: Sequence[str], hashed: str, ties: Sequence[str], buckets: int = 1024) -> DataFrame:
    """``df`` with ``_i``, the place (from 0) of each row in its group in the order of a 32-bit hash, nulls first.

    A group is cut into equal ranges of the hash, each numbered on its own and moved on by the sizes of those before.
    """
    cut = df.withColumn("_b", F.floor(F.col(hashed) / (2**32 // buckets)))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*[F.col(c).asc_nulls_first() for c in (hashed, *ties)]))
    before = F.sum("_m").over(Window.partitionBy(*by).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_m")).select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_o"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_b")]
    placed = cut.withColumn("_p", inside).alias("l").join(offsets.alias("r"), reduce(Column.__and__, same)).select("l.*", "_o")
    return placed.withColumn("_i", F.col("_p") - 1 + F.col("_o")).drop("_b", "_p", "_o")


def stratified_folds(df: DataFrame, id_: str, label: str, k: int, seed: str) -> DataFrame:
    """(id, label, fold): each class dealt over the folds in a seeded order."""
    placed = _numbered(df.select(id_, label).withColumn("_h", hash_order(F.col(id_), seed)), [label], "_h", [id_])
    return placed.select(id_, label, F.pmod("_i", F.lit(k)).cast("int").alias("fold"))


def stratified_parts(df: DataFrame, id_: str, label: str, k: int, seed: str, subsets: Mapping[str, Column], buckets: int = 1024) -> DataFrame:
    """``df`` with a column for each of ``subsets``: the fold that ``stratified_folds`` gives the row among those of the subset, null for others.

    One order of the rows serves all subsets. What is sent to all executors is ``buckets`` rows a class.
    """
    cut = df.withColumns({name: F.coalesce(c, F.lit(False)).cast("int") for name, c in subsets.items()}).withColumn("_h", hash_order(F.col(id_), seed))
    cut = cut.withColumn("_b", F.floor(F.col("_h") / (2**32 // buckets)))
    inside = Window.partitionBy(label, "_b").orderBy(F.col("_h").asc_nulls_first(), F.col(id_).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(label).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(label, "_b").agg(*[F.sum(c).alias(c) for c in subsets])
    offsets = totals.select(label, "_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_o") for c in subsets])
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (label, "_b")]
    placed = cut.withColumns({f"{c}_p": F.sum(c).over(inside) for c in subsets}).alias("l").join(F.broadcast(offsets).alias("r"), reduce(Column.__and__, same)).select("l.*", *[f"{c}_o" for c in subsets])
    dealt = placed.withColumns({c: F.when(F.col(c) == 1, F.pmod(F.col(f"{c}_p") - 1 + F.col(f"{c}_o"), F.lit(k)).cast("int")) for c in subsets})
    return dealt.drop("_h", "_b", *[f"{c}_{x}" for c in subsets for x in "po"])


@dataclass(frozen=True)
class Stratified:
    """``k`` stratified folds of whatever rows it is called with, each validated by the others, as a manifest."""

    id_: str
    label: str
    k: int
    seed: str
    mode: str = "inner"

    def __call__(self, df: DataFrame) -> DataFrame:
        return rotated(stratified_folds(df, self.id_, self.label, self.k, self.seed).withColumnRenamed(self.id_, "id"), self.mode, self.k)


def rotated(parts: DataFrame, mode: str, k: int) -> DataFrame:
    """A manifest in which each of ``k`` parts, (id, fold), is validated by the others."""
    each = parts.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"), "id", "fold")
    return each.select(F.lit(mode).alias("mode"), F.col("k").alias("fold"), F.when(F.col("k") == F.col("fold"), "validation").otherwise("train").alias("role"), "id")


def group_folds(df: DataFrame, group: str, label: str, k: int, seed: str) -> DataFrame:
    """(group, fold): no group is split, classes and sizes near even.

    Groups are dealt within their majority class by size, large first, forth and back over
    the folds.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("positives"))
    sizes = sizes.withColumn("stratum", (F.col("positives") * 2 > F.col("n")).cast("int"))
    sizes = written(sizes.withColumn("_h", hash_order(F.col(group), seed)))
    larger = F.sum("_m").over(Window.partitionBy("stratum").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.groupBy("stratum", "n").agg(F.count(F.lit(1)).alias("_m")).select("stratum", "n", F.coalesce(larger, F.lit(0)).alias("_larger"))
    same = F.col("l.stratum").eqNullSafe(F.col("r.stratum")) & (F.col("l.n") == F.col("r.n"))
    sizes = _numbered(sizes, ["stratum", "n"], "_h", [group]).alias("l").join(offsets.alias("r"), same).select("l.*", "_larger")
    i = F.col("_i") + F.col("_larger")
    forth, place = F.pmod(F.floor(i / k), F.lit(2)) == 0, F.pmod(i, F.lit(k))
    return sizes.select(group, "stratum", "n", F.when(forth, place).otherwise(k - 1 - place).cast("int").alias("fold"))


def deal_profiles(profiles: Sequence[tuple[int, int, int]], k: int, singly: int = 5000) -> list[list[int]]:
    """For each (negatives, positives, groups) how many of its groups each of ``k`` folds gets.

    Profiles whose classes are least even come first, then large ones. Groups go one by one where the folds' shares of each
    class then vary least, of equals to the smallest fold. Of a profile of more than ``singly`` groups those beyond are dealt
    out evenly, but for the last few: by then the folds are as even as such groups make them.
    """
    totals = [max(1, sum(p[c] * p[2] for p in profiles)) for c in (0, 1)]
    held = [[0, 0] for _ in range(k)]
    out = [[0] * k for _ in profiles]

    def add(i: int, fold: int, times: int) -> None:
        held[fold][0] += profiles[i][0] * times
        held[fold][1] += profiles[i][1] * times
        out[i][fold] += times

    def spread(i: int, fold: int) -> float:
        total = 0.0
        for c in (0, 1):
            shares = [(h[c] + (profiles[i][c] if f == fold else 0)) / totals[c] for f, h in enumerate(held)]
            mean = sum(shares) / k
            total += math.sqrt(sum((x - mean) ** 2 for x in shares) / k)
        return total

    for i in sorted(range(len(profiles)), key=lambda i: (-abs(profiles[i][0] - profiles[i][1]), -sum(profiles[i][:2]), profiles[i])):
        evenly = max(0, profiles[i][2] - singly) // k
        for step in range(profiles[i][2] - evenly * k):
            add(i, min(range(k), key=lambda f: (round(spread(i, f), 12), sum(held[f]), f)), 1)  # noqa: B023
            if step == singly - 1:
                for f in range(k):
                    add(i, f, evenly)
    return out


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int, seed: str) -> DataFrame:
    """(group, n, positives, fold): no group is split, and the folds' shares of both classes are as even as a greedy deal makes them.

    Groups with as many negatives and positives are alike, so what is dealt is the table of such profiles, one row for
    many groups; it comes to the driver. Groups take their profile's folds in a seeded order. Labels other than 0 and 1 count for nothing;
    a null group is a group.
    """
    sizes = df.groupBy(group).agg(F.count_if(F.col(label) == 0).alias("_neg"), F.count_if(F.col(label) == 1).alias("positives"), F.count(F.lit(1)).alias("n"))
    sizes = written(sizes.withColumn("_h", F.coalesce(hash_order(F.col(group), seed), F.lit(0).cast("long"))))
    profiles = [tuple(r) for r in sizes.groupBy("_neg", "positives").agg(F.count(F.lit(1))).orderBy("_neg", "positives").collect()]
    if not profiles:
        return sizes.select(group, "n", "positives", F.lit(0).alias("fold"))
    rows = []
    for (neg, pos, _), quota in zip(profiles, deal_profiles(profiles, k), strict=True):
        rows += [(neg, pos, f, sum(quota[:f]), sum(quota[: f + 1])) for f in range(k) if quota[f]]
    quotas = df.sparkSession.createDataFrame(rows, "_neg long, positives long, fold int, _from long, _to long")
    placed = _numbered(sizes, ["_neg", "positives"], "_h", [group])
    return placed.join(quotas, ["_neg", "positives"]).filter((F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_to"))).select(group, "n", "positives", "fold")


def inner_boundaries(df: DataFrame, year: str) -> DataFrame:
    """(boundary): the years at rows n/2 and 3n/4 in order of years, each once, from counts per year."""
    per_year = df.filter(F.col(year).isNotNull()).groupBy(year).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(year).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    held = per_year.withColumn("upto", upto).withColumn("total", total)
    at = F.explode(F.array(F.floor(F.col("total") / 2), F.floor(F.col("total") * 3 / 4)))
    spots = held.withColumn("spot", at)
    return spots.filter((F.col("spot") >= F.col("upto") - F.col("n")) & (F.col("spot") < F.col("upto"))).select(F.col(year).alias("boundary")).distinct()


def chronological_year(df: DataFrame, year: str, label: str) -> DataFrame:
    """(year): the latest from which on, and before which, both classes occur; null if none. Rows without a year are train."""
    per = df.groupBy(F.coalesce(F.col(year), F.lit(-(2**31))).alias("y")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n"))
    before = Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("y").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    fine = (F.sum("p").over(before) > 0) & (F.sum("n").over(before) > 0) & (F.sum("p").over(after) > 0) & (F.sum("n").over(after) > 0)
    return per.withColumn("ok", fine).agg(F.max(F.when(F.col("ok") & (F.col("y") > -(2**31)), F.col("y"))).alias("year"))


def chronological_split(df: DataFrame, id_: str, year: str, label: str, share: float = 0.8) -> DataFrame:
    """``df`` with ``role``: split at ``chronological_year``, else after the first ``share`` of rows by (year, id)."""
    at = chronological_year(df, year, label).first()[0]
    if at is not None:
        return df.withColumn("role", F.when(F.col(year) >= at, "validation").otherwise("train"))
    placed = ordinal(df, [], year, "_n", ties=[id_])
    return placed.withColumn("role", F.when(F.col("_n") <= int(df.count() * share), "train").otherwise("validation")).drop("_n")


def class_limit(df: DataFrame, id_: str, label: str, n: int) -> DataFrame:
    """The first ``n`` rows by id where these hold two classes, else the first ``n`` / 2 of each class.

    All rows where that gives no two classes either. Ids may be text; those without come first. Nulls are no class. Tasks keep
    their own first rows, in all or of each class, so no more than these are exchanged.
    """
    first = df.orderBy(F.col(id_).asc_nulls_first()).limit(n)
    if first.agg(F.count_distinct(label)).first()[0] > 1 or df.count() <= n:
        return first
    if n < 2 or df.agg(F.count_distinct(label)).first()[0] < 2:
        return df
    return _first_of_each(df.filter(F.col(label).isNotNull()), [label], [F.col(id_).asc_nulls_first()], n // 2)


def _first_of_each(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group: Spark limits groups in the tasks before it exchanges them."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def review_sample(df: DataFrame, id_: str, by: Sequence[str], each: int, total: int, seed: str) -> DataFrame:
    """``each`` rows per group, then others up to ``total``, in a seeded order.

    The others are among the first ``total`` rows of the order, so tasks send ``each`` rows a group and ``total`` in all at most.
    """
    hashed = df.withColumn("_h", hash_order(F.col(id_), seed))
    first = written(_first_of_each(hashed, list(by), [F.col("_h"), F.col(id_)], each))
    room = max(0, total - first.count())
    leading = hashed.orderBy("_h", id_).limit(total)
    rest = leading.join(first.select(id_), id_, "left_anti").orderBy("_h", id_).limit(room).select(*hashed.columns)
    return first.unionByName(rest).drop("_h")


def review_queue(sample: DataFrame, labels: Sequence[str], id_: str, url: str, blanks: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(queue without labels but with blank fields and a link, key with them)."""
    queue = sample.drop(*labels).withColumn("url", F.concat(F.lit(url), F.col(id_).cast("string"))).withColumns({b: F.lit("") for b in blanks})
    return queue, sample.select(id_, *labels)


def training_frame(df: DataFrame, id_: str, year: str, label: str, last_year: int, keys: Sequence[str]) -> DataFrame:
    """Rows up to ``last_year``, then those with a determinate label; keys cleaned; ``pair`` of the first two.

    The date filter comes first, so later labels cannot matter. A repeated id is an error.
    """
    early = df.filter(F.col(year) <= last_year).filter(F.col(label).isin(0, 1))
    require_unique(early, [id_], "training frame")
    cleaned = early.withColumns({k: entity_key(F.col(k), otherwise="unknown") for k in keys})
    return cleaned.withColumn("pair", pair_key(*[F.col(k) for k in keys[:2]]))


def violations(manifest: DataFrame, rows: DataFrame, id_: str, year: str | None = None, group: str | None = None, held_out: DataFrame | None = None, outer: DataFrame | None = None) -> DataFrame:
    """(mode, fold, problem, n) of a split manifest; empty when all holds.

    ``outer`` are the (id) of the outer train rows, to which the folds of an inner manifest must keep.
    """
    parts = []

    def add(found: DataFrame, problem: str) -> None:
        parts.append(found.select("mode", "fold", F.lit(problem).alias("problem"), F.col("n").cast("long").alias("n")))

    per_id = manifest.groupBy("mode", "fold", "id").agg(F.count_distinct("role").alias("roles"), F.count(F.lit(1)).alias("times"))
    add(per_id.groupBy("mode", "fold").agg(F.count_if(F.col("roles") > 1).alias("n")).filter("n > 0"), "roles overlap")
    add(per_id.groupBy("mode", "fold").agg(F.count_if(F.col("times") > F.col("roles")).alias("n")).filter("n > 0"), "repeated id")
    joined = manifest.join(rows.withColumnRenamed(id_, "id"), "id", "left")
    known = rows.select(F.col(id_).alias("id"))
    add(manifest.join(known, "id", "left_anti").groupBy("mode", "fold").agg(F.count(F.lit(1)).alias("n")), "unknown id")
    if year:
        last = F.max(F.when(F.col("role") == "train", F.col(year)))
        first = F.min(F.when(F.col("role") == "validation", F.col(year)))
        add(joined.groupBy("mode", "fold").agg((last >= first).alias("bad")).filter("bad").withColumn("n", F.lit(1)), "years overlap")
    if group:
        shared = joined.groupBy("mode", "fold", group).agg(F.count_distinct("role").alias("roles")).filter("roles > 1")
        add(shared.groupBy("mode", "fold").agg(F.count(F.lit(1)).alias("n")), "groups overlap")
    if held_out is not None:
        add(manifest.join(held_out.select(F.col(id_).alias("id")), "id", "left_semi").groupBy("mode", "fold").agg(F.count(F.lit(1)).alias("n")), "held-out rows used")
    if outer is not None:
        add(manifest.join(outer.select("id"), "id", "left_anti").groupBy("mode", "fold").agg(F.count(F.lit(1)).alias("n")), "outside the outer train rows")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct values that two splits share."""
    return a.select(key).intersect(b.select(key))


