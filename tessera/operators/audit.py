"""Audits and reports: overlap, provenance, coverage, snapshots, errors, dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import entity_key
from tessera.operators.evidence import one_to_one
from tessera.operators.splits import temporal_role


def _long(df: DataFrame, keep: Sequence[str], structs: Sequence[Column]) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*structs)).alias("_x")).select(*keep, "_x.*")


def entity_overlap(df: DataFrame, labels: Sequence[str], entities: Sequence[str], year: str, cutoff: int) -> DataFrame:
    """Per label and entity: test rows whose key train has seen, not seen, or that have none.

    Rows need a label of 0 or 1 and a year; those left out are counted. Rows are counted by key first, in
    each task, so one row per key is exchanged and nothing is joined.
    """
    every = _long(
        df.withColumn("_role", temporal_role(F.col(year), cutoff)),
        ["_role"],
        [F.struct(F.lit(n).alias("label"), F.col(n).alias("y"), F.lit(e).alias("entity"), entity_key(F.col(e)).alias("key")) for n in labels for e in entities],
    )
    valid, positive = F.coalesce(F.col("y").isin(0, 1), F.lit(False)), F.col("y") == 1
    train, test = valid & (F.col("_role") == "train"), valid & (F.col("_role") == "test")
    counts = {"n_train": train, "n_test": test, "train_positive": train & positive, "test_positive": test & positive, "invalid": ~valid, "no_year": valid & F.col("_role").isNull()}
    per_key = every.groupBy("label", "entity", "key").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    known, seen = F.col("key").isNotNull(), F.col("n_train") > 0

    def total(column: Column | str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(column) if isinstance(column, str) else column).otherwise(0))

    out = per_key.groupBy("label", "entity").agg(
        *[F.sum(n).alias(n) for n in ("n_train", "n_test", "train_positive", "test_positive")],
        total("n_test", known & seen).alias("test_seen"), total("n_test", known & ~seen).alias("test_unseen"), total("n_test", ~known).alias("test_unknown"),
        total("test_positive", known & ~seen).alias("unseen_positive"), total(F.col("n_test") - F.col("test_positive"), known & ~seen).alias("unseen_negative"),
        F.sum("invalid").alias("excluded_invalid_label"), F.sum("no_year").alias("excluded_missing_year_with_valid_label"),
    )
    return out.withColumn("seen_fraction_all_test", F.try_divide("test_seen", "n_test"))


def provenance_counts(df: DataFrame, labels: Sequence[str], provenance: str) -> DataFrame:
    """(label, value, provenance, n), nulls kept."""
    return _long(df, [provenance], [F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in labels]).groupBy("label", "value", F.col(provenance).alias("provenance")).agg(F.count(F.lit(1)).alias("n"))


def coverage_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, n_null, n_zero, n_one): one pass over the table, one row turned on its side."""
    aggs = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.col(c) == 0).alias("n_zero"), F.count_if(F.col(c) == 1).alias("n_one")) for c in columns]
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def snapshot_comparison(a: DataFrame, b: DataFrame, id_: str, fields: Sequence[str]) -> DataFrame:
    """(field, common, disagreements) over the ids that both have."""
    both = one_to_one(a.select(id_, *fields), b.select(id_, *fields), id_)
    aggs = [F.struct(F.lit(f).alias("field"), F.count(F.lit(1)).alias("common"), F.count_if(~F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b"))).alias("disagreements")) for f in fields]
    return both.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def snapshot_conflicts(a: DataFrame, b: DataFrame, id_: str, field: str) -> DataFrame:
    both = one_to_one(a.select(id_, field), b.select(id_, field), id_)
    return both.filter(~F.col(f"{field}_a").eqNullSafe(F.col(f"{field}_b")))


def snapshot_profile(df: DataFrame, id_: str, year: str, a: str, b: str) -> DataFrame:
    """One row: rows, columns, distinct and repeated ids, year range, rows on which two labels differ."""
    n, ids = F.count(F.lit(1)), F.count_distinct(id_)
    return df.agg(n.alias("rows"), F.lit(len(df.columns)).alias("columns"), ids.alias("distinct_ids"), (n - ids).alias("repeated_ids"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("label_disagreements"))


def data_dictionary(df: DataFrame, descriptions: Mapping[str, str]) -> DataFrame:
    """(column, description, dtype, non_null, missing, example); the example is the smallest value."""
    aggs = [
        F.struct(F.lit(c).alias("column"), F.lit(descriptions.get(c, "")).alias("description"), F.lit(t).alias("dtype"), F.count(c).alias("non_null"), (F.count(F.lit(1)) - F.count(c)).alias("missing"), F.min(c).cast("string").alias("example"))
        for c, t in df.dtypes
    ]
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def cohort_report(df: DataFrame, labels: Sequence[str], entities: Sequence[str], year: str, flags: Sequence[str] = ()) -> DataFrame:
    """(metric, value) of counts, distincts, label shares, missing years and coverage, in one pass."""
    metrics = {"rows": F.count(F.lit(1)), "missing_year": F.count_if(F.col(year).isNull()), "first_year": F.min(year), "last_year": F.max(year)}
    metrics |= {f"distinct_{e}": F.count_distinct(e) for e in entities}
    for c in labels:
        pos, neg = F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 0)
        metrics |= {f"{c}_positive": pos, f"{c}_negative": neg, f"{c}_indeterminate": F.count_if(F.col(c) == -1), f"{c}_positive_rate": F.try_divide(pos, pos + neg)}
    metrics |= {f"{f}_coverage": F.avg(F.when(F.col(f) == 0, 1.0).otherwise(0.0)) for f in flags}
    row = df.agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
    return _long(row, [], [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])


def unmapped_report(df: DataFrame, keys: Sequence[str], mapped: str, target: str, test: Column) -> DataFrame:
    """Counts of unmapped rows by ``keys`` (nulls kept), with whether the target is unknown and a row is in the test part."""
    rows = df.filter(F.col(mapped) == 0)
    return rows.groupBy(*keys).agg(
        F.max(entity_key(F.col(target)).isNull()).alias("target_is_unknown"), F.max(F.coalesce(test, F.lit(False))).alias("appears_in_test_set"), F.count(F.lit(1)).alias("frequency_count")
    ).orderBy(F.col("frequency_count").desc(), *keys)


def strength_and_risk(scores: Sequence[str]) -> dict[str, Column]:
    """Names of the highest and lowest score; of equal ones the first in order."""
    high, low = F.greatest(*map(F.col, scores)), F.least(*map(F.col, scores))
    top = F.coalesce(*[F.when(F.col(s) == high, s) for s in scores])
    bottom = F.coalesce(*[F.when(F.col(s) == low, s) for s in scores])
    return {"top_strength": top, "top_risk": bottom}


def ranked_predictions(df: DataFrame, score: str, id_: str, n: int) -> DataFrame:
    return df.orderBy(F.col(score).desc(), id_).limit(n)


def error_report(df: DataFrame, label: str, score: str, id_: str, n: int, cut: float = 0.5) -> DataFrame:
    """The ``n`` false positives of the highest scores and ``n`` false negatives of the lowest."""
    fp = df.filter((F.col(label) == 0) & (F.col(score) >= cut)).orderBy(F.col(score).desc(), id_).limit(n).withColumn("error_type", F.lit("false_positive"))
    fn = df.filter((F.col(label) == 1) & (F.col(score) < cut)).orderBy(F.col(score), id_).limit(n).withColumn("error_type", F.lit("false_negative"))
    return fp.unionByName(fn)


def error_hotspots(df: DataFrame, label: str, score: str, columns: Sequence[str], n: int = 3, cut: float = 0.5) -> DataFrame:
    """(error_type, column, value, n): the values with most errors of each type."""
    wrong = df.withColumn("error_type", F.when((F.col(label) == 0) & (F.col(score) >= cut), "false_positive").when((F.col(label) == 1) & (F.col(score) < cut), "false_negative")).filter("error_type IS NOT NULL")
    counts = _long(wrong, ["error_type"], [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]).groupBy("error_type", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("error_type", "column").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def value_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(n)


def year_distribution(df: DataFrame, year: str, label: str) -> DataFrame:
    return df.groupBy(year).agg(F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative"), F.count(F.lit(1)).alias("total"))


def prediction_identity(predictions: DataFrame, source: DataFrame, id_: str, columns: Sequence[str]) -> DataFrame:
    """One row: ids only in one of the tables, and rows on which shared columns differ."""
    a = predictions.select(id_, F.lit(True).alias("_pa"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = source.select(id_, F.lit(True).alias("_pb"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = a.join(b, id_, "full_outer")
    paired = F.col("_pa").isNotNull() & F.col("_pb").isNotNull()
    return both.agg(
        F.count_if(paired).alias("common"), F.count_if(F.col("_pb").isNull()).alias("only_predictions"), F.count_if(F.col("_pa").isNull()).alias("only_source"),
        *[F.count_if(paired & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(f"{c}_differs") for c in columns],
    )
