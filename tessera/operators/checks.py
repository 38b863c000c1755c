"""Guards: unique keys, two classes, valid scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """``df``, or an error if a complete key (no part null) occurs twice."""
    known = df.dropna(subset=keys)
    if not known.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"{what}: {', '.join(keys)} not unique")
    return df


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_two_classes(df: DataFrame, label: str, by: list[str], least: int = 1) -> DataFrame:
    """``df``, or an error if a group of ``by`` has fewer than ``least`` rows or one class."""
    odd = df.groupBy(*by).agg(F.count_distinct(label).alias("classes"), F.count(F.lit(1)).alias("n"))
    if not odd.filter((F.col("classes") != 2) | (F.col("n") < least)).isEmpty():
        raise ValueError("a fold lacks rows or a class")
    return df


def require_scores(df: DataFrame, label: str, scores: list[str]) -> DataFrame:
    """``df``, or an error if a label is not 0 or 1 or a score is null, NaN or outside [0, 1]."""
    bad = ~F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    for s in scores:
        bad = bad | F.col(s).isNull() | F.isnan(s) | ~F.col(s).between(0, 1)
    if not df.filter(bad).isEmpty():
        raise ValueError("labels must be 0 or 1 and scores within [0, 1]")
    return df
