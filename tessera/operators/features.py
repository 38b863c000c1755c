"""Derived features, scores, missingness and train-only preparation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import capped
from tessera.operators.evidence import validated_join
from tessera.operators.prefix import column_medians, medians, ordinal


def missing_flags(real: Mapping[str, str]) -> dict[str, Column]:
    """``{flag: 0 where the column says that real data exist, else 1}``."""
    return {flag: F.when(F.coalesce(F.col(c), F.lit(False)), 0).otherwise(1) for flag, c in real.items()}


def derived(clinical: Column, pair: Column, tractability: Column, pathway: Column, overall: Column, lineage: Column, genetic: Column, alteration: Column, biomarker: Column) -> dict[str, Column]:
    """Ratios and proxies; a null input gives null where the formula needs it."""
    both = clinical.isNotNull() & pair.isNotNull()
    human = F.when(both & (pair == 0), 0.0).when(both, F.least(clinical / F.greatest(pair, F.lit(0.01)), F.lit(1.0)))
    known = alteration.isNotNull()
    context = F.when(known, F.least(0.5 * lineage + 0.3 * genetic + 0.2 * alteration, F.lit(1.0))).otherwise(F.least(0.5 * lineage + 0.5 * genetic, F.lit(1.0)))
    return {
        "polypharmacology": 1 - tractability,
        "human_fraction": human,
        "translational": 0.7 * human,
        "concordance": capped(0.6 * pathway + 0.4 * overall),
        "diversity": capped(0.5 * pair + 0.5 * clinical),
        "context_specificity": context,
        "directness": F.when(biomarker & F.coalesce(alteration > 0.05, F.lit(False)), 0.9).when(biomarker, 0.5),
        "prevalence": F.when(biomarker & known, alteration).when(biomarker, 0.3),
        "clonality": F.when(biomarker, 0.7),
        "precision": F.when(biomarker, 0.8),
    }


def split_score(biologic: Column, small: Mapping[str, float], large: Mapping[str, float], inverted: Sequence[str] = ()) -> dict[str, Column]:
    """A score for small molecules and one for biologics, 0 for the class that does not apply, and the one that does."""

    def total(weights: Mapping[str, float]) -> Column:
        term = lambda c, w: F.lit(float(w)) * ((1 - F.coalesce(F.col(c), F.lit(0.0))) if c in inverted else F.coalesce(F.col(c), F.lit(0.0)))
        return reduce(Column.__add__, [term(c, w) for c, w in weights.items()])

    a = F.when(biologic, 0.0).otherwise(total(small))
    b = F.when(biologic, total(large)).otherwise(0.0)
    return {"small_score": a, "biologic_score": b, "combined_score": F.when(biologic, b).otherwise(a)}


def weighted(weights: Mapping[str, float]) -> Column:
    """Weighted mean; a missing value counts as 0 and keeps its weight."""
    terms = [F.lit(float(w)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, w in weights.items()]
    return reduce(Column.__add__, terms) / F.lit(float(sum(weights.values())))


def composites(df: DataFrame, scores: Mapping[str, Mapping[str, float]], second: Mapping[str, Mapping[str, float]] | None = None, digits: int = 4) -> DataFrame:
    """Composite scores rounded to ``digits``; second-level ones are made of the unrounded ones."""
    raw = df.withColumns({f"_{n}": weighted(w) for n, w in scores.items()})
    if second:
        raw = raw.withColumns({n: F.round(weighted({f"_{c}": x for c, x in w.items()}), digits) for n, w in second.items()})
    return raw.withColumns({n: F.round(f"_{n}", digits) for n in scores}).drop(*[f"_{n}" for n in scores])


def refreshed_literature(df: DataFrame, pairs: DataFrame, keys: Sequence[str], total: str = "total", clinical: str = "clinical", recent: str = "recent", status: str = "status") -> DataFrame:
    """Literature counts joined and checked: used only where complete, then capped, logged and related."""
    joined = validated_join(df, pairs.select(*keys, total, clinical, recent, status), keys)
    valid = (F.col(status) == "complete") & F.col(total).isNotNull() & F.col(clinical).isNotNull() & F.col(recent).isNotNull()
    valid = F.coalesce(valid, F.lit(False))
    t, c, r = (F.when(valid, F.col(x).cast("double")) for x in (total, clinical, recent))
    return joined.withColumns(
        {
            "lit_missing": (~valid).cast("int"), "lit_log_total": F.log1p(t), "lit_log_clinical": F.log1p(c), "lit_log_recent": F.log1p(r),
            "lit_fraction": c / F.greatest(t, F.lit(1.0)), "lit_diversity": (capped(t / 1000) + capped(c / 100)) / 2,
        }
    ).drop(total, clinical, recent, status)


def feature_sets(df: DataFrame, composite: Sequence[str], raw: Sequence[str], context: Sequence[str]) -> dict[str, list[str]]:
    """Available columns of the composite, raw and hybrid sets, each column once and in order."""
    have = set(df.columns)
    pick = lambda *lists: [c for c in dict.fromkeys(x for part in lists for x in part) if c in have]
    return {"composite": pick(composite, context), "raw": pick(raw, context), "hybrid": pick(composite, raw, context)}


def missingness(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """(column, n_missing, share): one pass over the table, then one row turned on its side."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns])).alias("x")).select("x.*", "_n")
    return long.filter("n_missing > 0").select("column", "n_missing", (F.col("n_missing") / F.col("_n")).alias("share")).orderBy(F.col("n_missing").desc(), "column").limit(top)


def coverage(df: DataFrame, sources: Mapping[str, Column]) -> DataFrame:
    """(source, hits, total, share)."""
    row = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in sources.items()])
    long = row.select("total", F.explode(F.array(*[F.struct(F.lit(n).alias("source"), F.col(n).alias("hits")) for n in sources])).alias("x")).select("x.*", "total")
    return long.withColumn("share", F.try_divide("hits", "total"))


def vocabulary(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, token, code) of the distinct trimmed, lower-cased values; codes from 2 in order of the token."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lower(F.trim(F.col(c))).alias("token")) for c in columns])).alias("x")).select("x.*")
    distinct = long.filter("token IS NOT NULL AND token <> ''").distinct()
    return ordinal(distinct, ["column"], "token", "_n").select("column", "token", (F.col("_n") + 1).cast("int").alias("code"))


def encode(df: DataFrame, vocabulary_: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``<column>_code``; 1 for values that the vocabulary lacks."""
    for c in columns:
        part = vocabulary_.filter(F.col("column") == c).select(F.col("token").alias("_t"), F.col("code").alias(f"{c}_code"))
        df = df.join(part, F.lower(F.trim(F.col(c))) == F.col("_t"), "left").drop("_t").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(1)))
    return df


def scale(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their train mean, over their train population deviation (1 where that is 0)."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})


def impute(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact train medians for missing values, and ``<column>_indicator`` for columns that train lacks somewhere."""
    middle, missing = column_medians(train, columns)
    flags = {f"{c}_indicator": F.col(c).isNull().cast("int") for c in columns if missing[c]}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c]).cast("double")) for c in columns})


def one_hot(train: DataFrame, df: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """A 0/1 column for each train value, in order; other values are 0 everywhere."""
    values = [r[0] for r in train.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values; use StringIndexer and OneHotEncoder")
    return df.withColumns({f"{column}={v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def interactions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Products of each two columns, without squares."""
    return df.withColumns({f"{a}*{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)})


def signature_conflicts(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One row: rows, distinct feature vectors, vectors with both classes, rows in those. Null equals null."""
    each = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("classes"))
    mixed = F.col("classes") > 1
    return each.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_vectors"), F.count_if(mixed).alias("mixed_vectors"), F.coalesce(F.sum(F.when(mixed, F.col("n"))), F.lit(0)).alias("rows_in_mixed"))
