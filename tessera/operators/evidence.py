"""Evidence tables and their joins.

Evidence is keyed by target or by (target, disease) and small beside the cohort, so these
are left joins whose strategy Spark picks from the sizes it sees; no hint forces a broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import capped, entity_key
from tessera.operators.checks import require_unique


def lookup_defaults(df: DataFrame, table: DataFrame, keys: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left join on ``keys``; the columns of ``defaults`` are filled where there is no row or value."""
    joined = df.join(table.select(*keys, *defaults), list(keys), "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def lookup_chain(df: DataFrame, pair: DataFrame, target: DataFrame, pair_keys: Sequence[str], target_keys: Sequence[str], column: str, default: object) -> DataFrame:
    """``column`` from the pair table, else from the target table, else ``default``."""
    first = pair.select(*pair_keys, F.col(column).alias("_pair"))
    second = target.select(*target_keys, F.col(column).alias("_target"))
    joined = df.join(first, list(pair_keys), "left").join(second, list(target_keys), "left")
    return joined.withColumn(column, F.coalesce("_pair", "_target", F.lit(default))).drop("_pair", "_target")


def validated_join(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Many-to-one left join on trimmed, lower-cased keys; a key twice in ``table`` is an error."""
    norm = {k: F.lower(F.trim(k)) for k in keys}
    right = table.withColumns(norm)
    require_unique(right, list(keys), "evidence")
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.lower(F.trim(df[k])) == right[f"_r_{k}"] for k in keys]
    return df.join(right, same, "left").drop(*[f"_r_{k}" for k in keys])


def one_to_one(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Inner join of two snapshots, each with unique keys; other columns get suffixes."""
    sides = []
    for df, s in ((a, suffixes[0]), (b, suffixes[1])):
        require_unique(df, [key], "snapshot")
        sides.append(df.withColumnsRenamed({c: c + s for c in df.columns if c != key}))
    return sides[0].join(sides[1], key)


def override_join(df: DataFrame, fresh: DataFrame, key: str, value: str, flag: str, fill: str) -> DataFrame:
    """``value`` replaced where ``fresh`` has one, and ``flag`` then 0; ``fill`` replaced only where missing or not above 0."""
    require_unique(fresh, [key], "override")
    new = fresh.select(key, F.col(value).alias("_v"), F.col(fill).alias("_f"))
    joined = df.join(new, key, "left")
    has = F.col("_v").isNotNull()
    weak = F.col(fill).isNull() | (F.col(fill) <= 0)
    return joined.withColumns(
        {value: F.when(has, F.col("_v")).otherwise(F.col(value)), flag: F.when(has, 0).otherwise(F.col(flag)), fill: F.when(weak & F.col("_f").isNotNull(), F.col("_f")).otherwise(F.col(fill))}
    ).drop("_v", "_f")


def attach_texts(df: DataFrame, texts: DataFrame, key: str, text: str, placeholder: str = "missingprotocol") -> DataFrame:
    """Left join of one text per key; a miss gets the placeholder and ``text_missing`` 1."""
    require_unique(texts, [key], "texts")
    joined = df.join(texts.select(key, F.col(text).alias("_t")), key, "left")
    return joined.withColumn("text_missing", F.col("_t").isNull().cast("int")).withColumn(text, F.coalesce("_t", F.lit(placeholder))).drop("_t")


def merge_sources(base: DataFrame, sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Columns of all sources by ``key``; where two have a column, the later one with a row for the key decides, null or not."""
    out, columns = base, {}
    for i, s in enumerate(sources):
        names = [c for c in s.columns if c != key]
        out = out.join(s.select(key, F.lit(True).alias(f"_has{i}"), *[F.col(c).alias(f"_{i}_{c}") for c in names]), key, "left")
        for c in names:
            columns.setdefault(c, []).append(i)
    merged = []
    for c, at in columns.items():
        value: Column = F.lit(None)
        for i in at:
            value = F.when(F.col(f"_has{i}"), F.col(f"_{i}_{c}")).otherwise(value)
        merged.append(value.alias(c))
    return out.select(*base.columns, *merged)


def vectors(df: DataFrame, tables: Sequence[tuple[DataFrame, str, str, int]], out: str) -> DataFrame:
    """``out``: vectors of several (table, key, column, size), zeros where a key is missing, joined in order."""
    parts = []
    for i, (table, key, column, size) in enumerate(tables):
        df = df.join(table.select(key, F.col(column).alias(f"_v{i}")), key, "left")
        parts.append(F.coalesce(f"_v{i}", F.array_repeat(F.lit(0.0).cast("float"), size)))
    return df.withColumn(out, F.concat(*parts)).drop(*[f"_v{i}" for i in range(len(tables))])


def network(edges: DataFrame, target: str, score: str) -> DataFrame:
    """(target, degree, mean_score, centrality)."""
    n = F.count(F.lit(1))
    return edges.groupBy(target).agg(n.alias("degree"), (F.avg(score) / 1000).alias("mean_score"), F.least(n / 500, F.lit(1.0)).alias("centrality"))


def activity(rows: DataFrame, target: str, potency: str) -> DataFrame:
    """(target, n_activities, activity_score, potency_score, tractability)."""
    n = F.count(F.lit(1))
    return rows.groupBy(target).agg(n.alias("n_activities"), F.least(n / 10, F.lit(1.0)).alias("activity_score"), capped(F.avg(potency) / 10).alias("potency_score"), F.when(n >= 5, 1.0).otherwise(0.5).alias("tractability"))


def annotation(comments: Column, references: Column, database: str = "GO") -> dict[str, Column]:
    """Scores of an array of comments and one of struct(db, id) references."""
    return {
        "annotation_score": F.least(F.size(comments) / 20, F.lit(1.0)),
        "process_score": F.least(F.size(F.filter(references, lambda r: r["db"] == database)) / 50, F.lit(1.0)),
        "class_score": F.lit(0.7),
    }


def expression(category: Column, description: Column, tumour: Column, normal: Column, specific: Sequence[str], low: Sequence[str], high: Sequence[str]) -> dict[str, Column]:
    """Specificity by category, burden by words of the description, and the difference of two levels."""
    text = F.lower(F.coalesce(description, F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(text, k))
    return {
        "specificity_class": F.when(F.lower(category).isin(*specific), 0.8).otherwise(0.4),
        "burden": F.when(has(low), 0.1).when(has(high), 0.6).otherwise(0.3),
        "tumour_specificity": F.greatest(F.lit(0.0), tumour - normal),
    }


def pathways(primary: DataFrame, secondary: DataFrame, target: str) -> DataFrame:
    """(target, n_pathways, pathway_score, breadth): counts of the primary source, else of the secondary."""
    a = primary.groupBy(target).agg(F.count(F.lit(1)).alias("_a"))
    b = secondary.groupBy(target).agg(F.count(F.lit(1)).alias("_b"))
    n = F.coalesce("_a", "_b", F.lit(0))
    return a.join(b, target, "full_outer").select(target, n.alias("n_pathways"), F.least(n / 20, F.lit(1.0)).alias("pathway_score"), F.least(n / 50, F.lit(1.0)).alias("breadth"))


def alterations(rows: DataFrame, keys: Sequence[str], burden: float = 0.3, complexity: float = 0.5) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(F.least(n / 200, F.lit(1.0)).alias("alteration_frequency"), F.lit(burden).alias("co_alteration_burden"), F.lit(complexity).alias("genomic_complexity"), F.lit(True).alias("has_real_data"))


def literature(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores and status of (keys, kind, count) rows, kinds total, clinical_trial and recent; null is not 0."""

    def n(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("count")))

    wide = counts.groupBy(*keys).agg(n("total").alias("total"), n("clinical_trial").alias("clinical"), n("recent").alias("recent"))
    total, clinical, recent = F.col("total"), F.col("clinical"), F.col("recent")
    known = total.isNotNull().cast("int") + clinical.isNotNull().cast("int") + recent.isNotNull().cast("int")
    odd = F.coalesce((clinical > total) | (recent > total), clinical > total, recent > total, F.lit(False))
    status = F.when(odd, "inconsistent").when(known == 3, "complete").when(known > 0, "partial").otherwise("failed")
    wide = wide.withColumn("status", status)
    fine = F.col("status") != "inconsistent"
    return wide.withColumns(
        {
            "volume": F.when(fine, capped(total / 1000)),
            "clinical_score": F.when(fine, capped(clinical / 100)),
            "recency": F.when(fine & total.isNotNull(), capped(recent / F.greatest(total * 0.4, F.lit(1.0)))),
        }
    )


def thresholds(score: Column) -> dict[str, Column]:
    return {"essential": F.when(score < -0.5, 1.0).when(score < -0.3, 0.5).otherwise(0.0), "selective": ((score > -0.9) & (score < -0.5)).cast("int")}


def work_list(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct combinations of known entities, in order."""
    known = df.select(*keys)
    for k in keys:
        known = known.filter(entity_key(F.col(k)).isNotNull())
    return known.distinct().orderBy(*keys)


def list_join(df: DataFrame, tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Left join of several tables with unique keys, all by ``key``."""
    for t in tables:
        df = df.join(require_unique(t, [key], "lookup"), key, "left")
    return df
