"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORDS, stage, unit

#: Buckets of the sampling order in which words are summed before any row is sorted.
BUCKETS = 16384


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets of (source, source_size) rows: shares by weight, none above ``cap`` x its size.

    Sources take the weights in code point order, null last, the list repeating. What a
    capped source cannot take goes to the others by weight until none is above its cap: with
    sources in order of cap over weight, that is one prefix sum of caps and one suffix sum
    of weights. The table has one row per source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("_w", w).withColumn("_cap", F.lit(cap) * F.col("source_size"))
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("_ratio").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onwards)
    leveled = ranked.withColumn("_level", level).withColumn("_capped", F.col("_level") >= F.col("_ratio"))
    final = F.min(F.when(~F.col("_capped"), F.struct("_ratio", "source", "_level"))).over(everything)["_level"]
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * F.col("_final"))
    return leveled.withColumn("_final", final).select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    preference_col: str | None = None,
) -> DataFrame:
    """One row per document: id, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``copies``.

    A document's expected copies are target over size of its source, times its preference
    over the source's mean preference where ``preference_col`` is given (at most ``cap``).
    The whole part is allotted for certain; the fractional part is its inclusion probability
    in a Pareto sample: rank by [U / (1 - U)] / [p / (1 - p)] and take documents in that
    order until the words left to the source are used. The document that crosses the mark is
    taken when that ends nearer to it. U depends on the id and seed alone, so reruns agree.

    The running sum never sorts a source in one task: words are summed by (source, bucket of
    the order), a prefix sum over buckets (of at most BUCKETS rows a source) finds the one bucket in
    which each source ends, and only that bucket's rows are put in order.

    Null texts have size 0 and ``taken`` 0. A null source is a source of its own, last in
    order. Rows that repeat an id rank side by side and count each. An empty table gives an
    empty result. Columns not named here are not read.
    """
    preference = F.coalesce(F.col(preference_col).cast("double"), F.lit(0.0)) if preference_col else F.lit(1.0)
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long").alias("size"),
            preference.alias("_pref"),
        )
    )
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("_pref") * F.col("size")).alias("_pref_size"))
    targets = source_targets(sums.select("source", "source_size"), weights, share, cap).alias("t")
    plan = stage(targets.join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "_pref_size"))

    def with_plan(df: DataFrame, small: DataFrame) -> DataFrame:
        small = small.withColumnRenamed("source", "_source")
        return df.join(small, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")

    expected = F.when(F.col("_pref_size") > 0, F.least(F.lit(cap), F.col("target") * F.col("_pref") / F.col("_pref_size"))).otherwise(F.lit(0.0))
    u = unit(F.col("doc_id"), seed)
    p = F.col("_part")
    drawn = (
        with_plan(rows, plan)
        .withColumn("_expected", expected)
        .withColumn("_whole", F.floor("_expected"))
        .withColumn("_part", F.col("_expected") - F.col("_whole"))
        .withColumn("_rank", F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p))))
        .withColumn("_bucket", F.floor(F.col("_rank") / (1 + F.col("_rank")) * BUCKETS))
        .drop("_pref", "_pref_size", "_expected", "_part")
    )
    left = F.col("target") - F.col("_certain")
    certain = drawn.groupBy("source").agg(F.sum(F.col("_whole") * F.col("size")).alias("_certain"), F.first("target").alias("target"))
    left_by = certain.select("source", left.alias("_left"))
    filled = drawn.filter(F.col("_bucket").isNotNull()).groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = with_plan(filled.withColumn("_upto", F.sum("_words").over(upto)), left_by).filter(F.col("_upto") > F.col("_left"))
    ends = ends.groupBy("source").agg(F.min(F.struct("_bucket", "_upto", "_words")).alias("_end"))
    marks = left_by.alias("l").join(ends.alias("e"), F.col("l.source").eqNullSafe(F.col("e.source")), "left")
    marks = stage(
        marks.select(F.col("l.source").alias("source"), "_left", F.col("_end._bucket").alias("_last"), (F.col("_end._upto") - F.col("_end._words")).alias("_before"))
    )
    placed = with_plan(drawn, marks)
    last = F.col("_bucket") == F.col("_last")
    order = Window.partitionBy("source").orderBy("_rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.filter(last).withColumn("_cum", F.col("_before") + F.sum("size").over(order))
    nearer = (F.col("_cum") - F.col("_left")) < (F.col("_left") - (F.col("_cum") - F.col("size")))
    edge = edge.withColumn("_extra", ((F.col("_cum") <= F.col("_left")) | nearer).cast("int"))
    sure = placed.filter(F.coalesce(~last, F.lit(True))).withColumn("_extra", F.coalesce((F.col("_last").isNull() | (F.col("_bucket") < F.col("_last"))) & F.col("_bucket").isNotNull(), F.lit(False)).cast("int"))
    both = sure.unionByName(edge.drop("_cum"))
    copies = F.col("_whole") + F.col("_extra")
    return both.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  (('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
      FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / w AS ratio FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM r),
t AS (SELECT source, source_size,
             CASE WHEN lvl >= ratio THEN cap
                  ELSE w * (SELECT first(lvl ORDER BY ratio, source NULLS LAST) FROM l WHERE lvl < ratio) END AS target FROM l),
e AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN least(2.0::DOUBLE, t.target * 1.0::DOUBLE / t.source_size) ELSE 0.0::DOUBLE END AS expected
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS p,
             target - sum(floor(expected) * size) OVER (PARTITION BY source) AS left_over FROM e),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM f),
c AS (SELECT *, sum(size) OVER (PARTITION BY source, p > 0 ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM q)
SELECT doc_id, source, size, source_size, target,
       ((whole + extra) * size)::BIGINT AS taken, (whole + extra)::INT AS copies
FROM (SELECT *, CASE WHEN p > 0 AND (cum <= left_over OR cum - left_over < left_over - (cum - size)) THEN 1 ELSE 0 END AS extra FROM c)
"""
