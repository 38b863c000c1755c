"""Exact deduplication by a 128-bit content hash with comparison of the bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, stage


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def smallest(id_: Column) -> Column:
    """What to order rows by so that the smallest id comes first and nulls last; never null."""
    return F.struct(id_.isNull().alias("none"), id_.alias("id"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after ``normalised``; the row with the smallest id of
    equal texts stays. Rows are grouped by (hash, bytes): the grouping compares the bytes,
    so two texts that share a 128-bit hash fall into two groups, and partial aggregation
    sends one row per group and map task, however many copies a group has. Only ids and
    hashes are joined back; texts take part in that join only for hashes that two different
    texts share.

    Null and empty texts are one group. Rows that repeat an id count each in
    ``group_size`` and carry the same flags. An empty table gives an empty result. Columns
    other than the two named ones are not read.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("_norm"))
    hashed = rows.withColumn("_h", F.unhex(F.md5("_norm")))
    classes = hashed.groupBy("_h", "_norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    per_hash = stage(
        classes.groupBy("_h").agg(
            F.count(F.lit(1)).alias("_classes"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        )
    )
    thin = hashed.select("doc_id", "_h", F.sha2("_norm", 256).alias("text_sha256"))
    out = thin.join(per_hash.filter("_classes = 1"), "_h")
    shared = per_hash.filter("_classes > 1").select("_h")
    if not shared.isEmpty():
        apart = hashed.join(shared, "_h", "left_semi").join(classes, ["_h", "_norm"])
        out = out.unionByName(apart.withColumn("text_sha256", F.sha2("_norm", 256)), allowMissingColumns=True)
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def one_of_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole rows of ``docs``, one of each group of texts that ``exact_dedup`` calls equal.

    The row with the smallest id stays, one without an id only where no row has one. The
    decision is made on rows and not on ids, so repeated and null ids give one row as well.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(F.unhex(F.md5(norm)).alias("_h"), norm.alias("_norm"), smallest(F.col(id_col)).alias("_order"), F.struct("*").alias("_row"))
    return rows.groupBy("_h", "_norm").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""
