"""A training corpus from ``documents`` in five stages; see ``STAGES``.

Every stage decides on rows and takes any further columns along, whatever their names. Nulls may stand in any
column: a null text is an empty one, a null id comes after all others where the smallest id stays. An
empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stage, table
from tessera.llm.decontaminate import contamination
from tessera.llm.exact import one_of_equal, smallest
from tessera.llm.language import UNKNOWN, held_out, identify, learn_profiles
from tessera.llm.mixing import mix_sources
from tessera.llm.neardup import near_duplicates

#: Language identification and near-duplicate search are not SQL.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, text, order, row) of ``docs``; equal texts, and they alone, share a key, whatever their ids."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    return docs.select(key.alias("key"), text.alias("text"), smallest(F.col("doc_id")).alias("order"), F.struct("*").alias("row"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled rows; others and those without letters go.

    Null and empty texts have no letter and go. All go where no row is labelled. Repeated rows are judged alike
    and all stay; of equally near languages the first by name is taken.
    """
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    profiles = stage(learn_profiles(docs.filter(~out)))
    # the decision travels with the row, so that nothing is joined; as a struct, so that no name clashes
    judged = identify(docs.select("doc_id", "text", F.struct("*").alias("row")), profiles, keep=["row"])
    return judged.filter(F.col("lang_pred") != UNKNOWN).select("row.*")


def first_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id; of rows with that id too, any one.

    Null texts are equal to empty ones and to each other. Texts that differ in white space alone are equal.
    """
    return one_of_equal(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, or of rows with the same text, the row with the smallest id.

    Of rows of the same text and id any one stays. Null and empty texts are one text, which is near to no other;
    so one row of them stays.
    """
    rows = _keyed(docs)
    groups = near_duplicates(rows.select("key", "text"), id_col="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    first = rows.groupBy("key").agg(F.min("order").alias("order"))
    chosen = groups.join(first, "key").groupBy("component_id").agg(F.min_by("key", F.struct("order", "key")).alias("key")).select("key")
    return rows.join(chosen, "key", "left_semi").groupBy("key").agg(F.min_by("row", "order").alias("row")).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts have no words and stay, and so does every row where the benchmark is empty or has no words.
    Rows of the same text go or stay together.
    """
    rows = _keyed(docs)
    judged = contamination(rows.select("key", "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    return rows.join(judged.filter("n_hit = 0").select(F.col("doc_id").alias("key")).distinct(), "key", "left_semi").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document that is left is taken into the mix: one row for each, those that are not taken too.

    Null and empty texts have size 0 and are taken 0 words. A null source is a source of its own. Repeated rows count each; ties in the
    sampling order go by id, then size.
    """
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("exact_dedup", first_of_equal),
    ("near_dedup", one_of_near),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
