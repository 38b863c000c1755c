"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.cohort import STUDY
from tessera.operators.prefix import cumulative


def read_studies(spark: SparkSession, path: str, multi_line: bool = False, schema: StructType = STUDY) -> DataFrame:
    """Nested records; JSON lines split over tasks, a JSON array (``multi_line``) does not."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_parquet_or_csv(spark: SparkSession, parquet: str, csv: str, schema: StructType | str | None = None) -> DataFrame:
    """The Parquet table if its path exists, otherwise the CSV; a damaged Parquet table is an error."""
    try:
        return spark.read.parquet(parquet)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return read_csv(spark, csv, schema)


def read_journal(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Attempts as JSON lines, in the order of their column ``seq``."""
    return spark.read.schema(schema).json(path)


def append_journal(attempts: DataFrame, path: str) -> None:
    attempts.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Write once: an existing destination is an error."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_matrix(df: DataFrame, path: str, strings: Sequence[str] = ()) -> None:
    """Numeric and boolean columns and the named string columns as Parquet; written once."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    kept = [c for c, t in df.dtypes if t in kinds or t.startswith("decimal") or c in strings]
    df.select(*kept).write.mode("errorifexists").parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON file; written once."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, sha256, bytes, modified) of every file under the paths, hashed where it is read.

    A file is one row, so files are at most 2 GB, as tables written by Spark have them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def changed_files(now: DataFrame, saved: DataFrame) -> DataFrame:
    """Files that are new, gone or of another hash than in the saved manifest."""
    both = now.select("path", F.col("sha256").alias("now")).join(saved.select("path", F.col("sha256").alias("saved")), "path", "full_outer")
    return both.filter(~F.col("now").eqNullSafe(F.col("saved")))


def duplicate_headers(spark: SparkSession, path: str) -> DataFrame:
    """(column, n) of names that a CSV header holds more than once, from its first line; quotes count as in CSV."""
    first = spark.read.option("header", False).csv(path).limit(1)
    names = first.select(F.explode(F.array(*first.columns)).alias("column"))
    return names.groupBy("column").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def latest_attempts(journal: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """The last attempt of each key, whole rows."""
    rest = [c for c in journal.columns if c not in keys]
    last = journal.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_last"))
    return last.select(*keys, "_last.*")


def pending(work: DataFrame, journal: DataFrame, keys: Sequence[str], status: str = "status", done: str = "complete", order: str = "seq") -> DataFrame:
    """Work whose latest attempt isn't complete, or that has none."""
    complete = latest_attempts(journal, keys, order).filter(F.col(status) == done).select(*keys)
    return work.join(complete, list(keys), "left_anti")


def progress(work: DataFrame, journal: DataFrame, keys: Sequence[str], status: str = "status", failed: str = "failed", done: str = "complete", order: str = "seq") -> DataFrame:
    """One row: keys in all, attempted, complete and pending, attempts, and the longest run of failures.

    The run is found by islands over the journal's order: the number of non-failures before an
    attempt names its island. The islands are numbered by a prefix sum over blocks of the order.
    """
    latest = latest_attempts(journal, keys, order)
    per_key = work.join(latest.select(*keys, F.col(status).alias("_s")), list(keys), "left")
    totals = per_key.agg(F.count(F.lit(1)).alias("keys"), F.count("_s").alias("attempted"), F.count_if(F.col("_s") == done).alias("complete"))
    numbered = cumulative(journal.withColumn("_ok", (F.col(status) != failed).cast("long")), [], order, {"_island": "_ok"})
    runs = numbered.filter(F.col(status) == failed).groupBy("_island").agg(F.count(F.lit(1)).alias("n"))
    longest = runs.agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest_failure_run"))
    attempts = journal.agg(F.count(F.lit(1)).alias("attempts"))
    return totals.withColumn("pending", F.col("keys") - F.col("complete")).crossJoin(attempts).crossJoin(longest)  # one row each


def studies_of_columns(
    df: DataFrame, id_: Column, official: Column, brief: Column, status: Column, start: Column, phases: Column, conditions: Column, interventions: Column, outcomes: Column, eligibility: Column
) -> DataFrame:
    """Flat columns put into the nested shape of ``STUDY``, without results."""
    none = F.lit(None).cast("string")
    date = F.struct(start.alias("date"))
    section = F.struct(
        F.struct(id_.alias("nctId"), official.alias("officialTitle"), brief.alias("briefTitle")).alias("identificationModule"),
        F.struct(status.alias("overallStatus"), none.alias("whyStopped"), date.alias("startDateStruct"), date.alias("completionDateStruct"), F.struct(none.alias("date")).alias("resultsFirstPostDateStruct")).alias("statusModule"),
        F.struct(phases.alias("phases")).alias("designModule"),
        F.struct(conditions.alias("conditions")).alias("conditionsModule"),
        F.struct(interventions.alias("interventions")).alias("armsInterventionsModule"),
        F.struct(outcomes.alias("primaryOutcomes")).alias("outcomesModule"),
        F.struct(none.alias("briefSummary")).alias("descriptionModule"),
        F.struct(eligibility.alias("eligibilityCriteria")).alias("eligibilityModule"),
    )
    return df.select(section.alias("protocolSection"))
