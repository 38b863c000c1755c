"""Queries: sources and sinks, as round trips of the given tables through files in the shared folder.

What is written is read back by the operators and returned, so the SQL says what the tables hold.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cohort as P
from tessera.plans.base import cohort, query, table
from tessera.plans.cohort import studies
from tessera.sources import io
from tessera.sources.scratch import scratch_path


@query("WITH x AS (SELECT o_orderkey::VARCHAR AS nct_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'official ' ELSE 'brief ' END || o_orderkey AS title, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'TERMINATED' ELSE '' END AS status, year(o_orderdate)::INT AS start_year FROM orders WHERE o_totalprice > 100000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N'))) SELECT * FROM x")
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as JSON lines, read with the schema and flattened (S1)."""
    path = scratch_path(spark, "studies")
    studies(spark, sf_dir).write.json(path)
    return P.flatten_studies(io.read_studies(spark, path)).select("nct_id", "title", "status", "start_year")


@query(" SELECT id, drug, year, x1 FROM c")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as CSV (S6), read with its schema where no Parquet stands beside it (S2, S3)."""
    path = scratch_path(spark, "csv")
    c = cohort(spark, sf_dir).select("id", "drug", "year", "x1")
    io.write_csv(c, path)
    return io.read_parquet_or_csv(spark, path + "-none", path, c.schema)


@query(" SELECT id, label, p, target FROM c")
def matrix_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns and one named text column as Parquet (S7), which comes before a CSV (S3)."""
    path = scratch_path(spark, "matrix")
    io.write_matrix(cohort(spark, sf_dir).select("id", "label", "p", "target", "drug"), path, ["target"])
    return io.read_parquet_or_csv(spark, path, path + "-none")


@query(
    """WITH j AS (SELECT user_id AS target, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'partial' END AS status FROM events)
    SELECT target, max(seq) AS seq, arg_max(status, seq) AS status FROM j GROUP BY target"""
)
def journal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts appended as JSON lines in two turns (S5), read back, the last of each key (S4)."""
    path = scratch_path(spark, "journal")
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed").otherwise("partial")
    attempts = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("target"), status.alias("status"))
    middle = attempts.agg(F.avg("seq")).first()[0] or 0.0
    for part in (F.col("seq") < middle, F.col("seq") >= middle):
        io.append_journal(attempts.filter(part), path)
    return io.latest_attempts(io.read_journal(spark, path, attempts.schema), ["target"])


@query(" SELECT count(*) AS n, count(*) FILTER (label = 1) AS positives, min(year)::BIGINT AS first_year, max(year)::BIGINT AS last_year, true AS refused FROM c")
def summary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-row summary as JSON (S8), read back; writing it again is refused (S9)."""
    path = scratch_path(spark, "summary")
    summary = cohort(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    io.write_summary(summary, path)
    try:
        io.write_summary(summary, path)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.json(path).withColumn("refused", F.lit(refused))


@query(
    """WITH f AS (SELECT c_mktsegment AS part, string_agg(c_custkey || ',' || c_name || chr(10), '' ORDER BY c_custkey) AS body FROM customer GROUP BY 1)
    SELECT part, sha256(body) AS sha256, strlen(body)::BIGINT AS bytes FROM f"""
)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and size of files (S10): customers as one text file for each segment."""
    path = scratch_path(spark, "customers")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name").alias("value")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("part"), line)
    rows.repartition("part").sortWithinPartitions("part", "c_custkey").select("part", "value").write.partitionBy("part").text(path)
    return io.fingerprint(spark, [path]).select(F.regexp_extract("path", "part=([^/]+)", 1).alias("part"), "sha256", "bytes")


@query("WITH x AS (SELECT 1::BIGINT AS n WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 0)) SELECT 'files' AS kind, count(*) AS n FROM x")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose hash differs from a saved manifest (S10): one of two is written anew with fewer rows."""
    path = scratch_path(spark, "nations")
    nations = table(spark, sf_dir, "nation").select("n_regionkey", "n_name")
    for n in (0, 1):
        nations.coalesce(1).orderBy("n_name").write.option("header", True).csv(f"{path}/{n}")
    saved = io.fingerprint(spark, [path]).filter(~F.col("path").contains("_SUCCESS")).select(F.regexp_extract("path", "/([01])/", 1).alias("path"), "sha256")
    io.write_csv(saved, path + "-saved")
    nations.filter("n_regionkey <> 0").coalesce(1).orderBy("n_name").write.mode("overwrite").option("header", True).csv(f"{path}/1")
    now = io.fingerprint(spark, [path]).filter(~F.col("path").contains("_SUCCESS")).select(F.regexp_extract("path", "/([01])/", 1).alias("path"), "sha256")
    found = io.changed_files(now, io.read_csv(spark, path + "-saved", "path string, sha256 string"))
    return found.agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("kind"), "n")


@query("WITH x AS (SELECT r_name AS column, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(*) > 1) SELECT * FROM x")
def duplicate_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the header of a CSV file repeats; the header is the region of each nation."""
    path = scratch_path(spark, "header")
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named.agg(F.array_join(F.collect_list("r_name"), ",")).write.text(path)
    return io.duplicate_headers(spark, path)
