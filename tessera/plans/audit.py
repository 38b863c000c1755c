"""Queries: audits, reports, work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators.evidence import work_list as work_list_of
from tessera.plans.base import cohort, query, rounded, table
from tessera.sources.io import pending, progress


@query(
    """, e AS (SELECT l.label, l.y, n.entity, CASE WHEN lower(trim(n.key)) NOT IN ('', 'unknown', 'unmapped', 'none', 'nan', 'null', 'n/a') THEN lower(trim(n.key)) END AS key, c.year
      FROM c, LATERAL (VALUES ('label', label), ('label_b', label_b)) AS l(label, y), LATERAL (VALUES ('drug', drug), ('target', target), ('disease', disease)) AS n(entity, key)),
    v AS (SELECT *, CASE WHEN year <= 1999 THEN 'train' ELSE 'test' END AS role FROM e WHERE y IN (0, 1) AND year IS NOT NULL),
    k AS (SELECT DISTINCT label, entity, key FROM v WHERE role = 'train' AND key IS NOT NULL),
    f AS (SELECT v.*, k.key IS NOT NULL AS seen FROM v LEFT JOIN k USING (label, entity, key)),
    x AS (SELECT label, entity, count(*) FILTER (NOT y IN (0, 1)) AS excluded_invalid_label, count(*) FILTER (y IN (0, 1) AND year IS NULL) AS excluded_missing_year_with_valid_label FROM e GROUP BY ALL)
    SELECT label, entity, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test,
      count(*) FILTER (role = 'train' AND y = 1) AS train_positive, count(*) FILTER (role = 'test' AND y = 1) AS test_positive,
      count(*) FILTER (role = 'test' AND seen) AS test_seen, count(*) FILTER (role = 'test' AND key IS NOT NULL AND NOT seen) AS test_unseen,
      count(*) FILTER (role = 'test' AND key IS NULL) AS test_unknown,
      count(*) FILTER (role = 'test' AND key IS NOT NULL AND NOT seen AND y = 1) AS unseen_positive, count(*) FILTER (role = 'test' AND key IS NOT NULL AND NOT seen AND y = 0) AS unseen_negative,
      count(*) FILTER (role = 'test' AND seen) / count(*) FILTER (role = 'test') AS seen_fraction_all_test, any_value(excluded_invalid_label) AS excluded_invalid_label,
      any_value(excluded_missing_year_with_valid_label) AS excluded_missing_year_with_valid_label
    FROM f JOIN x USING (label, entity) GROUP BY label, entity"""
)
def entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.entity_overlap(cohort(spark, sf_dir), ["label", "label_b"], ["drug", "target", "disease"], "year", 1999)


@query(", l AS (SELECT 'label' AS label, label AS value, status FROM c UNION ALL SELECT 'label_b', label_b, status FROM c) SELECT label, value, status AS provenance, count(*) AS n FROM l GROUP BY ALL")
def label_provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.provenance_counts(cohort(spark, sf_dir), ["label", "label_b"], "status")


@query(
    """, f AS (SELECT (x1 IS NULL)::INT AS x1_missing, CASE WHEN x1 IS NOT NULL THEN (x3 IS NULL)::INT END AS x3_missing, (x4 > 0)::INT AS has_real_x4 FROM c),
    l AS (SELECT 'x1_missing' AS "column", x1_missing AS v FROM f UNION ALL SELECT 'x3_missing', x3_missing FROM f UNION ALL SELECT 'has_real_x4', has_real_x4 FROM f)
    SELECT "column", count(*) AS n, count(*) FILTER (v IS NULL) AS n_null, count(*) FILTER (v = 0) AS n_zero, count(*) FILTER (v = 1) AS n_one FROM l GROUP BY 1"""
)
def coverage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir)
    flags = c.select(F.col("x1").isNull().cast("int").alias("x1_missing"), F.when(F.col("x1").isNotNull(), F.col("x3").isNull().cast("int")).alias("x3_missing"), (F.col("x4") > 0).cast("int").alias("has_real_x4"))
    return A.coverage_flags(flags, flags.columns)


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, columns = cohort(spark, sf_dir), ["id", "label", "drug", "year"]
    later = c.filter("price > 60000").select(*columns).withColumn("label", F.when(F.col("id") % 13 == 0, 1 - F.col("label")).otherwise(F.col("label"))).withColumn("year", F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.col("year")))
    return c.filter("price < 300000").select(*columns), later


_SNAP = """, s AS (SELECT id, label AS label_a, CASE WHEN id % 13 = 0 THEN 1 - label ELSE label END AS label_b, drug AS drug_a, drug AS drug_b, year AS year_a, CASE WHEN id % 17 <> 0 THEN year END AS year_b
  FROM c WHERE price < 300000 AND price > 60000) """


@query(
    _SNAP
    + """SELECT 'label' AS field, count(*) AS common, count(*) FILTER (label_a IS DISTINCT FROM label_b) AS disagreements FROM s
    UNION ALL SELECT 'drug', count(*), count(*) FILTER (drug_a IS DISTINCT FROM drug_b) FROM s UNION ALL SELECT 'year', count(*), count(*) FILTER (year_a IS DISTINCT FROM year_b) FROM s"""
)
def snapshot_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.snapshot_comparison(*_snapshots(spark, sf_dir), "id", ["label", "drug", "year"])


@query(_SNAP + "SELECT id, label_a, label_b FROM s WHERE label_a IS DISTINCT FROM label_b")
def snapshot_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.snapshot_conflicts(*_snapshots(spark, sf_dir), "id", "label")


@query(" SELECT count(*) AS rows, 17 AS columns, count(DISTINCT id) AS distinct_ids, count(*) - count(DISTINCT id) AS repeated_ids, min(year) AS first_year, max(year) AS last_year, count(*) FILTER (label IS DISTINCT FROM label_b) AS label_disagreements FROM c")
def snapshot_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.snapshot_profile(cohort(spark, sf_dir), "id", "year", "label", "label_b")


@query(
    """ SELECT 'id' AS "column", 'cohort id' AS description, 'bigint' AS dtype, count(id) AS non_null, count(*) - count(id) AS missing, min(id)::VARCHAR AS example FROM c
    UNION ALL SELECT 'drug', 'segment', 'string', count(drug), count(*) - count(drug), min(drug) FROM c
    UNION ALL SELECT 'year', '', 'int', count(year), count(*) - count(year), min(year)::VARCHAR FROM c
    UNION ALL SELECT 'x1_big', '', 'boolean', count(x1), count(*) - count(x1), min(x1 > 2)::VARCHAR FROM c"""
)
def data_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir).select("id", "drug", "year", (F.col("x1") > 2).alias("x1_big"))
    return A.data_dictionary(c, {"id": "cohort id", "drug": "segment"})


@query(
    """, r AS (SELECT count(*)::DOUBLE AS rows, count(*) FILTER (year IS NULL)::DOUBLE AS missing_year, min(year)::DOUBLE AS first_year, max(year)::DOUBLE AS last_year,
      count(DISTINCT drug)::DOUBLE AS distinct_drug, count(DISTINCT target)::DOUBLE AS distinct_target,
      count(*) FILTER (label = 1)::DOUBLE AS label_positive, count(*) FILTER (label = 0)::DOUBLE AS label_negative, count(*) FILTER (label = -1)::DOUBLE AS label_indeterminate,
      round(count(*) FILTER (label = 1) / count(*) FILTER (label IN (0, 1)), 6) AS label_positive_rate, round(avg(CASE WHEN x1 IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS x1_missing_coverage FROM c)
    UNPIVOT r ON COLUMNS(*) INTO NAME metric VALUE value"""
)
def cohort_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir).withColumn("x1_missing", F.col("x1").isNull().cast("int"))
    return rounded(A.cohort_report(c, ["label"], ["drug", "target"], "year", ["x1_missing"]), "value")


@query(" SELECT year, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, count(*) AS total FROM c GROUP BY year")
def year_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.year_distribution(cohort(spark, sf_dir), "year", "label")


@query(" SELECT target, disease, label, false AS target_is_unknown, bool_or(coalesce(year > 1999, false)) AS appears_in_test_set, count(*) AS frequency_count FROM c WHERE drug = 'unmapped' GROUP BY target, disease, label")
def unmapped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir).withColumn("mapped", (F.col("drug") != "unmapped").cast("int"))
    return A.unmapped_report(c, ["target", "disease", "label"], "mapped", "target", F.col("year") > 1999)


@query(
    """ SELECT * FROM (SELECT id, label, p, 'false_positive' AS error_type FROM c WHERE label = 0 AND p >= 0.5 ORDER BY p DESC, id LIMIT 25)
    UNION ALL SELECT * FROM (SELECT id, label, p, 'false_negative' FROM c WHERE label = 1 AND p < 0.5 ORDER BY p, id LIMIT 25)"""
)
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.error_report(cohort(spark, sf_dir).select("id", "label", "p"), "label", "p", "id", 25)


@query(
    """, w AS (SELECT CASE WHEN label = 0 AND p >= 0.5 THEN 'false_positive' WHEN label = 1 AND p < 0.5 THEN 'false_negative' END AS error_type, target, disease FROM c),
    l AS (SELECT error_type, 'target' AS "column", target AS value FROM w WHERE error_type IS NOT NULL UNION ALL SELECT error_type, 'disease', disease FROM w WHERE error_type IS NOT NULL),
    g AS (SELECT error_type, "column", value, count(*) AS n FROM l GROUP BY ALL)
    SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY error_type, "column" ORDER BY n DESC, value) <= 3"""
)
def error_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.error_hotspots(cohort(spark, sf_dir), "label", "p", ["target", "disease"])


@query(" SELECT id, drug, target, p FROM c WHERE label = -1 ORDER BY p DESC, id LIMIT 100")
def ranked_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ranked_predictions(cohort(spark, sf_dir).filter("label = -1").select("id", "drug", "target", "p"), "p", "id", 100)


@query(
    """, h AS (SELECT id, x2, x3, x4, greatest(x2, x3, x4) AS hi, least(x2, x3, x4) AS lo FROM c)
    SELECT id, CASE WHEN x2 = hi THEN 'x2' WHEN x3 = hi THEN 'x3' WHEN x4 = hi THEN 'x4' END AS top_strength, CASE WHEN x2 = lo THEN 'x2' WHEN x3 = lo THEN 'x3' WHEN x4 = lo THEN 'x4' END AS top_risk FROM h"""
)
def top_strength_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).withColumns(A.strength_and_risk(["x2", "x3", "x4"])).select("id", "top_strength", "top_risk")


@query(
    """ SELECT count(*) FILTER (price > 100000 AND price < 200000) AS common, count(*) FILTER (price <= 100000) AS only_predictions, count(*) FILTER (price >= 200000) AS only_source,
    count(*) FILTER (price > 100000 AND price < 200000 AND id % 10 = 0) AS label_differs, 0 AS drug_differs FROM c"""
)
def prediction_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir)
    predictions = c.filter("price < 200000").withColumn("label", F.when(F.col("id") % 10 == 0, F.col("label") + 5).otherwise(F.col("label")))
    return A.prediction_identity(predictions, c.filter("price > 100000"), "id", ["label", "drug"])


@query(" SELECT target, count(*) AS n FROM c GROUP BY target ORDER BY n DESC, target LIMIT 10")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.value_counts(cohort(spark, sf_dir), "target", 10)


@query(" SELECT DISTINCT drug, disease FROM c WHERE drug <> 'unmapped'")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_list_of(cohort(spark, sf_dir), ["drug", "disease"])


def _journal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as attempts: a purchase completes its user's work, an error fails it."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed").otherwise("partial")
    journal = e.select(F.col("event_id").alias("seq"), (F.col("user_id") * 10 + F.pmod(F.col("event_id"), F.lit(7))).alias("key"), status.alias("status"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), journal


_J = """WITH j AS (SELECT event_id AS seq, user_id * 10 + event_id % 7 AS key, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'partial' END AS status FROM events),
  l AS (SELECT key, arg_max(status, seq) AS status FROM j GROUP BY key) """


@query(_J + "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT key FROM l WHERE status = 'complete')")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending(*_journal(spark, sf_dir), ["key"])


@query(
    _J
    + """, w AS (SELECT c_custkey AS key, status FROM customer LEFT JOIN l ON c_custkey = l.key), i AS (SELECT *, sum((status <> 'failed')::INT) OVER (ORDER BY seq) AS island FROM j)
    SELECT count(*) AS keys, count(status) AS attempted, count(*) FILTER (status = 'complete') AS complete, count(*) - count(*) FILTER (status = 'complete') AS pending,
    (SELECT count(*) FROM j) AS attempts, (SELECT max(n) FROM (SELECT count(*) AS n FROM i WHERE status = 'failed' GROUP BY island)) AS longest_failure_run FROM w"""
)
def progress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress(*_journal(spark, sf_dir), ["key"])
