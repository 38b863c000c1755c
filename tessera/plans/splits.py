"""Queries: splits, metrics, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bootstrap as B
from tessera.operators import metrics as E
from tessera.operators import splits as X
from tessera.plans.base import cohort, query, rounded

_WINDOWS = [(1996, 1996), (1997, 1997), (1998, 1999)]


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).filter("label >= 0")


@query(" SELECT id, CASE WHEN year <= 1999 THEN 'train' WHEN year > 1999 THEN 'test' END AS role FROM c")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).select("id", X.temporal_role(F.col("year"), 1999).alias("role"))


_FOLDS = ", w(fold, a, b) AS (VALUES (0, 1996, 1996), (1, 1997, 1997), (2, 1998, 1999)), m AS (SELECT 'temporal' AS mode, fold, CASE WHEN year < a THEN 'train' ELSE 'validation' END AS role, id FROM c JOIN w ON year <= b WHERE label >= 0) "


@query(_FOLDS + "SELECT * FROM m")
def rolling_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.expanding_folds(_known(spark, sf_dir), "id", "year", _WINDOWS)


#: Windows of which the first has one year to train on and the last is past the end; parts by priority lack a class or rows.
_GUARDED = """, w(fold, a, b) AS (VALUES (0, 1993, 1993), (1, 1996, 1997), (2, 1998, 1999)), k AS (SELECT id, year, label FROM c WHERE label >= 0 AND price > 250000 AND (label = 0 OR year > 1993 OR price > 500000)),
  m AS (SELECT 'temporal' AS mode, fold, CASE WHEN year < a THEN 'train' ELSE 'validation' END AS role, id, label FROM k JOIN w ON year <= b) """


@query(_GUARDED + "SELECT mode, fold, role, count(*) AS n, count(DISTINCT label) AS classes FROM m GROUP BY ALL HAVING count(*) < 1000 OR count(DISTINCT label) < 2")
def fold_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _known(spark, sf_dir).filter("price > 250000 AND (label = 0 OR year > 1993 OR price > 500000)")
    return X.fold_guard(X.expanding_folds(c, "id", "year", [(1993, 1993), (1996, 1997), (1998, 1999)]), c, "id", "label", 1000)


@query(" SELECT id, label, ((row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5('f:' || id::VARCHAR), 1, 8))::BIGINT, id) - 1) % 5)::INT AS fold FROM c WHERE label >= 0")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.stratified_folds(_known(spark, sf_dir), "id", "label", 5, "f")


@query(
    """, g AS (SELECT customer, count(*) AS n, (sum(label) * 2 > count(*))::INT AS stratum FROM c WHERE label >= 0 GROUP BY customer),
    o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n DESC, ('0x' || substr(md5('g:' || customer::VARCHAR), 1, 8))::BIGINT, customer) - 1 AS i FROM g)
    SELECT customer, stratum, n, (CASE WHEN (i // 3) % 2 = 0 THEN i % 3 ELSE 2 - i % 3 END)::INT AS fold FROM o"""
)
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.group_folds(_known(spark, sf_dir), "customer", "label", 3, "g")


@query()
def stratified_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.stratified_group_folds(_known(spark, sf_dir), "customer", "label", 3, "g")


@query(", s AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS i, count(*) OVER () AS n FROM c WHERE year IS NOT NULL) SELECT DISTINCT year AS boundary FROM s WHERE i = n // 2 OR i = 3 * n // 4")
def inner_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.inner_boundaries(cohort(spark, sf_dir), "year")


@query(", y AS (SELECT max(year) AS y FROM c) SELECT id, CASE WHEN year >= y THEN 'validation' ELSE 'train' END AS role FROM c, y")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chronological_split(cohort(spark, sf_dir), "id", "year", "label").select("id", "role")


@query(
    """, t AS (SELECT 'any' AS ids, 'NCT' || id AS id, label FROM c WHERE label >= 0 UNION ALL SELECT 'by class', label || 'NCT' || id, label FROM c WHERE label >= 0),
    f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY ids ORDER BY id) <= 200), k AS (SELECT ids, count(DISTINCT label) AS k FROM f GROUP BY ids),
    h AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY ids, label ORDER BY id) <= 100)
    SELECT f.* FROM f JOIN k USING (ids) WHERE k > 1 UNION ALL SELECT h.* FROM h JOIN k USING (ids) WHERE k = 1"""
)
def class_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _known(spark, sf_dir)
    kinds = {"any": F.concat(F.lit("NCT"), F.col("id").cast("string")), "by class": F.concat(F.col("label").cast("string"), F.lit("NCT"), F.col("id").cast("string"))}
    a, b = (X.class_limit(c.select(F.lit(k).alias("ids"), i.alias("id"), "label"), "id", "label", 200) for k, i in kinds.items())
    return a.unionByName(b)


_SAMPLE = """, h AS (SELECT id, label, drug, ('0x' || substr(md5('r:' || id::VARCHAR), 1, 8))::BIGINT AS h FROM c), f AS (SELECT id, label, drug FROM h QUALIFY row_number() OVER (PARTITION BY label, drug ORDER BY h, id) <= 20),
    r AS (SELECT id, label, drug FROM h WHERE id NOT IN (SELECT id FROM f) ORDER BY h, id LIMIT greatest(0, (SELECT 500 - count(*) FROM f))) """


@query(
    _SAMPLE + "SELECT * FROM f UNION ALL SELECT * FROM r"
)
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.review_sample(cohort(spark, sf_dir).select("id", "label", "drug"), "id", ["label", "drug"], 20, 500, "r")


@query(_SAMPLE + "SELECT id, drug, 'https://example.org/' || id AS url, '' AS reviewer, '' AS verdict FROM (SELECT * FROM f UNION ALL SELECT * FROM r)")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.review_queue(review_sample(spark, sf_dir), ["label"], "id", "https://example.org/", ["reviewer", "verdict"])[0]


@query(_SAMPLE + "SELECT id, label FROM f UNION ALL SELECT id, label FROM r")
def review_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.review_queue(review_sample(spark, sf_dir), ["label"], "id", "https://example.org/", ["reviewer", "verdict"])[1]


@query(" SELECT id, label, CASE WHEN drug = 'unmapped' THEN 'unknown' ELSE lower(drug) END AS drug, lower(target) AS target, CASE WHEN drug = 'unmapped' THEN 'unknown' ELSE lower(drug) END || ' | ' || lower(target) AS pair FROM c WHERE year <= 1999 AND label >= 0")
def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir).select("id", "year", "label", "drug", "target")
    return X.training_frame(c, "id", "year", "label", 1999, ["drug", "target"]).drop("year")


@query(
    """, m AS (SELECT id, customer, year, price, CASE WHEN year <= 1998 OR id % 1000 = 0 THEN 'train' ELSE 'validation' END AS role FROM c WHERE year IS NOT NULL), g AS (SELECT customer FROM m GROUP BY 1 HAVING count(DISTINCT role) > 1)
    SELECT 'temporal' AS mode, 0 AS fold, 'groups overlap' AS problem, count(*) AS n FROM g
    UNION ALL SELECT 'temporal', 0, 'years overlap', 1 WHERE (SELECT max(year) FROM m WHERE role = 'train') >= (SELECT min(year) FROM m WHERE role = 'validation')
    UNION ALL SELECT 'temporal', 0, 'unknown id', 1 UNION ALL SELECT 'temporal', 0, 'held-out rows used', count(*) FROM m WHERE price > 450000 HAVING count(*) > 0
    UNION ALL SELECT 'temporal', 0, 'outside the outer train rows', 1 + count(*) FROM m WHERE year > 1999 AND id % 1000 <> 0"""
)
def split_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir)
    role = F.when((F.col("year") <= 1998) | (F.col("id") % 1000 == 0), "train").otherwise("validation")
    m = c.filter("year IS NOT NULL").select(F.lit("temporal").alias("mode"), F.lit(0).alias("fold"), role.alias("role"), "id")
    odd = spark.createDataFrame([("temporal", 0, "train", -1)], "mode string, fold int, role string, id long")
    late = c.filter("year <= 1998 OR id % 1000 = 0 OR year = 1999").select("id")
    return X.violations(m.unionByName(odd), c.select("id", "customer", "year"), "id", "year", "customer", c.filter("price > 450000"), late)


@query(" SELECT DISTINCT customer FROM c WHERE year <= 1995 INTERSECT SELECT DISTINCT customer FROM c WHERE year > 1999")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir)
    return X.split_overlap(c.filter("year <= 1995"), c.filter("year > 1999"), "customer")


def _auc(score: str, by: str, where: str = "label >= 0", src: str = "c") -> str:
    g = f"{by}, " if by else ""
    return f"""h AS (SELECT {g}{score} AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {src} WHERE {where} GROUP BY ALL),
    u AS (SELECT *, sum(neg) OVER ({f"PARTITION BY {by}" if by else ""} ORDER BY s) - neg / 2 AS below, sum(pos) OVER ({f"PARTITION BY {by}" if by else ""} ORDER BY s DESC) AS tp, sum(neg) OVER ({f"PARTITION BY {by}" if by else ""} ORDER BY s DESC) AS fp FROM h),
    a AS (SELECT {g}sum(pos * below) / (sum(pos) * sum(neg)) AS auc, sum(pos * tp / (tp + fp)) / sum(pos) AS ap FROM u {f"GROUP BY {by}" if by else ""})"""


@query(f", {_auc('p', '')} SELECT round(auc, 9) AS auc FROM a")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.roc_auc(_known(spark, sf_dir), "label", "p"), "auc", digits=9)


@query(f", {_auc('p', 'disease')} SELECT disease, round(ap, 9) AS average_precision FROM a")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.average_precision(_known(spark, sf_dir), "label", "p", ["disease"]), "average_precision", digits=9)


_BUNDLE = """count(*) AS n, count(*) FILTER (label = 1) AS positives, round(avg((p - label) * (p - label)), 6) AS brier,
    round(2 * count(*) FILTER (label = 1 AND p >= 0.5) / (2 * count(*) FILTER (label = 1 AND p >= 0.5) + count(*) FILTER (label = 0 AND p >= 0.5) + count(*) FILTER (label = 1 AND p < 0.5)), 6) AS f1,
    round((count(*) FILTER (label = 1 AND p >= 0.5) / count(*) FILTER (label = 1) + count(*) FILTER (label = 0 AND p < 0.5) / count(*) FILTER (label = 0)) / 2, 6) AS balanced_accuracy"""


@query(f", {_auc('p', 'target')}, b AS (SELECT target, {_BUNDLE} FROM c WHERE label >= 0 GROUP BY target) SELECT b.*, round(auc, 6) AS roc_auc, round(ap, 6) AS pr_auc FROM b JOIN a USING (target)")
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metric_bundle(_known(spark, sf_dir), "label", "p", ["target"])


@query(" SELECT label, (p >= 0.5)::INT AS predicted, count(*) AS n FROM c WHERE label >= 0 GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_known(spark, sf_dir), "label", "p")


@query(" SELECT greatest(1, least(10, ceil(q * 10)))::INT AS bin, count(*) AS n, round(avg(q), 9) AS mean_score, round(avg(label), 9) AS positive_rate FROM c WHERE label >= 0 GROUP BY 1")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.calibration(_known(spark, sf_dir), "label", "q"), "mean_score", "positive_rate", digits=9)


@query(f", {_auc('p', '')} SELECT s AS threshold, round(fp / sum(neg) OVER (), 9) AS fpr, round(tp / sum(pos) OVER (), 9) AS tpr FROM u")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.roc_points(_known(spark, sf_dir), "label", "p"), "fpr", "tpr", digits=9)


@query(f", {_auc('p', '')} SELECT s AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / sum(pos) OVER (), 9) AS recall FROM u")
def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.pr_points(_known(spark, sf_dir), "label", "p"), "precision", "recall", digits=9)


@query(f", {_auc('q', 'region')} SELECT region, round(auc, 9) AS auc, round(1 - auc, 9) AS reversed_auc FROM a")
def reversed_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.reversed_auc(_known(spark, sf_dir), "label", "q", ["region"]), "auc", "reversed_auc", digits=9)


@query(
    f""", g AS (SELECT 'drug' AS subgroup, drug AS value, label, p FROM c WHERE label >= 0 UNION ALL SELECT 'year', coalesce(year::VARCHAR, 'unknown'), label, p FROM c WHERE label >= 0),
    z AS (SELECT subgroup, CASE WHEN count(*) OVER (PARTITION BY subgroup, value) < 200 THEN 'other' ELSE value END AS value, label, p FROM g),
    {_auc('p', 'subgroup, value', src='z')}, b AS (SELECT subgroup, value, {_BUNDLE} FROM z GROUP BY ALL) SELECT b.*, round(auc, 6) AS roc_auc, round(ap, 6) AS pr_auc FROM b JOIN a USING (subgroup, value) WHERE n >= 20"""
)
def subgroup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.subgroup_metrics(_known(spark, sf_dir), "label", "p", ["drug", "year"], pool=200)


def _fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _known(spark, sf_dir).withColumn("fold", F.col("customer") % 5)
    p = E.metric_bundle(c, "label", "p", ["fold"]).withColumn("candidate", F.lit("p"))
    return p.unionByName(E.metric_bundle(c, "label", "q", ["fold"]).withColumn("candidate", F.lit("q")))


_FS = f""", f AS (SELECT *, customer % 5 AS fold FROM c WHERE label >= 0), hp AS (SELECT fold, 'p' AS k, p AS s, label FROM f UNION ALL SELECT fold, 'q', q, label FROM f),
  {_auc('s', 'fold, k', src='hp')}, x AS (SELECT fold, k AS candidate, round(auc, 6) AS roc_auc FROM a), y AS (SELECT fold, k AS candidate, round(avg((s - label) * (s - label)), 6) AS brier FROM hp GROUP BY ALL) """


@query(_FS + "SELECT candidate, round(avg(roc_auc), 6) AS mean_auc, round(stddev_samp(roc_auc), 6) AS sd_auc, round(avg(brier), 6) AS mean_brier, round(stddev_samp(brier), 6) AS sd_brier FROM x JOIN y USING (fold, candidate) GROUP BY 1")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.fold_summary(_fold_scores(spark, sf_dir), ["candidate"], {"roc_auc": "auc", "brier": "brier"}), "mean_auc", "sd_auc", "mean_brier", "sd_brier")


@query(_FS + "SELECT x.fold, x.candidate, x.roc_auc, r.roc_auc AS reference_roc_auc, round(x.roc_auc - r.roc_auc, 6) AS roc_auc_difference FROM x JOIN x r ON x.fold = r.fold AND r.candidate = 'q'")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.paired_delta(_fold_scores(spark, sf_dir), "q", ["fold"], "candidate", "roc_auc")
    return rounded(out.select("fold", "candidate", "roc_auc", "reference_roc_auc", "roc_auc_difference"), "roc_auc_difference")


R = 2000
_DRAWS = f""", cl AS (SELECT target, row_number() OVER (ORDER BY ('0x' || substr(md5('order:' || target), 1, 8))::BIGINT, target) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT target FROM c WHERE label >= 0)),
  dr AS (SELECT r, ('0x' || substr(md5('boot:' || r || ':' || j), 1, 8))::BIGINT % 25 + 1 AS i FROM range({R}) a(r), range(25) b(j)), ti AS (SELECT r, i, count(*) AS times FROM dr GROUP BY ALL),
  dw AS (SELECT r, target, times FROM ti JOIN cl USING (i)) """


def _boot(src: str, by: str, score: str = "p") -> str:
    return f"""h AS (SELECT {by}, {score} AS s, sum(times) FILTER (label = 1) AS pos, sum(times) FILTER (label = 0) AS neg FROM {src} JOIN dw USING (target) WHERE label >= 0 GROUP BY ALL),
    h2 AS (SELECT * REPLACE (coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg) FROM h), u AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY s) - neg / 2 AS below FROM h2), a AS (SELECT {by}, sum(pos * below) / (sum(pos) * sum(neg)) AS auc FROM u GROUP BY {by})"""


@query(
    _DRAWS
    + f", {_boot('c', 'r')}, iv AS (SELECT round(quantile_cont(auc, 0.025), 9) AS ci_low, round(quantile_cont(auc, 0.975), 9) AS ci_high, count(auc) AS valid_replicates, {R} AS repeats FROM a), "
    + _auc("p", "").replace("h AS", "h0 AS").replace("FROM h)", "FROM h0)").replace("u AS", "u0 AS").replace("FROM u ", "FROM u0 ").replace("a AS", "a0 AS")
    + " SELECT (SELECT count(*) FROM c WHERE label >= 0) AS n, (SELECT count(*) FROM c WHERE label = 1) AS positives, (SELECT round(auc, 9) FROM a0) AS auc, iv.* FROM iv"
)
def bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.bootstrap_auc(_known(spark, sf_dir), "label", "p", "target", R), "auc", "ci_low", "ci_high", digits=9)


@query(
    _DRAWS
    + f""", two AS (SELECT target, label, 'p' AS which, p AS x FROM c WHERE label >= 0 UNION ALL SELECT target, label, 'q', q FROM c WHERE label >= 0), {_boot('two', 'r, which', 'x')},
    w AS (SELECT r, max(auc) FILTER (which = 'p') AS p, max(auc) FILTER (which = 'q') AS q FROM a GROUP BY r), l AS (SELECT 'p' AS which, p AS v FROM w UNION ALL SELECT 'q', q FROM w UNION ALL SELECT 'difference', p - q FROM w)
    SELECT which, round(quantile_cont(v, 0.025), 9) AS ci_low, round(quantile_cont(v, 0.975), 9) AS ci_high, count(v) AS valid_replicates, {R} AS repeats FROM l GROUP BY which"""
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.paired_bootstrap(_known(spark, sf_dir), "label", "p", "q", "target", R), "ci_low", "ci_high", digits=9)


_FB = (
    _DRAWS
    + f""", two AS (SELECT target, label, customer % 3 AS fold, 'p' AS which, p AS x FROM c WHERE label >= 0 UNION ALL SELECT target, label, customer % 3, 'q', q FROM c WHERE label >= 0), {_boot('two', 'r, fold, which', 'x')},
    w AS (SELECT r, fold, max(auc) FILTER (which = 'p') - max(auc) FILTER (which = 'q') AS d FROM a GROUP BY ALL), m AS (SELECT r, avg(d) AS v, count(d) AS got FROM w GROUP BY r),
    iv AS (SELECT round(quantile_cont(v, 0.025), 9) AS ci_low, round(quantile_cont(v, 0.975), 9) AS ci_high, count(v) AS valid_replicates, {R} AS repeats FROM m WHERE got = 3)"""
)


@query(_FB + " SELECT * FROM iv")
def fold_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _known(spark, sf_dir).withColumn("fold", F.col("customer") % 3)
    return rounded(B.fold_bootstrap(c, "label", "p", "q", "fold", "target", R), "ci_low", "ci_high", digits=9)


@query(
    _FB
    + """, bs AS (SELECT avg((p - label) * (p - label)) - avg((q - label) * (q - label)) AS b FROM c WHERE label >= 0), f AS (SELECT (SELECT avg(v) FROM m WHERE got = 3) AS d, ci_low, b FROM iv, bs)
    SELECT count(*) AS modes, count(*) FILTER (d >= 0.05 AND ci_low > 0 AND b <= 0) AS modes_passed, bool_and(d >= 0.05 AND ci_low > 0 AND b <= 0) AS accepted FROM f"""
)
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _known(spark, sf_dir).withColumn("fold", F.col("customer") % 3)
    interval = B.fold_bootstrap(c, "label", "p", "q", "fold", "target", R)
    auc = E.roc_auc(c, "label", "p", ["fold"]).join(E.roc_auc(c, "label", "q", ["fold"]).withColumnRenamed("auc", "ref"), "fold")
    gain = auc.agg(F.avg(F.col("auc") - F.col("ref")).alias("mean_difference"))
    worse = c.agg((F.avg((F.col("p") - F.col("label")) ** 2) - F.avg((F.col("q") - F.col("label")) ** 2)).alias("brier_difference"))
    return B.gate(interval.crossJoin(gain).crossJoin(worse))  # one row each
