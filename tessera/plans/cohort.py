"""Queries: nested ingest, filters, text matching, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import entity_key, hash_order, leading_year, number, pair_key
from tessera.operators import cohort as P
from tessera.operators import labels as L
from tessera.operators import match as M
from tessera.operators import text as T
from tessera.operators.evidence import list_join
from tessera.plans.base import cohort, query, rounded, table
from tessera.sources.scratch import written
from tessera.sources.io import studies_of_columns


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as nested study records."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "DRUG").when(F.col("l_returnflag") == "N", "Biological").otherwise("OTHER")
    item = F.struct(F.col("l_linenumber").alias("n"), kind.alias("type"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"), F.col("l_quantity").cast("int").cast("string").alias("q"))
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    j = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    return studies_of_columns(
        j,
        id_=F.col("o_orderkey").cast("string"),
        official=F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("official "), F.col("o_orderkey").cast("string"))),
        brief=F.concat(F.lit("brief "), F.col("o_orderkey").cast("string")),
        status=F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "TERMINATED"),
        start=F.date_format("o_orderdate", "yyyy-MM-dd"),
        phases=F.array(F.when(F.col("o_totalprice") > 100000, "PHASE2").otherwise("PHASE3")),
        conditions=F.array("o_orderpriority", "o_orderstatus"),
        interventions=F.transform("items", lambda x: F.struct(x["type"].alias("type"), x["name"].alias("name"), F.lit(None).cast("string").alias("description"))),
        outcomes=F.transform("items", lambda x: F.struct(F.concat(F.lit("m"), x["q"]).alias("measure"), F.lit(None).cast("string").alias("description"), F.lit("day").alias("timeFrame"))),
        eligibility=F.concat(F.lit("age\\n"), F.col("o_orderpriority")),
    )


_ITEMS = """WITH i AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'DRUG' WHEN 'N' THEN 'Biological' ELSE 'OTHER' END AS type, 'part ' || l_partkey AS name, l_quantity::INT AS q FROM lineitem),
  g AS (SELECT id, string_agg(name, '|' ORDER BY n, type, name) FILTER (type <> 'OTHER') AS names, string_agg('m' || q || '  day', '|' ORDER BY n, type, name, q::VARCHAR) AS outcomes,
    string_agg(name, ' ; ' ORDER BY n, type, name) FILTER (type = 'DRUG') AS drugs FROM i GROUP BY id) """


@query(
    _ITEMS
    + """SELECT o_orderkey::VARCHAR AS nct_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'official ' ELSE 'brief ' END || o_orderkey AS title,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'TERMINATED' ELSE '' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS start_date, 'PHASE2' AS phase,
    o_orderpriority || '|' || o_orderstatus AS condition, names AS intervention_names, outcomes AS primary_outcomes, year(o_orderdate)::INT AS start_year
    FROM orders JOIN g ON o_orderkey = id WHERE o_totalprice > 100000 AND names IS NOT NULL"""
)
def nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.flatten_studies(studies(spark, sf_dir)).drop("why_stopped", "results_first_posted", "brief_summary", "eligibility")


@query(
    _ITEMS
    + """SELECT o_orderkey::VARCHAR AS nct_id, o_orderpriority || ' ; ' || o_orderstatus || coalesce(' ; ' || drugs, '') AS structured_text, 'age ' || o_orderpriority AS eligibility_text,
    o_orderpriority || ' ; ' || o_orderstatus || coalesce(' ; ' || drugs, '') || ' ; age ' || o_orderpriority AS protocol_text, 0 AS protocol_missing FROM orders LEFT JOIN g ON o_orderkey = id"""
)
def protocol_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.protocol_text(studies(spark, sf_dir))


@query("WITH d AS (SELECT * FROM documents) SELECT doc_id, lang FROM d WHERE contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'password') OR contains(lower(coalesce(text, '')), 'worthless')")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keep_keywords(table(spark, sf_dir, "documents"), "text", ["license", "password", "worthless"]).select("doc_id", "lang")


@query(" SELECT id, drug FROM c WHERE drug NOT IN ('unmapped', 'BUILDING')")
def known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keep_known(cohort(spark, sf_dir), "drug", exclude=["building"]).select("id", "drug")


@query(" SELECT id, label FROM c WHERE label IN (0, 1)")
def determinate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keep_determinate(cohort(spark, sf_dir), "label").select("id", "label")


@query(" SELECT id, x2, p, (x1 IS NULL)::INT AS x1_missing FROM c")
def column_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir).withColumn("x1_missing", F.col("x1").isNull().cast("int"))
    return P.select_features(c, ["id", "x2", "p", "absent"], ["_missing"])


@query(" SELECT id, x1, x2 + 1 AS x2_new FROM c")
def column_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir)
    fresh = c.select("id", F.lit(0.0).alias("x1"), (F.col("x2") + 1).alias("x2_new"))
    return P.add_new_columns(c.select("id", "x1"), fresh, "id")


@query(" SELECT id, coalesce(x1, -1) AS x1, coalesce(x3, -1) AS x3, CASE WHEN id % 5 = 0 THEN -1.0 ELSE x4 END AS x4, -1.0::DOUBLE AS absent FROM c")
def align_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("id") % 10 == 0, float("nan")).when(F.col("id") % 5 == 0, float("inf")).otherwise(F.col("x4"))
    return P.align(cohort(spark, sf_dir).withColumn("x4", bad), ["x1", "x3", "x4", "absent"], keep=["id"])


@query("WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y') WHEN 2 THEN 'n/a' END AS s FROM events) SELECT event_id, TRY_CAST(left(s, 4) AS INT) AS year FROM d")
def leading_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    s = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.date_format("ts", "yyyy")).when(k == 2, "n/a")
    return table(spark, sf_dir, "events").select("event_id", leading_year(s).alias("year"))


@query(
    """ SELECT 'mapped' AS subset, count(*) AS n, count(*) FILTER (label = 1) AS positives FROM c WHERE drug <> 'unmapped' UNION ALL SELECT 'has_x1', count(*), count(*) FILTER (label = 1) FROM c WHERE x1 IS NOT NULL
    UNION ALL SELECT 'high_p', count(*), count(*) FILTER (label = 1) FROM c WHERE p > 0.9"""
)
def subset_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.subset_counts(cohort(spark, sf_dir), {"mapped": F.col("drug") != "unmapped", "has_x1": F.col("x1").isNotNull(), "high_p": F.col("p") > 0.9}, "label")


@query("WITH d AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN value::VARCHAR WHEN 1 THEN 'none' END AS s FROM events) SELECT event_id, coalesce(TRY_CAST(s AS DOUBLE), 0.5) AS value FROM d")
def numeric_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    s = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "none")
    return table(spark, sf_dir, "events").select("event_id", number(s, 0.5).alias("value"))


_WORDS = ["bolt", "hot", "gear", "red", "small ring", "ring"]
_FIRST = "CASE " + " ".join(f"WHEN contains(lower(p_name), '{w}') THEN '{w}'" for w in _WORDS) + " END"
_LONGEST = "CASE " + " ".join(f"WHEN contains(lower(p_name), '{w}') THEN '{w}'" for w in sorted(_WORDS, key=lambda w: -len(w))) + " ELSE 'nos' END"


@query(f"WITH x AS (SELECT p_partkey, {_FIRST} AS entity FROM part) SELECT * FROM x")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", M.first_match(F.col("p_name"), _WORDS).alias("entity"))


@query(f"WITH x AS (SELECT p_partkey, {_LONGEST} AS entity FROM part) SELECT * FROM x")
def longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", M.longest_match(F.col("p_name"), _WORDS, default="nos").alias("entity"))


@query(f"WITH x AS (SELECT p_partkey, {_FIRST} AS value FROM part) SELECT * FROM x")
def match_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(i, w, w) for i, w in enumerate(_WORDS)], "pos int, pattern string, value string")
    return M.match_table(table(spark, sf_dir, "part"), "p_partkey", F.col("p_name"), words)


_WORDS_OF_ITEMS = """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS k FROM benchmark), d AS (SELECT k, row_number() OVER (ORDER BY md5(k), k) AS pos FROM w),
    h AS (SELECT doc_id, k, pos FROM documents JOIN d ON contains(lower(text), k))"""


def _words_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, pattern, value) of the words of the benchmark, some thousands, in an order of their own."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("pattern")).distinct()
    return written(words.select(F.struct(F.md5("pattern"), F.col("pattern")).alias("pos"), "pattern", F.col("pattern").alias("value")))


@query(_WORDS_OF_ITEMS + " SELECT documents.doc_id, first, longest FROM documents LEFT JOIN (SELECT doc_id, arg_min(k, pos) AS first, arg_min(k, (-length(k), pos)) AS longest FROM h GROUP BY doc_id) USING (doc_id)")
def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the longest entry of a large dictionary that each document contains (J6, J7)."""
    docs, words = table(spark, sf_dir, "documents"), _words_of_items(spark, sf_dir)
    first = M.match_table(docs, "doc_id", "text", words).withColumnRenamed("value", "first")
    return first.join(M.match_table(docs, "doc_id", "text", words, longest=True).withColumnRenamed("value", "longest"), "doc_id")


@query(_WORDS_OF_ITEMS + " SELECT k AS pattern, count(*) AS n FROM h GROUP BY k")
def dictionary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents contain each entry of a large dictionary, of those that any contains."""
    docs = table(spark, sf_dir, "documents").select(F.lower("text").alias("_t"))
    return M.containing(docs, "_t", _words_of_items(spark, sf_dir).select("pattern"), "pattern").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH r(p_type, pos, k, s) AS (VALUES ('ECONOMY', 0, 'ring', 0.9), ('ECONOMY', 1, 'small', 0.7), ('SMALL', 0, 'bolt', 0.6), ('PROMO', 0, 'red', 0.4)),
    h AS (SELECT p_partkey, arg_min(s, pos) AS s FROM part JOIN r USING (p_type) WHERE contains(lower(p_name), k) GROUP BY 1)
    SELECT p_partkey, coalesce(s, 0.1)::DOUBLE AS score FROM part LEFT JOIN h USING (p_partkey)"""
)
def mixed_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("ECONOMY", 0, "ring", 0.9), ("ECONOMY", 1, "small", 0.7), ("SMALL", 0, "bolt", 0.6), ("PROMO", 0, "red", 0.4)], "p_type string, pos int, keyword string, score double")
    return M.mixed_match(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name"), rules, "p_type", "p_name", "score", 0.1).select("p_partkey", "score")


@query("WITH x AS (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'hot') WHEN 'LARGE' THEN contains(lower(p_name), 'gear') ELSE false END AS approved FROM part) SELECT * FROM x")
def list_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    approvals = spark.createDataFrame([("SMALL", ["ring", "hot"]), ("LARGE", ["gear"])], "p_type string, items array<string>")
    return M.list_exists(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name"), approvals, "p_type", "p_name", "approved").select("p_partkey", "approved")


@query("WITH x AS (SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'PROMO') THEN 1.0 WHEN p_type = 'LARGE' THEN 0.5 ELSE 0.0 END::DOUBLE AS tier FROM part) SELECT * FROM x")
def tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", M.tier_score(F.col("p_type"), ["SMALL", "PROMO"], ["LARGE"]).alias("tier"))


@query(
    """WITH dict(pos, pattern, canonical) AS (VALUES (0, 'ring', 'RING'), (1, 'red widget', 'WIDGET'), (2, 'bolt', 'BOLT')), n AS (SELECT p_partkey, 0 AS i, lower(p_type) AS name FROM part UNION ALL SELECT p_partkey, 1, lower(p_name) FROM part),
    h AS (SELECT p_partkey, i, (name <> pattern)::INT AS tier, pos, canonical FROM n JOIN dict ON contains(name, pattern) OR contains(pattern, name)),
    b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY i, tier, pos) = 1)
    SELECT p_partkey, coalesce(canonical, 'unmapped') AS canonical, CASE tier WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 ELSE 0.10 END::DOUBLE AS confidence FROM part LEFT JOIN b USING (p_partkey)"""
)
def canonical_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(0, "ring", "RING"), (1, "red widget", "WIDGET"), (2, "bolt", "BOLT")], "pos int, pattern string, canonical string")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.array("p_type", "p_name").alias("names"))
    return M.canonical_list(parts, "p_partkey", "names", words)


@query(
    """WITH x AS (SELECT p_partkey, CASE WHEN contains(lower(p_name), 'gear') THEN 'gear' WHEN contains(lower(p_name), 'ring') THEN 'ring' ELSE 'unmapped' END AS drug FROM part)
    SELECT p_partkey, drug, CASE drug WHEN 'gear' THEN 'T1' WHEN 'ring' THEN 'T2' ELSE 'UNKNOWN' END AS target, CASE drug WHEN 'gear' THEN 'antibody' WHEN 'ring' THEN 'small_molecule' ELSE 'unknown' END AS modality, (drug <> 'unmapped')::INT AS mapped FROM x"""
)
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", M.canonical_text(F.col("p_name"), [("gear", "T1", "antibody"), ("ring", "T2", "small_molecule")]).alias("x")).select("p_partkey", "x.*")


@query("WITH x AS (SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'RED' WHEN contains(lower(p_name), 'bolt') THEN 'BOLT' ELSE 'NOS' END AS value, CASE WHEN contains(lower(p_name), 'red') THEN 0.9 WHEN contains(lower(p_name), 'bolt') THEN 0.8 ELSE 0.2 END::DOUBLE AS confidence FROM part) SELECT * FROM x")
def priority_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", M.priority_match(F.col("p_name"), [("red", "RED", 0.9), ("bolt", "BOLT", 0.8)], ("NOS", 0.2)).alias("x")).select("p_partkey", "x.*")


@query("WITH x AS (SELECT doc_id, CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'legal' WHEN contains(lower(text), 'token') THEN 'secret' END AS tag, (contains(lower(text), 'trash') OR contains(lower(text), 'stupid'))::INT AS flag FROM documents) SELECT * FROM x")
def tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = M.first_match(F.col("text"), ["license", "copyright", "token"], ["legal", "legal", "secret"])
    return table(spark, sf_dir, "documents").select("doc_id", tag.alias("tag"), M.any_indicator(F.col("text"), ["trash", "stupid"]).alias("flag"))


_ENDPOINTS = ["", "Overall survival", "OS at dose", "median os", "PFS by review", "time to progression", "ORR", "complete response", "biomarker", "cost", "dose of pfs", "mortality"]


@query(
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, lower({_ENDPOINTS}[l_partkey % {len(_ENDPOINTS)} + 1]) AS t FROM lineitem),
    y AS (SELECT *, CASE WHEN trim(t) = '' THEN NULL WHEN regexp_matches(t, 'overall survival|mortality|time to death') OR (regexp_matches(t, '\\bos\\b') AND NOT regexp_matches(t, '\\bdose\\b')) THEN 'survival'
      WHEN regexp_matches(t, 'progression.free|time to progression|\\bpfs\\b') THEN 'pfs'
      WHEN regexp_matches(t, 'response rate|objective response|complete response|partial response|disease control rate|clinical benefit rate|\\borr\\b') THEN 'response'
      WHEN regexp_matches(t, 'biomarker|expression|mutation') THEN 'biomarker' ELSE 'other' END AS endpoint FROM x)
    SELECT endpoint, CASE endpoint WHEN 'survival' THEN 0 WHEN 'pfs' THEN 1 WHEN 'response' THEN 2 WHEN 'biomarker' THEN 3 WHEN 'other' THEN 4 ELSE -1 END AS code,
    CASE WHEN regexp_matches(t, 'overall survival|os |death') THEN 'survival' WHEN regexp_matches(t, 'progression|pfs') THEN 'pfs' WHEN regexp_matches(t, 'response|orr') THEN 'response' WHEN regexp_matches(t, 'biomarker|expression|mutation') THEN 'biomarker' ELSE 'other' END AS title_endpoint,
    count(*) AS n FROM y GROUP BY ALL"""
)
def endpoint_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, _ENDPOINTS)), (F.col("l_partkey") % len(_ENDPOINTS) + 1).cast("int"))
    kinds = table(spark, sf_dir, "lineitem").select(T.endpoint_class(text).alias("endpoint"), T.result_endpoint(text).alias("title_endpoint"))
    return kinds.withColumn("code", T.endpoint_code(F.col("endpoint"))).groupBy("endpoint", "code", "title_endpoint").agg(F.count(F.lit(1)).alias("n"))


_POS, _NEG = ["license", "the work", "and the"], ["worthless", "trash", "stupid", "disgusting"]


@query(
    f"""WITH x AS (SELECT doc_id, len(list_filter({_POS}, lambda k: contains(lower(coalesce(text, '')), k))) AS p, len(list_filter({_NEG}, lambda k: contains(lower(coalesce(text, '')), k))) AS n FROM documents)
    SELECT doc_id, CASE WHEN n > 0 AND n >= p THEN 'negative' WHEN p > 0 THEN 'positive' ELSE 'neutral' END AS signal FROM x"""
)
def text_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.text_signal(F.col("text"), _POS, _NEG).alias("signal"))


_REASONS = ["Lack of Efficacy", "slow enrollment", "dose limiting toxicity", "sponsor decision", "futility and safety"]


@query(
    f"""WITH x AS (SELECT o_orderkey AS id, lower({_REASONS}[o_orderkey % 6 + 1]) AS t FROM orders)
    SELECT id, coalesce(regexp_matches(t, 'efficacy|futility'), false) AS is_efficacy, coalesce(regexp_matches(t, 'toxicity|adverse|safety|side effect|dose limiting'), false) AS is_safety,
    coalesce(regexp_matches(t, 'accrual|enrollment|recruitment difficulty'), false) AS is_accrual FROM x"""
)
def stop_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.get(F.array(*map(F.lit, _REASONS)), (F.col("o_orderkey") % 6).cast("int"))
    flags = T.stop_flags(reason, ["efficacy", "futility"])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *[c.alias(n) for n, c in flags.items()])


@query("WITH x AS (SELECT id, CASE WHEN drug <> 'unmapped' THEN lower(trim(drug)) END AS d, lower(trim(target)) AS t FROM (SELECT o_orderkey AS id, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'unmapped' ELSE ' ' || c_mktsegment END AS drug, n_name AS target FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)) SELECT id, coalesce(d, 'unknown') AS drug_key, d || ' | ' || t AS pair FROM x")
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir).withColumn("drug", F.when(F.col("drug") == "unmapped", F.col("drug")).otherwise(F.concat(F.lit(" "), "drug")))
    d = entity_key(F.col("drug"))
    return c.select("id", entity_key(F.col("drug"), otherwise="unknown").alias("drug_key"), pair_key(d, entity_key(F.col("target"))).alias("pair"))


@query("WITH x AS (SELECT event_id, ['<' || value, 'n/a', CASE WHEN event_id % 2 = 0 THEN '> ' || (value + 1) END] AS v FROM events) SELECT event_id, round(coalesce(TRY_CAST(trim(replace(v[3], '>', '')) AS DOUBLE), TRY_CAST(replace(v[1], '<', '') AS DOUBLE)), 6) AS number FROM x")
def tolerant_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.array(F.concat(F.lit("<"), F.col("value").cast("string")), F.lit("n/a"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("> "), (F.col("value") + 1).cast("string"))))
    return rounded(table(spark, sf_dir, "events").select("event_id", T.last_number(v).alias("number")), "number")


@query(
    """ SELECT id, CASE WHEN id % 3 = 0 AND drug <> 'unmapped' THEN 'acts on ' || drug WHEN id % 3 = 1 THEN 'given' ELSE CASE WHEN drug <> 'unmapped' THEN 'acts on ' || drug ELSE 'unknown' END END AS mechanism,
    CASE WHEN drug IN ('BUILDING', 'MACHINERY') THEN 'biologic' ELSE 'small_molecule' END AS class, (target IN ('NATION_1', 'NATION_2'))::INT AS is_io, (status = 'F' AND (id % 2 = 0 OR id % 3 = 0))::INT AS no_results FROM c"""
)
def mechanism_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("id") % 3 == 0, " ").when(F.col("id") % 3 == 1, "given")
    known = F.when(F.col("drug") != "unmapped", F.concat(F.lit("acts on "), "drug"))
    posted = F.when(F.col("id") % 2 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "").otherwise("2001-01-01")
    status = F.when(F.col("status") == "F", "COMPLETED").otherwise("OTHER")
    return cohort(spark, sf_dir).select(
        "id", T.filled_mechanism(given, known).alias("mechanism"), T.modality_class(F.col("drug"), ["building", "machinery"]).alias("class"),
        F.col("target").isin("NATION_1", "NATION_2").cast("int").alias("is_io"), T.completed_without_results(status, posted).alias("no_results"),
    )


# The default English stop words of Spark ML, for the SQL.
_STOPS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've "
    "we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't "
    "cannot could here's how's let's ought that's there's what's when's where's who's why's would "
).split()
_STOP_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in _STOPS)


_TERMS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM documents),
    e AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM w),
    f AS (SELECT doc_id, list(w ORDER BY i) AS w FROM e WHERE w NOT IN ({_STOP_LIST}) GROUP BY doc_id),
    t AS (SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS term FROM f),
    c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)"""


@query(
    _TERMS
    + """, n AS (SELECT count(*) AS n FROM w),
    v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 5000),
    r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (df + 1)) + 1) AS x FROM c JOIN v USING (term), n)
    SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) * 3, 5) AS weight FROM r"""
)
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", weight=3.0), "weight", digits=5)


@query(
    _TERMS
    + """, k AS (SELECT DISTINCT doc_id FROM labels), n AS (SELECT count(*) AS n FROM w SEMI JOIN k USING (doc_id)),
    v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c SEMI JOIN k USING (doc_id) GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 5000),
    i AS (SELECT term, df, row_number() OVER (ORDER BY total DESC, term) - 1 AS i FROM v),
    r AS (SELECT doc_id, i, term, (1 + ln(tf)) * (ln((1 + n) / (df + 1)) + 1) AS x FROM c ANTI JOIN k USING (doc_id) JOIN i USING (term), n)
    SELECT doc_id, i AS index, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) * 3, 5) AS weight FROM r"""
)
def tfidf_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label weighed by what those with one teach."""
    docs, known = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id")
    fitted = T.fit_terms(docs.join(known, "doc_id", "left_semi"), "text")
    out = T.term_weights(T.spread(docs).join(known, "doc_id", "left_anti"), fitted, "text", weight=3.0)
    each = out.select("doc_id", F.explode("weights").alias("x")).select("doc_id", F.col("x.index").cast("long").alias("index"), "x.term", "x.weight")
    return rounded(each, "weight", digits=5)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    h = hash_order(i, "s")
    return cohort(spark, sf_dir).select(
        "id",
        F.element_at(F.array(*map(F.lit, ("COMPLETED", "TERMINATED", "WITHDRAWN", "RECRUITING"))), (h % 4 + 1).cast("int")).alias("status"),
        F.element_at(F.array(*map(F.lit, ("positive", "negative", "neutral"))), (F.pmod(h, F.lit(7)) % 3 + 1).cast("int")).alias("signal"),
        (i % 2 == 0).alias("has_results"), (i % 5 == 0).alias("approved"), (F.col("drug") == "unmapped").alias("unmapped"), (i % 3 == 0).alias("efficacy_stop"),
        (i % 6 == 0).alias("has_structured"), F.when(i % 12 == 0, (i % 24 == 0)).alias("endpoint_met"), F.when(i % 12 == 0, (i % 100) / 1000.0).alias("p_value"),
        (i % 7 == 0).alias("has_publication"), F.when(i % 14 == 0, i % 28 == 0).alias("pub_met"), F.lit("neutral").alias("pub_signal"),
    )


_LAB = """, h AS (SELECT id, drug, ('0x' || substr(md5('s:' || id::VARCHAR), 1, 8))::BIGINT AS h FROM c),
  s AS (SELECT id, ['COMPLETED', 'TERMINATED', 'WITHDRAWN', 'RECRUITING'][h % 4 + 1] AS status, ['positive', 'negative', 'neutral'][h % 7 % 3 + 1] AS signal, id % 2 = 0 AS res, id % 5 = 0 AS app, drug = 'unmapped' AS unm, id % 3 = 0 AS eff FROM h),
  b AS (SELECT *, CASE
    WHEN status = 'COMPLETED' AND signal = 'negative' THEN '0completed+negative_text' WHEN status = 'COMPLETED' AND signal = 'positive' AND res THEN '1completed+positive_text+results'
    WHEN status = 'COMPLETED' AND signal = 'positive' AND app THEN '1completed+positive_text+approved' WHEN status = 'COMPLETED' AND res AND NOT unm AND signal <> 'positive' THEN '0completed+results+no_positive_signal'
    WHEN status = 'COMPLETED' AND NOT res AND NOT unm THEN '-completed+no_results_posted' WHEN status = 'COMPLETED' THEN '-completed+indeterminate'
    WHEN status = 'TERMINATED' AND eff THEN '0terminated+efficacy' WHEN status = 'TERMINATED' AND signal = 'negative' THEN '0terminated+negative_text' WHEN status = 'TERMINATED' THEN '-terminated+indeterminate'
    WHEN status = 'WITHDRAWN' AND signal = 'negative' THEN '0withdrawn+negative' WHEN status = 'WITHDRAWN' THEN '-withdrawn' ELSE '-other+indeterminate' END AS r FROM s),
  k AS (SELECT *, CASE r[1] WHEN '0' THEN 0 WHEN '1' THEN 1 ELSE -1 END AS strict, r[2:] AS prov FROM b),
  l AS (SELECT id, strict AS label_strict, strict AS label_balanced, CASE WHEN strict = -1 AND status = 'COMPLETED' AND app THEN 1 ELSE strict END AS label_permissive,
    CASE WHEN strict = -1 AND status = 'COMPLETED' AND app THEN 'completed+approved_indication' ELSE prov END AS label_provenance, status, app FROM k) """


@query(_LAB + "SELECT id, label_strict, label_balanced, label_permissive, label_provenance FROM l")
def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rule_labels(_labelled(spark, sf_dir)).select("id", "label_strict", "label_balanced", "label_permissive", "label_provenance")


@query(
    _LAB
    + """, z AS (SELECT id, CASE WHEN id % 12 = 0 THEN (id % 24 = 0)::INT WHEN id % 14 = 0 THEN (id % 28 = 0)::INT ELSE label_strict END AS strict,
    CASE WHEN id % 12 = 0 THEN CASE WHEN id % 100 <> 0 THEN 'structured_results_pval_' || format('{:.3f}', (id % 100) / 1000.0::DOUBLE) ELSE 'structured_results' END WHEN id % 14 = 0 THEN 'publication_neutral' ELSE k.prov END AS prov, k.status, k.app FROM l JOIN k USING (id))
    SELECT id, strict AS label_strict, CASE WHEN strict = -1 AND status = 'COMPLETED' AND app THEN 1 ELSE strict END AS label_permissive, CASE WHEN strict = -1 AND status = 'COMPLETED' AND app THEN 'completed+approved_indication' ELSE prov END AS label_provenance FROM z"""
)
def priority_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.priority_labels(_labelled(spark, sf_dir)).select("id", "label_strict", "label_permissive", "label_provenance")


@query(
    """ SELECT id, CASE WHEN x1 IS NOT NULL AND id % 2 = 0 THEN CASE WHEN x1 * 50 > 1 THEN least(x1 * 50 / 100, 1.0) ELSE x1 * 50 END WHEN x3 IS NOT NULL THEN greatest(0.0, 1 - x3 * 20) WHEN label = 1 THEN 0.75 WHEN label = 0 THEN 0.25 END AS outcome FROM c"""
)
def continuous_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("id") % 2 == 0, "response").otherwise("pfs")
    return cohort(spark, sf_dir).select("id", L.continuous_outcome(F.col("x1") * 50, kind, F.col("x3"), F.col("label")).alias("outcome"))


@query(
    """WITH l AS (SELECT l_orderkey AS id, l_returnflag, arg_min(l_partkey, l_linenumber * 1000000 + l_partkey) AS part, list(l_discount ORDER BY l_linenumber, l_partkey) AS d, list(l_quantity ORDER BY l_linenumber, l_partkey) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
    SELECT id, ['survival', 'response', 'other'][part % 3 + 1] AS endpoint, round(d[-1], 6) AS p_value, round(d[-1], 6) < 0.05 AS met, q[-1] AS effect FROM l"""
)
def primary_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", F.col("l_discount").alias("d"), F.col("l_quantity").alias("q"))
    first = F.min_by("l_partkey", F.col("l_linenumber") * F.lit(1000000).cast("long") + F.col("l_partkey"))  # SQL's order, in which large part keys outweigh a line number
    lines = li.groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("f")).agg(F.sort_array(F.collect_list(row)).alias("rows"), first.alias("part"))
    title = F.element_at(F.array(F.lit("Overall survival"), F.lit("ORR"), F.lit("cost")), (F.col("part") % 3 + 1).cast("int"))
    outcome = F.struct(
        F.when(F.col("f") == "A", "Primary").otherwise("SECONDARY").alias("type"), title.alias("title"),
        F.transform("rows", lambda x: F.struct(F.concat(F.lit("<"), F.round(x["d"], 6).cast("string")).alias("pValue"), F.lit("n/a").alias("paramValue"))).alias("analyses"),
        F.array(F.struct(F.transform("rows", lambda x: F.struct(x["q"].cast("string").alias("value"))).alias("measurements"))).alias("groups"),
    )
    found = lines.groupBy("id").agg(F.sort_array(F.collect_list(outcome)).alias("outcomes")).select("id", L.primary_result(F.col("outcomes")).alias("r"))
    return found.filter("r IS NOT NULL").select("id", "r.*")


@query(
    _LAB
    + """, u AS (UNPIVOT (SELECT label_strict, label_permissive FROM l) ON label_strict, label_permissive INTO NAME label VALUE value)
    SELECT label, count(*) FILTER (value = 1) AS positive, count(*) FILTER (value = 0) AS negative, count(*) FILTER (value = -1) AS indeterminate,
    round(count(*) FILTER (value >= 0) / count(*), 6) AS determinate_rate, round(count(*) FILTER (value = 1) / count(*) FILTER (value >= 0), 6) AS positive_rate FROM u GROUP BY label"""
)
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = L.rule_labels(_labelled(spark, sf_dir))
    return rounded(L.label_summary(labelled, ["label_strict", "label_permissive"]), "determinate_rate", "positive_rate")


@query(_LAB + "SELECT label_provenance, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, label_provenance))::INT AS rank FROM l GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8")
def top_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.top_provenance(L.rule_labels(_labelled(spark, sf_dir)))


@query(
    """WITH a AS (SELECT user_id AS nct_id, event_id AS article_id, 2000 + event_id % 20 AS year, CASE WHEN event_type = 'error' THEN 'negative' WHEN event_type = 'purchase' THEN 'positive' ELSE 'neutral' END AS s FROM events),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY nct_id ORDER BY year DESC, article_id DESC) = 1)
    SELECT nct_id, true AS has_publication, article_id AS pub_id, year AS pub_year, s AS pub_signal, CASE s WHEN 'positive' THEN true WHEN 'negative' THEN false END AS pub_met FROM b"""
)
def publication_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "events").select(F.col("user_id").alias("nct_id"), F.col("event_id").alias("article_id"), (2000 + F.col("event_id") % 20).alias("year"), F.col("event_type").alias("abstract"))
    return L.publication_evidence(articles, T.text_signal(F.col("abstract"), ["purchase"], ["error"]))


@query(" SELECT id, (x4 > 0.2 AND x4 < 0.5) AS has_both, CASE WHEN x4 > 0.2 THEN customer * 2 END AS result, CASE WHEN x4 < 0.5 THEN customer * 3 END AS publication FROM c")
def results_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), (F.col("c_acctbal") / 10000.0).alias("balance"))
    results = k.filter(F.col("balance") > 0.2).select("customer", (F.col("customer") * 2).alias("result"))
    publications = k.filter(F.col("balance") < 0.5).select("customer", (F.col("customer") * 3).alias("publication"))
    both = list_join(cohort(spark, sf_dir).select("id", "customer"), [results, publications], "customer")
    return both.select("id", (F.col("result").isNotNull() & F.col("publication").isNotNull()).alias("has_both"), "result", "publication")
