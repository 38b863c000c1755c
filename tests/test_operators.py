"""Behaviour on small frames: unknown against unseen, ties, one class, later labels, train-only fits."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, bootstrap, checks, cohort, evidence, features, labels, match, metrics, models, splits, text
from tessera.operators.prefix import cumulative, ordinal
from tessera.sources import io


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def cohort160(spark):
    base = spark.range(160).select(F.format_string("n%03d", "id").alias("nct_id"), (2000 + F.floor(F.col("id") / 10)).cast("int").alias("start_year"), (F.col("id") % 2).cast("int").alias("label"), F.concat(F.lit("d"), F.col("id") % 8).alias("drug"), F.concat(F.lit("g"), F.floor(F.col("id") / 2) % 8).alias("target"))
    return base.withColumn("x", F.substring("nct_id", 2, 3).cast("double") / 160)


def test_overlap_tells_unknown_from_unseen(spark):
    df = spark.createDataFrame([(" A ", 2015, 0), ("a", 2016, 1), ("b", 2017, 0), ("unmapped", 2018, 1), ("c", None, 1), ("d", 2019, -1)], "drug string, year int, label int")
    r = audit.entity_overlap(df, ["label"], ["drug"], "year", 2015).first()
    assert (r.test_seen, r.test_unseen, r.test_unknown, r.excluded_invalid_label, r.excluded_missing_year_with_valid_label) == (1, 1, 1, 1, 1)


def test_auc_and_intervals(spark):
    df = spark.createDataFrame([(0, 0.1, "a"), (1, 0.9, "a"), (0, 0.1, "b"), (1, 0.9, "b")], "y int, p double, g string")
    r = bootstrap.bootstrap_auc(df, "y", "p", "g", 100).first()
    assert (r.auc, r.ci_low, r.ci_high, r.valid_replicates) == (1, 1, 1, 100)
    assert bootstrap.bootstrap_auc(df, "y", "p", "g", 100).first() == r
    paired = bootstrap.paired_bootstrap(df.withColumn("q", F.col("p")), "y", "p", "q", "g", 50)
    assert paired.filter("which = 'difference'").select("ci_low", "ci_high").first() == (0, 0)
    one = spark.createDataFrame([(1, 0.3), (1, 0.6)], "y int, p double")
    assert metrics.roc_auc(one, "y", "p").first()[0] is None and metrics.roc_auc(one, "y", "p", undefined=0.5).first()[0] == 0.5
    with pytest.raises(ValueError):
        checks.require_scores(spark.createDataFrame([(1, float("nan"))], "y int, p double"), "y", ["p"])


def test_kind_of_draws_is_a_parameter(spark, monkeypatch):
    clusters = spark.range(50).select(F.col("id").cast("string").alias("cluster"))
    per = bootstrap.draws(clusters, 8, "s").groupBy("replicate").agg(F.sum("times")).collect()
    assert [r[1] for r in per] == [50] * 8
    total = bootstrap.draws(clusters, 40, "s", "poisson").agg(F.sum("times")).first()[0]
    assert 1800 < total < 2200
    monkeypatch.setattr(bootstrap, "EXACT", 49)
    with pytest.raises(ValueError, match="poisson"):
        bootstrap.draws(clusters, 8, "s")
    assert bootstrap.draws(clusters, 40, "s", "poisson").agg(F.sum("times")).first()[0] == total
    with pytest.raises(ValueError):
        bootstrap.draws(clusters, 8, "s", "other")


def test_metrics_do_not_depend_on_partitions(spark, cohort160):
    df = cohort160.withColumn("p", F.pmod(F.xxhash64("nct_id"), F.lit(20)) / 20.0)
    assert rows(metrics.metric_bundle(df, "label", "p")) == rows(metrics.metric_bundle(df.repartition(13), "label", "p"))


def test_running_sums(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"))
    got = {r.id: r.n for r in ordinal(df, ["g"], "k", "n", ties=["id"]).collect()}
    for g in range(3):
        order = sorted((r.k, r.id) for r in df.filter(F.col("g") == g).collect())
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))
    down = cumulative(df, [], "k", {"s": "k"}, descending=True, ties=["id"])
    assert down.agg(F.max("s")).first()[0] == df.agg(F.sum("k")).first()[0]


def test_validated_join(spark):
    base = spark.createDataFrame([("x", "A ", "d"), ("y", "B", "e")], "id string, target string, disease string")
    pairs = spark.createDataFrame([("a", "D", 2000, 100, 400, "complete")], "target string, disease string, total long, clinical long, recent long, status string")
    got = {r.id: r for r in features.refreshed_literature(base, pairs, ["target", "disease"]).collect()}
    assert got["x"].lit_fraction == 0.05 and got["x"].lit_missing == 0
    assert got["y"].lit_fraction is None and got["y"].lit_missing == 1
    with pytest.raises(ValueError):
        evidence.validated_join(base, pairs.union(pairs), ["target", "disease"])


def test_literature_keeps_zero_apart_from_missing(spark):
    df = spark.createDataFrame([("a", "total", 0), ("a", "clinical_trial", 0), ("a", "recent", 0), ("b", "total", 5), ("b", "recent", None), ("c", "total", 1), ("c", "clinical_trial", 2)], "t string, kind string, count long")
    got = {r.t: r for r in evidence.literature(df, ["t"]).collect()}
    assert (got["a"].status, got["a"].volume) == ("complete", 0) and got["b"].status == "partial" and got["b"].recency is None
    assert got["c"].status == "inconsistent" and got["c"].volume is None


def test_folds(spark, cohort160):
    windows = [(2006, 2008), (2009, None)]
    m = splits.expanding_folds(cohort160, "nct_id", "start_year", windows)
    assert splits.violations(m, cohort160, "nct_id", "start_year").isEmpty() and splits.fold_guard(m, cohort160, "nct_id", "label").isEmpty()
    g = splits.group_folds(cohort160, "target", "label", 3, "s")
    assert g.count() == g.select("target").distinct().count() == 8
    s = splits.stratified_folds(cohort160, "nct_id", "label", 4, "s").groupBy("fold", "label").count()
    assert {r["count"] for r in s.collect()} == {20}
    bad = m.unionByName(m.filter("role = 'validation'").limit(1).withColumn("role", F.lit("train")))
    assert {r.problem for r in splits.violations(bad, cohort160, "nct_id", "start_year").collect()} >= {"roles overlap", "years overlap"}


def test_later_labels_do_not_matter(spark, cohort160):
    later = cohort160.withColumn("label", F.when(F.col("start_year") > 2010, 9).otherwise(F.col("label")))
    a, b = (splits.training_frame(df, "nct_id", "start_year", "label", 2010, ["target", "drug"]) for df in (cohort160, later))
    assert sorted(rows(a)) == sorted(rows(b))
    with pytest.raises(ValueError):
        splits.training_frame(cohort160.union(cohort160), "nct_id", "start_year", "label", 2010, ["target", "drug"])


def test_train_only_preparation(spark):
    train, new = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,)], "x double"), spark.createDataFrame([(10000.0,), (None,)], "x double")
    assert features.scale(train, train, ["x"]).agg(F.avg("x")).first()[0] == pytest.approx(0)
    assert rows(features.impute(train, new, ["x"])) == [(10000.0,), (1.5,)]
    v = features.vocabulary(spark.createDataFrame([("A ",), ("b",)], "t string"), ["t"])
    assert sorted(rows(features.encode(spark.createDataFrame([("a",), ("zz",)], "t string"), v, ["t"]))) == [("a", 2), ("zz", 1)]


def test_feature_sets_and_collisions(spark):
    df = spark.createDataFrame([(1, 0.5, 0.2)], "id int, CDS double, raw_only double")
    sets = features.feature_sets(df, ["CDS"], ["CDS", "raw_only"], [])
    assert "raw_only" in sets["hybrid"] and "raw_only" not in sets["composite"]
    assert rows(cohort.add_new_columns(df, df.withColumn("CDS", F.lit(9.0)), "id")) == [(1, 0.5, 0.2)]


def test_endpoint_table(spark):
    cases = {"Overall survival": "survival", "PFS by review": "pfs", "ORR": "response", "biomarker": "biomarker", "cost": "other", " ": None, "os at dose": "other"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.e for r in df.select("t", text.endpoint_class(F.col("t")).alias("e")).collect()} == cases


def test_text_allow_list(spark):
    def study(title, status):
        return {"protocolSection": {"identificationModule": {"nctId": "n1", "officialTitle": title}, "statusModule": {"overallStatus": status}, "conditionsModule": {"conditions": ["c"]},
                "armsInterventionsModule": {"interventions": [{"type": "DRUG", "name": "d"}, {"type": "DEVICE", "name": "x"}]}, "eligibilityModule": {"eligibilityCriteria": "a\\nb"}}}

    a, b = (cohort.protocol_text(spark.createDataFrame([study(t, s)], cohort.STUDY)).first() for t, s in (("one", "COMPLETED"), ("two", "WITHDRAWN")))
    assert a == b and a.protocol_text == "c ; d ; a b"
    bare = {"protocolSection": {"identificationModule": {"nctId": "n2"}}}
    only = {"protocolSection": {"identificationModule": {"nctId": "n3"}, "eligibilityModule": {"eligibilityCriteria": " ; a"}}}
    got = {r.nct_id: tuple(r)[1:] for r in cohort.protocol_text(spark.createDataFrame([bare, only], cohort.STUDY)).collect()}
    assert got == {"n2": ("missingprotocol", "missingprotocol", "missingprotocol", 1), "n3": ("missingprotocol", " ; a", "a", 0)}


def test_selection_settles_ties(spark):
    df = spark.createDataFrame([("a", 0.7, 0.1), ("b", 0.8, 0.2), ("c", 0.8, 0.15)], "candidate string, auc double, brier double")
    assert models.best(df, [], models.by_auc()).first().candidate == "c"


def test_logistic_meets_its_optimum(spark, cohort160):
    df = models.assembled(cohort160.withColumn("y", (F.col("x") + (F.col("label") - 0.5) > 0.5).cast("int")), ["x"])
    m = models.logistic(df, "y", c=2.0)
    w, b = m.coefficients[0], m.intercept
    p = 1 / (1 + F.exp(-(w * F.element_at(models.vector_to_array("features"), 1) + b)))
    gw, gb = df.agg(F.sum((p - F.col("y")) * F.element_at(models.vector_to_array("features"), 1)), F.sum(p - F.col("y"))).first()
    assert gw + w / 2.0 == pytest.approx(0, abs=1e-3) and gb == pytest.approx(0, abs=1e-3)


def test_journal(spark, tmp_path):
    path, schema = str(tmp_path / "j"), "seq long, target string, status string"
    work = spark.createDataFrame([("a",), ("b",)], "target string")
    io.append_journal(spark.createDataFrame([(1, "a", "complete"), (2, "b", "partial")], schema), path)
    assert rows(io.pending(work, io.read_journal(spark, path, schema), ["target"])) == [("b",)]
    io.append_journal(spark.createDataFrame([(3, "b", "complete")], schema), path)
    p = io.progress(work, io.read_journal(spark, path, schema), ["target"]).first()
    assert (p.complete, p.pending, p.attempts) == (2, 0, 3)


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "id int, name string, x double")
    at = lambda n: str(tmp_path / n)
    io.write_csv(df, at("csv"))
    io.write_matrix(df, at("pq"), ["name"])
    io.write_summary(df.agg(F.count(F.lit(1)).alias("n")), at("sum"))
    assert sorted(rows(io.read_parquet_or_csv(spark, at("none"), at("csv"), df.schema)), key=str) == sorted(rows(io.read_parquet_or_csv(spark, at("pq"), at("csv"))), key=str)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        io.write_csv(df, at("csv"))
    prints = io.fingerprint(spark, [at("pq")])
    saved = spark.createDataFrame(prints.collect(), prints.schema)
    assert io.changed_files(io.fingerprint(spark, [at("pq")]), saved).isEmpty()
    (tmp_path / "h.csv").write_text('a,b,a,"x,y","x,z"\n1,2,3,4,5\n')
    assert rows(io.duplicate_headers(spark, at("h.csv"))) == [("a", 2)]
    (tmp_path / "bad.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="PARQUET|parquet|SCHEMA"):
        io.read_parquet_or_csv(spark, at("bad.parquet"), at("csv")).collect()


def test_nested_records_read_from_json(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"protocolSection": {"identificationModule": {"nctId": "n", "briefTitle": "b"}, "designModule": {"phases": ["PHASE2"]}, "armsInterventionsModule": {"interventions": [{"type": "drug", "name": "d"}]}, "statusModule": {"startDateStruct": {"date": "2011-05"}}}}]')
    r = cohort.flatten_studies(io.read_studies(spark, str(tmp_path / "s.json"), multi_line=True)).first()
    assert (r.nct_id, r.title, r.intervention_names, r.start_year, r.status) == ("n", "b", "d", 2011, "")


def test_labels_name_their_rule(spark):
    df = spark.createDataFrame([("COMPLETED", "positive", True, False, False, False), ("COMPLETED", "neutral", False, True, False, False)], "status string, signal string, has_results boolean, approved boolean, unmapped boolean, efficacy_stop boolean")
    assert rows(labels.rule_labels(df).select("label_strict", "label_permissive", "label_provenance")) == [(1, 1, "completed+positive_text+results"), (-1, 1, "completed+approved_indication")]


def test_large_dictionaries_match_alike(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["Red ring", ""]), (2, ["xx", "bolt"]), (3, ["ri"]), (4, ["none"]), (5, ["a"])], "id int, names array<string>")
    words = spark.createDataFrame([(-1, "", "EMPTY"), (0, "ring", "RING"), (1, "bolts", "BOLT"), (2, "a", "A"), (3, None, "NONE")], "pos int, pattern string, canonical string")
    joined = df.withColumn("t", F.array_join("names", " "))

    def found():
        return sorted(rows(match.canonical_list(df, "id", "names", words))), sorted(rows(match.match_table(joined, "id", F.col("t"), words.withColumnRenamed("canonical", "value"))), key=str)

    plain = found()
    monkeypatch.setattr(match, "SMALL", 1)
    assert found() == plain
    assert plain[0] == [(1, "RING", 0.85), (2, "BOLT", 0.85), (3, "RING", 0.85), (4, "unmapped", 0.1), (5, "A", 0.95)]
