"""Rule labels with provenance: 1, 0, and -1 for indeterminate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.text import last_number, result_endpoint


def _rules(status: Column, signal: Column, has_results: Column, approved: Column, unmapped: Column, efficacy: Column) -> Column:
    """struct(label, provenance) of the record's own rules, in order."""

    def given(label: int, provenance: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(provenance).alias("provenance"))

    completed = (
        F.when(signal == "negative", given(0, "completed+negative_text"))
        .when((signal == "positive") & has_results, given(1, "completed+positive_text+results"))
        .when((signal == "positive") & approved, given(1, "completed+positive_text+approved"))
        .when(has_results & ~unmapped & (signal != "positive"), given(0, "completed+results+no_positive_signal"))
        .when(~has_results & ~unmapped, given(-1, "completed+no_results_posted"))
        .otherwise(given(-1, "completed+indeterminate"))
    )
    terminated = F.when(efficacy, given(0, "terminated+efficacy")).when(signal == "negative", given(0, "terminated+negative_text")).otherwise(given(-1, "terminated+indeterminate"))
    withdrawn = F.when(signal == "negative", given(0, "withdrawn+negative")).otherwise(given(-1, "withdrawn"))
    return F.when(status == "COMPLETED", completed).when(status == "TERMINATED", terminated).when(status == "WITHDRAWN", withdrawn).otherwise(given(-1, "other+indeterminate"))


def _finish(df: DataFrame, rule: Column, status: Column, approved: Column) -> DataFrame:
    """Permissive labels: an indeterminate completed record of an approved pair counts as 1, and says so."""
    promoted = (F.col("_rule.label") == -1) & (status == "COMPLETED") & approved
    return (
        df.withColumn("_rule", rule)
        .withColumn("label_strict", F.col("_rule.label"))
        .withColumn("label_balanced", F.col("_rule.label"))
        .withColumn("label_permissive", F.when(promoted, 1).otherwise(F.col("_rule.label")))
        .withColumn("label_provenance", F.when(promoted, "completed+approved_indication").otherwise(F.col("_rule.provenance")))
        .drop("_rule")
    )


def rule_labels(df: DataFrame, status: str = "status", signal: str = "signal", has_results: str = "has_results", approved: str = "approved", unmapped: str = "unmapped", efficacy: str = "efficacy_stop") -> DataFrame:
    cols = [F.col(signal), F.col(has_results), F.col(approved), F.col(unmapped), F.col(efficacy)]
    return _finish(df, _rules(F.col(status), *cols), F.col(status), F.col(approved))


def priority_labels(df: DataFrame) -> DataFrame:
    """``rule_labels`` behind structured results (``has_structured``, ``endpoint_met``, ``p_value``) and publications (``has_publication``, ``pub_met``, ``pub_signal``)."""
    met, pub = F.col("endpoint_met"), F.col("pub_met")
    p = F.col("p_value")
    from_results = F.when(p.isNotNull() & (p != 0), F.concat(F.lit("structured_results_pval_"), F.format_string("%.3f", p))).otherwise("structured_results")
    rules = _rules(F.col("status"), F.col("signal"), F.col("has_results"), F.col("approved"), F.col("unmapped"), F.col("efficacy_stop"))
    rule = (
        F.when(F.col("has_structured") & met.isNotNull(), F.struct(met.cast("int").alias("label"), from_results.alias("provenance")))
        .when(F.col("has_publication") & pub.isNotNull(), F.struct(pub.cast("int").alias("label"), F.concat(F.lit("publication_"), "pub_signal").alias("provenance")))
        .otherwise(rules)
    )
    return _finish(df, rule, F.col("status"), F.col("approved"))


def continuous_outcome(effect: Column, endpoint: Column, p: Column, label: Column) -> Column:
    response = F.when(effect > 1, F.least(effect / 100, F.lit(1.0))).otherwise(effect)
    return F.when(effect.isNotNull() & (endpoint == "response"), response).when(p.isNotNull(), F.greatest(F.lit(0.0), 1 - p * 20)).when(label == 1, 0.75).when(label == 0, 0.25)


def primary_result(outcomes: Column) -> Column:
    """struct(endpoint, p_value, met, effect) of the first primary outcome; null without one.

    The last analysis that gives a number counts; measured values come after analysis parameters.
    """
    first = F.get(F.filter(outcomes, lambda o: F.upper(o["type"]) == "PRIMARY"), F.lit(0))
    p = last_number(F.transform(first["analyses"], lambda a: a["pValue"]))
    from_analyses = F.transform(first["analyses"], lambda a: a["paramValue"])
    measured = F.flatten(F.transform(first["groups"], lambda g: F.transform(g["measurements"], lambda m: m["value"])))
    empty = F.array().cast("array<string>")
    effect = last_number(F.concat(F.coalesce(from_analyses, empty), F.coalesce(measured, empty)))
    return F.when(first.isNotNull(), F.struct(result_endpoint(first["title"]).alias("endpoint"), p.alias("p_value"), (p < 0.05).alias("met"), effect.alias("effect")))


def label_summary(df: DataFrame, labels: list[str]) -> DataFrame:
    """(label, positive, negative, indeterminate, determinate_rate, positive_rate) of each label column, in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in labels])).alias("x")).select("x.*")

    def n(v: int) -> Column:
        return F.count_if(F.col("value") == v)

    known = n(1) + n(0)
    return long.groupBy("label").agg(
        n(1).alias("positive"), n(0).alias("negative"), n(-1).alias("indeterminate"),
        (known / F.count(F.lit(1))).alias("determinate_rate"), F.try_divide(n(1), known).alias("positive_rate"),
    )


def top_provenance(df: DataFrame, provenance: str = "label_provenance", n: int = 8) -> DataFrame:
    counts = df.groupBy(provenance).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), provenance))).filter(F.col("rank") <= n)


def publication_evidence(articles: DataFrame, signal: Column) -> DataFrame:
    """(nct_id, has_publication, pub_id, pub_year, pub_signal, pub_met): the newest article of each study."""
    newest = articles.withColumn("_s", signal).groupBy("nct_id").agg(F.max(F.struct("year", "article_id", "_s")).alias("_a"))
    met = F.when(F.col("_a._s") == "positive", True).when(F.col("_a._s") == "negative", False)
    return newest.select("nct_id", F.lit(True).alias("has_publication"), F.col("_a.article_id").alias("pub_id"), F.col("_a.year").alias("pub_year"), F.col("_a._s").alias("pub_signal"), met.alias("pub_met"))
