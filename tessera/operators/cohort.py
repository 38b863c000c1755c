"""From nested study records to a flat, filtered cohort table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import UNKNOWN, any_of, leading_year

_S, _A = T.StringType(), T.ArrayType


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Schema of the nested records; absent keys read as null.
STUDY = _struct(
    protocolSection=_struct(
        identificationModule=_struct(nctId=_S, officialTitle=_S, briefTitle=_S),
        statusModule=_struct(overallStatus=_S, whyStopped=_S, startDateStruct=_struct(date=_S), completionDateStruct=_struct(date=_S), resultsFirstPostDateStruct=_struct(date=_S)),
        designModule=_struct(phases=_A(_S)),
        conditionsModule=_struct(conditions=_A(_S)),
        armsInterventionsModule=_struct(interventions=_A(_struct(type=_S, name=_S, description=_S))),
        outcomesModule=_struct(primaryOutcomes=_A(_struct(measure=_S, description=_S, timeFrame=_S))),
        descriptionModule=_struct(briefSummary=_S),
        eligibilityModule=_struct(eligibilityCriteria=_S),
    ),
    resultsSection=_struct(
        outcomeMeasuresModule=_struct(
            outcomeMeasures=_A(_struct(type=_S, title=_S, description=_S, analyses=_A(_struct(pValue=_S, paramValue=_S)), groups=_A(_struct(measurements=_A(_struct(value=_S))))))
        )
    ),
)


def _text(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(""))


def intervention_names(types: Sequence[str]) -> Column:
    """Names of the interventions whose upper-cased type is in ``types``."""
    kept = F.filter("protocolSection.armsInterventionsModule.interventions", lambda x: F.upper(x["type"]).isin(*types))
    return F.coalesce(F.transform(kept, lambda x: x["name"]), F.array().cast("array<string>"))


def flatten_studies(studies: DataFrame, phases: Sequence[str] = ("PHASE2",), types: Sequence[str] = ("DRUG", "BIOLOGICAL")) -> DataFrame:
    """One row per study in one of ``phases`` that has an intervention of one of ``types``.

    Absent texts are ``""``; lists are joined by ``|``; the official title falls back on
    the brief one. The filters stand before the projection, so they reach the scan.
    """
    p = "protocolSection."
    phase = F.coalesce(F.col(p + "designModule.phases"), F.array().cast("array<string>"))
    names = intervention_names(types)
    kept = studies.filter(F.exists(phase, lambda x: x.isin(*phases)) & (F.size(names) > 0))
    official = F.col(p + "identificationModule.officialTitle")
    measure = F.transform(
        p + "outcomesModule.primaryOutcomes",
        lambda o: F.concat_ws(" ", F.coalesce(o["measure"], F.lit("")), F.coalesce(o["description"], F.lit("")), F.coalesce(o["timeFrame"], F.lit(""))),
    )
    return kept.select(
        _text(p + "identificationModule.nctId").alias("nct_id"),
        F.coalesce(F.when(official != "", official), F.col(p + "identificationModule.briefTitle"), F.lit("")).alias("title"),
        _text(p + "statusModule.overallStatus").alias("status"),
        _text(p + "statusModule.whyStopped").alias("why_stopped"),
        _text(p + "statusModule.startDateStruct.date").alias("start_date"),
        _text(p + "statusModule.resultsFirstPostDateStruct.date").alias("results_first_posted"),
        F.array_join(phase, "|").alias("phase"),
        F.coalesce(F.array_join(p + "conditionsModule.conditions", "|"), F.lit("")).alias("condition"),
        F.array_join(names, "|").alias("intervention_names"),
        F.coalesce(F.array_join(measure, "|"), F.lit("")).alias("primary_outcomes"),
        _text(p + "descriptionModule.briefSummary").alias("brief_summary"),
        _text(p + "eligibilityModule.eligibilityCriteria").alias("eligibility"),
        leading_year(F.col(p + "statusModule.startDateStruct.date")).alias("start_year"),
    )


def protocol_text(studies: DataFrame, types: Sequence[str] = ("DRUG", "BIOLOGICAL")) -> DataFrame:
    """(nct_id, structured_text, eligibility_text, protocol_text, protocol_missing) from allowed fields alone.

    Conditions and names are joined by `` ; ``, and so is the eligibility to them; what is empty is
    ``missingprotocol``. Titles, summaries, outcomes, status and results are never read. Types match in exact
    case here. Literal ``\\n`` and ``\\t`` become spaces.
    """
    p = "protocolSection."
    items = F.transform(F.filter(p + "armsInterventionsModule.interventions", lambda x: x["type"].isin(*types)), lambda x: F.coalesce(x["name"], F.lit("")))
    empty = F.array().cast("array<string>")
    parts = F.concat(F.coalesce(F.col(p + "conditionsModule.conditions"), empty), F.coalesce(items, empty))
    clean = F.replace(F.replace(_text(p + "eligibilityModule.eligibilityCriteria"), F.lit("\\n"), F.lit(" ")), F.lit("\\t"), F.lit(" "))
    out = studies.select(F.col(p + "identificationModule.nctId").alias("nct_id"), F.array_join(parts, " ; ").alias("structured_text"), clean.alias("eligibility_text"))
    both = F.regexp_replace(F.concat("structured_text", F.lit(" ; "), "eligibility_text"), "^[ ;]+|[ ;]+$", "")
    missing = ((F.col("structured_text") == "") & (F.col("eligibility_text") == "")).cast("int")

    def filled(c: Column) -> Column:
        return F.when(c == "", "missingprotocol").otherwise(c)

    return out.select("nct_id", filled(F.col("structured_text")).alias("structured_text"), filled(F.col("eligibility_text")).alias("eligibility_text"), filled(both).alias("protocol_text"), missing.alias("protocol_missing"))


def keep_keywords(df: DataFrame, text: str, words: Sequence[str]) -> DataFrame:
    return df.filter(any_of(F.col(text), words))


def keep_known(df: DataFrame, entity: str, exclude: Sequence[str] = (), unknown: Sequence[str] = UNKNOWN) -> DataFrame:
    """Rows whose entity is known and not in ``exclude``."""
    key = F.lower(F.trim(F.col(entity)))
    return df.filter(key.isNotNull() & ~key.isin(*unknown, *[x.lower() for x in exclude]))


def keep_determinate(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isin(0, 1))


def select_features(df: DataFrame, names: Sequence[str], suffixes: Sequence[str] = ()) -> DataFrame:
    """Named columns that exist, then others that end in one of ``suffixes``; each once."""
    found = [n for n in dict.fromkeys(names) if n in df.columns]
    return df.select(*found, *[c for c in df.columns if c not in found and c.endswith(tuple(suffixes) or ("\0",))])


def add_new_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with those columns of ``right`` that it lacks; on a collision the left one stays."""
    fresh = [c for c in dict.fromkeys(right.columns) if c not in left.columns]
    return left.join(right.select(key, *fresh), key, "left")


def align(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), fill: float = -1.0) -> DataFrame:
    """``keep``, then ``columns`` as doubles; a missing column, null, NaN or infinity is ``fill``."""

    def one(c: str) -> Column:
        if c not in df.columns:
            return F.lit(float(fill)).alias(c)
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), fill).otherwise(x).alias(c)

    return df.select(*keep, *[one(c) for c in columns])


def subset_counts(df: DataFrame, masks: dict[str, Column], label: str) -> DataFrame:
    """(subset, n, positives) of named masks in one pass over the table."""
    names = F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in masks.items()]))
    return df.withColumn("subset", F.explode(names)).groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == 1).cast("int")).alias("positives"))
