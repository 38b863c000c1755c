"""Free text to canonical entities by ordered dictionaries.

Dictionaries are the user's: lists of (pattern, value...) in order of preference. Up to
``INLINE`` entries they become a literal array and the match stays in the scan's stage.
Tables of patterns are broadcast up to ``SMALL`` rows, which are counted; larger ones go to the tasks as an index
(``dictionary``), and those too large for that are joined on the first characters of what is
contained. Empty patterns match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import any_of
from tessera.operators.dictionary import MOST, MOST_BYTES, Dictionary, pattern_hits

INLINE = 1000
SMALL = 500
GRAM = 3


def _entries(patterns: Sequence[str], values: Sequence[str]) -> Column:
    if len(patterns) > INLINE:
        raise ValueError(f"more than {INLINE} patterns: use match_table")
    kept = [F.struct(F.lit(p.lower()).alias("k"), F.lit(v).alias("v")) for p, v in zip(patterns, values, strict=True) if p]
    return F.array(*kept) if kept else F.array().cast("array<struct<k:string,v:string>>")


def first_match(text: Column, patterns: Sequence[str], values: Sequence[str] | None = None, default: str | None = None) -> Column:
    """Value of the first pattern in dictionary order that the lower-cased text holds."""
    hit = F.get(F.filter(_entries(patterns, values or patterns), lambda e: F.contains(F.lower(F.coalesce(text, F.lit(""))), e["k"])), F.lit(0))
    return F.coalesce(hit["v"], F.lit(default))


def longest_match(text: Column, patterns: Sequence[str], values: Sequence[str] | None = None, default: str | None = None) -> Column:
    """Value of the longest pattern that the text holds; of equally long ones the first."""
    pairs = sorted(zip(patterns, values or patterns, strict=True), key=lambda x: -len(x[0]))
    return first_match(text, [p for p, _ in pairs], [v for _, v in pairs], default)


def dictionary_of(b: DataFrame, part: str) -> tuple[list[str], Dictionary] | None:
    """The distinct values of ``part`` in order, and their index; None if they are too many or too long for one."""
    size = b.select(part).distinct().agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(part)).alias("bytes")).first()
    if size["n"] > MOST or (size["bytes"] or 0) > MOST_BYTES:
        return None
    parts = sorted(r[0] for r in b.select(part).distinct().collect())
    return parts, Dictionary.of([p.encode() for p in parts])


def containing(a: DataFrame, text: str, b: DataFrame, part: str) -> DataFrame:
    """Rows of ``a`` and ``b`` where ``text`` contains ``part``, which is not empty; no column name may be in both.

    A small ``b`` is broadcast. One that fits into a ``Dictionary`` is looked up in the tasks, and only rows
    of ``a`` with what they contain meet ``b``. Beyond that the first GRAM characters of ``part`` (all of a shorter
    one) meet the distinct grams of ``text`` in an equi-join.
    """
    held = F.contains(text, part)
    b = b.filter(F.col(part) != "")
    if b.limit(SMALL + 1).count() <= SMALL:
        return a.join(F.broadcast(b), held)
    found = dictionary_of(b, part)
    if found is not None:
        parts, index = found
        numbers = a.sparkSession.createDataFrame(list(enumerate(parts)), f"_k int, `{part}` string")
        rows = a.select(F.struct("*").alias("_a"), F.col(text).alias("_t"))
        hit = pattern_hits(rows, "_t", index, "_hits").select("_a", F.explode("_hits").alias("_k"))
        held_by = b.select(F.struct(*b.columns).alias("_b"), F.col(part).alias("_p")).join(numbers.toDF("_k", "_p"), "_p").drop("_p")
        return hit.join(held_by, "_k").select("_a.*", "_b.*")

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: F.substr(F.col(text), i, F.lit(n)))

    every = F.array_distinct(F.concat(*[grams(n) for n in range(1, GRAM + 1)]))
    headed = b.withColumn("_head", F.left(F.col(part), F.lit(GRAM)))
    return a.withColumn("_gram", F.explode(every)).join(headed, (F.col("_gram") == F.col("_head")) & held).drop("_gram", "_head")


def match_table(df: DataFrame, id_: str, text: str, patterns: DataFrame, longest: bool = False) -> DataFrame:
    """(id, value) by a dictionary table (pos, pattern, value): the first pattern contained, or the longest (then the first).

    With up to MOST patterns a row finds the best of those it contains by itself, whatever their number; no row is grouped.
    """
    order = [F.col("pos")] if not longest else [-F.length("_p"), F.col("pos")]
    named = patterns.select("pos", F.lower("pattern").alias("_p"), "value").filter("_p <> ''")
    lowered = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    best_of = named.groupBy("_p").agg(F.min(F.struct(F.struct(*order).alias("order"), "value")).alias("_b"))
    count = named.limit(MOST + 1).count()
    found = dictionary_of(named, "_p") if SMALL < count <= MOST else None
    if found is None:
        hits = containing(df.select(id_, lowered.alias("_t")), "_t", best_of, "_p")
        best = hits.groupBy(id_).agg(F.min("_b").alias("_b")).select(id_, F.col("_b.value").alias("value"))
        return df.select(id_).join(best, id_, "left")
    ranked = best_of.select("_p", "_b.order", "_b.value").collect()  # as many as the dictionary has
    ranked.sort(key=lambda r: tuple(r["order"]))
    index = Dictionary.of([r["_p"].encode() for r in ranked])  # numbers in order of preference
    values = df.sparkSession.createDataFrame([(i, r["value"]) for i, r in enumerate(ranked)], f"_k int, value {named.schema['value'].dataType.simpleString()}")
    hit = pattern_hits(df.select(id_, lowered.alias("_t")), "_t", index, "_hits").select(id_, F.get("_hits", F.lit(0)).alias("_k"))
    return hit.join(values, "_k", "left").select(id_, "value")


def mixed_match(df: DataFrame, rules: DataFrame, on: str, text: str, out: str, default: float) -> DataFrame:
    """``df`` with ``out``: score of the first rule (pos, on, keyword, score) equal on ``on`` whose keyword the text holds.

    The rules of a key come as one list, in order, so each row of ``df`` meets one row and none is grouped.
    """
    lists = rules.groupBy(on).agg(F.array_sort(F.collect_list(F.struct("pos", "keyword", "score"))).alias("_rules"))
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = F.get(F.filter("_rules", lambda r: F.contains(lower, F.lower(r["keyword"]))), F.lit(0))
    return df.join(lists, on, "left").withColumn(out, F.coalesce(hit["score"], F.lit(default))).select(*df.columns, out)


def list_exists(df: DataFrame, approvals: DataFrame, on: str, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: whether any item approved for ``on`` (on, items array) is contained in the text."""
    joined = df.join(approvals, on, "left")
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    return joined.withColumn(out, F.coalesce(F.exists("items", lambda d: F.contains(lower, F.lower(d))), F.lit(False))).drop("items")


def tier_score(c: Column, tier1: Sequence[str], tier2: Sequence[str]) -> Column:
    return F.when(c.isin(*tier1), 1.0).when(c.isin(*tier2), 0.5).otherwise(0.0)


def canonical_list(df: DataFrame, id_: str, names: str, dictionary: DataFrame) -> DataFrame:
    """(id, canonical, confidence) of an array of names: the first name that hits decides.

    Per name an exact key counts 0.95, else containment either way 0.85; nothing is
    ``unmapped``, 0.10. ``dictionary`` is (pos, pattern, canonical). Empty names never match.
    """
    each = df.select(id_, F.posexplode(names).alias("_n", "_name")).withColumn("_name", F.lower(F.trim("_name"))).filter("_name <> ''")
    words = dictionary.select("pos", F.lower("pattern").alias("_p"), "canonical").filter("_p <> ''")
    columns = [id_, "_n", "_name", "pos", "_p", "canonical"]
    if words.limit(SMALL + 1).count() <= SMALL:
        hits = each.join(F.broadcast(words), F.contains("_name", "_p") | F.contains("_p", "_name"))
    else:
        hits = containing(each, "_name", words, "_p").select(columns).union(containing(words, "_p", each, "_name").select(columns))
    tier = F.when(F.col("_name") == F.col("_p"), 0).otherwise(1)
    best = hits.groupBy(id_).agg(F.min(F.struct("_n", tier.alias("tier"), "pos", "canonical")).alias("_b"))
    confidence = F.when(F.col("_b.tier") == 0, 0.95).when(F.col("_b.tier") == 1, 0.85).otherwise(0.10)
    return df.select(id_).join(best, id_, "left").select(id_, F.coalesce("_b.canonical", F.lit("unmapped")).alias("canonical"), confidence.alias("confidence"))


def canonical_text(text: Column, dictionary: Sequence[tuple[str, str, str]]) -> Column:
    """struct(drug, target, modality, mapped) of the first (drug, target, modality) whose name the text holds."""
    entries = F.array(*[F.struct(F.lit(d.lower()).alias("drug"), F.lit(t).alias("target"), F.lit(m).alias("modality")) for d, t, m in dictionary if d])
    hit = F.get(F.filter(entries, lambda e: F.contains(F.lower(F.coalesce(text, F.lit(""))), e["drug"])), F.lit(0))
    return F.struct(
        F.coalesce(hit["drug"], F.lit("unmapped")).alias("drug"),
        F.coalesce(hit["target"], F.lit("UNKNOWN")).alias("target"),
        F.coalesce(hit["modality"], F.lit("unknown")).alias("modality"),
        hit.isNotNull().cast("int").alias("mapped"),
    )


def priority_match(text: Column, rules: Sequence[tuple[str, str, float]], default: tuple[str, float]) -> Column:
    """struct(value, confidence) of the first (pattern, value, confidence) in order."""
    entries = F.array(*[F.struct(F.lit(p.lower()).alias("k"), F.lit(v).alias("value"), F.lit(float(c)).alias("confidence")) for p, v, c in rules if p])
    hit = F.get(F.filter(entries, lambda e: F.contains(F.lower(F.coalesce(text, F.lit(""))), e["k"])), F.lit(0))
    return F.struct(F.coalesce(hit["value"], F.lit(default[0])).alias("value"), F.coalesce(hit["confidence"], F.lit(default[1])).alias("confidence"))


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def any_indicator(text: Column, words: Sequence[str]) -> Column:
    """1 if the lower-cased text holds any of the words (inside words too), else 0."""
    return any_of(text, words).cast("int")
