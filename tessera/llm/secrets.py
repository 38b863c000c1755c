"""Secret scan: base patterns, and weak candidates linked to their complementary parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?=[pPsStTaA])(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# Weak parts: what identifies an account, what may be key material, and where it is used.
IDENTIFIER = r"""(?<![\p{L}\p{N}_])(?=[uUlLaAcCtT])(?i)(?:user(?:name)?|login|account|client_?id|access_?key_?id|tenant)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
MATERIAL = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?<![\p{L}\p{N}_])(?=[hHsSfFpPmMrRaA])(?i)(?:(?:https?|s3|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|host(?:name)?["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,})"""

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "material", "endpoint")

#: What a text must have to hold a match of the kind; it is cheaper to look for.
SIGN, KEY, RUN = "sign", "key", "run"
NEEDS = {"assign": SIGN, "access": KEY, "hex": RUN, "identifier": SIGN, "material": RUN, "endpoint": SIGN}
LONG_RUN = r"[A-Za-z0-9+/_-]{20}"

#: What a match of the kind does in a linked credential, and its fewest characters of the value group.
ROLES = {"assign": "m", "access": "i", "hex": "m", "identifier": "i", "material": "m", "endpoint": "e"}
PATTERNS = {
    "assign": (ASSIGN, 2, 8),
    "access": (ACCESS, 0, 0),
    "hex": (HEX, 0, 0),
    "identifier": (IDENTIFIER, 0, 0),
    "material": (MATERIAL, 0, 0),
    "endpoint": (ENDPOINT, 0, 0),
}


def match_lengths(text: Column, gaps: Column, pattern: str, value_group: int, least: int) -> Column:
    """array<struct<gap,size,counts>> of the leftmost non-overlapping matches, in code points.

    ``gaps`` is the text split at the pattern: what stands between a match and the one before
    it. ``counts`` is false where group ``value_group`` of a match has fewer than ``least`` characters:
    such a match is consumed all the same. A text is searched once for the gaps and, if it
    has a match, once more for the matches, in each of which the group is then found.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def entry(m: Column, gap: Column) -> Column:
        counts = F.length(F.regexp_extract(m, pattern, value_group)) >= least if least else F.lit(True)
        return F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), counts.alias("counts"))

    zipped = F.zip_with(found, F.slice(gaps, 1, F.size(gaps) - 1), entry)
    return F.when(F.size(gaps) > 1, zipped).otherwise(F.array().cast("array<struct<gap:int,size:int,counts:boolean>>"))


def scan_secrets(docs: DataFrame, scope: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``spans`` array<struct<start, kind, end>>, kinds as in ``KINDS``.

    Base kinds are always reported. The weak kinds identifier, material and endpoint are
    reported only where complementary parts stand within ``scope`` code points of each
    other: material or an identifier needs the other one (a base access key counts as
    identifier, a base assign or hex match as material), an endpoint needs both. Parts meet
    in an interval join on (row, block of the scope); a block holds few parts since parts
    do not overlap within a kind, so a long document spreads over many blocks. Positions are
    running sums over a row's matches, so the work grows with their number alone.

    Null text counts as empty and has no spans. Rows that repeat an id are scanned each on
    its own. An empty table gives an empty result. Columns not named are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), text.alias("_text"))
    text = F.col("_text")
    needs = {SIGN: text.contains(":") | text.contains("="), KEY: text.contains("AKIA"), RUN: text.rlike(LONG_RUN)}
    gaps = rows.withColumns({f"_has_{k}": c for k, c in needs.items()})
    gaps = gaps.withColumns({f"_gaps_{k}": F.when(F.col(f"_has_{NEEDS[k]}"), F.split("_text", PATTERNS[k][0], -1)).otherwise(F.array("_text")) for k in KINDS})
    rows = stage(gaps.select("_row", "doc_id", *[match_lengths(F.col("_text"), F.col(f"_gaps_{k}"), *PATTERNS[k]).alias(k) for k in KINDS]))

    def tagged(n: int, k: str) -> Column:
        return F.transform(F.col(k), lambda x, i: F.struct(F.lit(n).alias("kind"), F.lit(ROLES[k]).alias("role"), i.alias("at"), x["gap"].alias("gap"), x["size"].alias("size"), x["counts"].alias("counts")))

    matches = rows.select("_row", F.inline(F.concat(*[tagged(n, k) for n, k in enumerate(KINDS)]))).repartition("_row")
    upto = Window.partitionBy("_row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = matches.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")).filter("counts")
    placed = placed.select("_row", "kind", "role", (F.col("end") - F.col("size")).alias("start"), "end")
    # a weak part inside a base match says nothing new; of equal starts base kinds come first
    before = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weak = F.col("kind") >= len(BASE)
    inside = weak & F.coalesce(F.max(F.when(~weak, F.col("end"))).over(before) >= F.col("end"), F.lit(False))
    parts = stage(placed.withColumn("inside", inside))
    first, last = F.floor(F.col("start") / scope), F.floor((F.col("end") + scope) / scope)
    blocked = parts.withColumn("_block", F.explode(F.sequence(first, last)))
    mine, other = blocked.filter(weak & ~F.col("inside")).alias("a"), blocked.alias("b")
    near = (
        (F.col("a._row") == F.col("b._row"))
        & (F.col("a._block") == F.col("b._block"))
        & (F.col("b.start") <= F.col("a.end") + scope)
        & (F.col("a.start") <= F.col("b.end") + scope)
        & (F.col("a.role") != F.col("b.role"))
        & (F.col("b.role") != "e")
        # the same characters are not their own complement
        & ((F.col("b.end") <= F.col("a.start")) | (F.col("a.end") <= F.col("b.start")))
    )
    linked = (
        mine.join(other, near)
        .groupBy("a._row", "a.start", "a.kind", "a.end", "a.role")
        .agg(F.max(F.col("b.role") == "i").alias("_i"), F.max(F.col("b.role") == "m").alias("_m"))
        .filter("CASE role WHEN 'i' THEN _m WHEN 'm' THEN _i ELSE _i AND _m END")
    )
    found = parts.filter(~weak).select("_row", "start", "kind", "end").unionByName(linked.select("_row", "start", "kind", "end"))
    per_row = found.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    names = F.array(*map(F.lit, KINDS))
    named = F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.element_at(names, x["kind"] + 1).alias("kind"), x["end"].alias("end")))
    empty = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    return rows.select("_row", "doc_id").join(per_row, "_row", "left").select("doc_id", F.coalesce(named, empty).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
