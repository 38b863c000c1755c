"""Running sums over one global order without bringing the order to one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Rows of the sample that cut points are taken from, in each group.
SAMPLE = 512
#: Of so many distinct keys one is drawn for the quantiles that cut a numeric order.
DRAWN = 16
#: Accuracy of the sketch that bounds medians.
SKETCH = 10_000


def _cut_points(base: DataFrame, group: list[str], order: Sequence[str], blocks: int) -> DataFrame:
    """(group, _cuts): up to ``blocks`` - 1 increasing places of the order (an array of structs).

    One row of each of SAMPLE buckets of a hash, that of the smallest second hash, is a sample of a
    group that depends on its rows alone.
    """
    place = F.struct(*order)
    bucket, draw = F.pmod(F.xxhash64(*order), F.lit(SAMPLE)), F.xxhash64(F.lit("cut"), *order)
    each = base.groupBy(*group, bucket.alias("_b")).agg(F.min_by(place, draw).alias("_s"))
    cuts = each.groupBy(*group).agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    step = F.size("_s") / F.lit(float(blocks))
    at = F.transform(F.sequence(F.lit(1), F.lit(blocks - 1)), lambda i: F.get("_s", F.floor(i * step).cast("int")))
    return cuts.select(*group, F.array_distinct(at).alias("_cuts"))


def _matches(left: str, right: str, columns: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]


def cumulative(df: DataFrame, by: list[str], key: str, sums: dict[str, str], descending: bool = False, ties: list[str] | None = None, blocks: int = 64) -> DataFrame:
    """``df`` with running sums ``{new: column}`` in order of ``key`` (then ``ties``) in each group of ``by``.

    Each group is cut into up to ``blocks`` ranges of its order; a range is summed on its own and
    starts from the totals of those before it. So a group that holds most rows, or the whole
    table where ``by`` is empty, is spread over tasks. A numeric key without ties is cut at its
    quantiles; any other key (text, a struct) and ties at places of a sample of rows, so rows that
    share a key are spread as well where ties tell them apart. Nulls come first. ``descending`` is for
    numeric keys. With ``blocks`` 1 a group is summed in one task: for many groups of a bounded size.
    """
    group = [*by, "_group"]
    numeric = isinstance(df.schema[key].dataType, NumericType)
    if descending and not numeric:
        raise ValueError("a descending order needs a numeric key")
    base = df.withColumn("_group", F.lit(0)).withColumn("_k", -F.col(key) if descending else F.col(key))
    order = ["_k", *(ties or [])]
    sorting = [F.col(c).asc_nulls_first() for c in order]
    if blocks == 1:
        alone = Window.partitionBy(*by).orderBy(*sorting).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return base.withColumns({n: F.sum(c).over(alone) for n, c in sums.items()}).drop("_group", "_k")
    if numeric and not ties:
        quantiles = F.percentile_approx(F.col("_k").cast("double"), [i / blocks for i in range(1, blocks)], 1000)
        some = base.filter(F.pmod(F.xxhash64("_k"), F.lit(DRAWN)) == 0)  # of many keys a part finds the places; the sums are over all
        cuts, place = some.groupBy(*group).agg(quantiles.alias("_cuts")), F.col("_k").cast("double")
    else:
        cuts, place = _cut_points(base, group, order, blocks), F.struct(*order)
    cut = base.alias("l").join(cuts.alias("r"), _matches("l", "r", group), "left").select("l.*", "_cuts")
    below = F.size(F.filter("_cuts", lambda x: x < place))
    cut = cut.withColumn("_block", F.when(place.isNull() | F.col("_cuts").isNull(), -1).otherwise(below)).drop("_cuts")
    inside = Window.partitionBy(*group, "_block").orderBy(*sorting).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = cut.groupBy(*group, "_block").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    running = cut.withColumns({f"_s_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    out = running.alias("l").join(offsets.alias("r"), _matches("l", "r", [*group, "_block"]), "left").select("l.*", *[f"_o_{n}" for n in sums])
    out = out.withColumns({n: F.col(f"_s_{n}") + F.col(f"_o_{n}") for n in sums})
    return out.drop("_group", "_k", "_block", *[f"_s_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def ordinal(df: DataFrame, by: list[str], key: str, name: str, descending: bool = False, ties: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``, the place (from 1) of each row in its group's order."""
    return cumulative(df.withColumn("_one", F.lit(1).cast("long")), by, key, {name: "_one"}, descending, ties).drop("_one")


def _middle(df: DataFrame, by: list[str], value: Column, low: Column, high: Column, n: Column) -> DataFrame:
    """(by, median) of ``value``, given per row what its group's median lies between and the group's size.

    Values below count as one, those above not at all; so what is ordered is the few values between.
    """
    kept = df.select(*by, value.alias("_v"), low.alias("_low"), high.alias("_high"), n.alias("_total")).filter("_v <= _high")
    counts = kept.groupBy(*by, F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.first("_total").alias("_total"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(F.col("_k").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("_upto", upto)

    def at(place: Column) -> Column:
        found = F.max(F.when((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n")), F.col("_k")))
        return F.coalesce(found, F.raise_error(F.lit("a median lies outside the bounds of its sketch")))

    return placed.groupBy(*by).agg(((at(F.floor((F.col("_total") - 1) / 2)) + at(F.floor(F.col("_total") / 2))) / 2).alias("median"))


def _bounds(value: Column) -> Column:
    """Two values with the median between them: quantiles by a sketch, apart by five times its error on either side."""
    return F.percentile_approx(value, [0.5 - 5 / SKETCH, 0.5 + 5 / SKETCH], SKETCH)


def medians(df: DataFrame, by: list[str], column: str, few: bool = False) -> DataFrame:
    """(by, median) of the values of ``column`` but nulls and NaN: exact, the mean of the middle two of an even number.

    Two passes: a sketch bounds each group's median, then the values between the bounds, about a thousandth of a
    group, are counted and ordered. No task holds the values of a group. ``few`` says that there are so few groups that
    their bounds can be sent to all executors; the rows never are (an outer join allows that for the bounds alone).
    """
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*by, value.alias("_x")).filter("_x IS NOT NULL").withColumn("_all", F.lit(0))
    keys = [*by, "_all"]
    found = rows.groupBy(*keys).agg(_bounds(F.col("_x")).alias("_q"), F.count(F.lit(1)).alias("_c"))
    found = F.broadcast(found) if few else found
    both = rows.alias("l").join(found.alias("r"), reduce(Column.__and__, _matches("l", "r", keys)), "left").select("l.*", "_q", "_c")
    high = F.coalesce(F.get("_q", F.lit(1)), F.lit(float("inf")))  # never null, else the filter by it makes the join an inner one
    return _middle(both, keys, F.col("_x"), F.get("_q", F.lit(0)), high, F.col("_c")).drop("_all")


def column_medians(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, float | None], dict[str, int]]:
    """The exact median of each column, None without values, and how many values it lacks (nulls and NaN). Two passes for all."""
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    aggs = [x for i, c in enumerate(columns) for x in (_bounds(value[c]).alias(f"q{i}"), F.count(value[c]).alias(f"c{i}"))]
    found = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    some = [(i, c) for i, c in enumerate(columns) if found[f"c{i}"]]
    middle: dict[str, float | None] = dict.fromkeys(columns)
    if some:
        each = [F.struct(F.lit(i).alias("i"), value[c].alias("v"), *[F.lit(float(x)).alias(f) for f, x in zip(("low", "high"), found[f"q{i}"], strict=True)], F.lit(found[f"c{i}"]).alias("n")) for i, c in some]
        long = df.select(F.explode(F.array(*each)).alias("x")).select("x.*").filter("v IS NOT NULL")
        got = {r["i"]: r["median"] for r in _middle(long, ["i"], F.col("v"), F.col("low"), F.col("high"), F.col("n")).collect()}  # one row per column
        middle |= {c: got[i] for i, c in some}
    return middle, {c: found["n"] - found[f"c{i}"] for i, c in enumerate(columns)}
