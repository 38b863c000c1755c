"""Column expressions that many operators share."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = ("", "unknown", "unmapped", "none", "nan", "null", "n/a")


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Whether the lower-cased text holds any of the words; false for null."""
    return F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(F.lower(F.coalesce(text, F.lit(""))), k))


def count_of(text: Column, words: Iterable[str]) -> Column:
    """How many different words the lower-cased text holds."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(F.lower(F.coalesce(text, F.lit(""))), k)))


def entity_key(c: Column, unknown: Sequence[str] = UNKNOWN, otherwise: str | None = None) -> Column:
    """Trimmed and lower-cased; what means unknown becomes null, or ``otherwise``."""
    cleaned = F.lower(F.trim(c))
    key = F.when(~cleaned.isin(*unknown), cleaned)
    return key if otherwise is None else F.coalesce(key, F.lit(otherwise))


def pair_key(*parts: Column) -> Column:
    """The parts joined by ' | '; null if one is null."""
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(" | "), p)
    return out


def leading_year(c: Column) -> Column:
    return F.left(c, F.lit(4)).try_cast("int")


def number(c: Column, default: float | None = 0.0) -> Column:
    """A finite double, else ``default``."""
    x = c.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x).otherwise(F.lit(default).cast("double"))


def lookup(c: Column, table: dict, default) -> Column:  # noqa: ANN001
    """Value of a small dictionary, else ``default``."""
    if not table:
        return F.lit(default)
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def hash_order(id_: Column, seed: str) -> Column:
    """A long in [0, 2^32) that depends on the id and the seed: the order of seeded shuffles."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string"))), 1, 8), 16, 10).cast("long")


def capped(c: Column, top: float = 1.0) -> Column:
    """min(c, top), null staying null (``least`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(c.cast("double"), F.lit(top)))
