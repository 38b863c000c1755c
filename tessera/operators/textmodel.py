"""A logistic model over terms and scaled numbers, all of whose preparation is learned from its train rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.operators.models import Fit, logistic
from tessera.operators.prefix import column_medians
from tessera.operators.text import Terms, fit_terms, spread, term_weights
from tessera.sources.scratch import scratch_path

#: Rows that a task of a fit's pass has at least, where there are so many.
LEAST = 2000


@dataclass(frozen=True)
class Numbers:
    """Train medians, which columns train lacks somewhere, and mean and deviation of what ``filled`` gives."""

    medians: dict[str, float]
    lacking: tuple[str, ...]
    means: tuple[float, ...] = ()
    deviations: tuple[float, ...] = ()

    @property
    def names(self) -> list[str]:
        return [*self.medians, *[f"{c}_indicator" for c in self.lacking]]

    def filled(self) -> list[Column]:
        """Columns with the median for what is missing, then 0/1 for where it was."""
        value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in self.medians}
        return [*[F.coalesce(v, F.lit(float(self.medians[c]))) for c, v in value.items()], *[value[c].isNull().cast("double") for c in self.lacking]]

    def scaled(self) -> list[Column]:
        return [(x - F.lit(m)) / F.lit(d or 1.0) for x, m, d in zip(self.filled(), self.means, self.deviations, strict=True)]


def fit_numbers(train: DataFrame, columns: Sequence[str]) -> Numbers:
    """Two passes over ``train``: exact medians (0 for a column without values), then means and deviations, indicators included."""
    if not columns:
        return Numbers({}, ())
    middle, missing = column_medians(train, columns)
    first = Numbers({c: middle[c] if middle[c] is not None else 0.0 for c in columns}, tuple(c for c in columns if missing[c]))
    cols = first.filled()
    r = train.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(cols)], *[F.stddev_pop(x).alias(f"d{i}") for i, x in enumerate(cols)]).first()
    return Numbers(first.medians, first.lacking, tuple(r[f"m{i}"] or 0.0 for i in range(len(cols))), tuple(r[f"d{i}"] or 0.0 for i in range(len(cols))))


@dataclass(frozen=True)
class TextModel:
    """Scores rows one by one: called with rows, gives them with ``probability``."""

    terms: Terms
    numbers: Numbers
    text: str
    weight: float
    coefficients: list[float]
    intercept: float

    @property
    def names(self) -> list[str]:
        """Of the coefficients: terms, then numbers."""
        return [*self.terms.terms, *self.numbers.names]

    def __call__(self, df: DataFrame) -> DataFrame:
        n = len(self.terms.terms)
        by_index = F.from_json(F.lit(json.dumps(self.coefficients[:n])), "array<double>")
        rows = df.select(F.struct("*").alias("_given"), F.col(self.text).alias("_t"), F.array(*self.numbers.scaled()).cast("array<double>").alias("_n"))
        rows = term_weights(rows, self.terms, "_t", "_x", self.weight)
        margin = F.aggregate("_x", F.lit(self.intercept), lambda a, x: a + x["weight"] * F.get(by_index, x["index"]))
        margin = reduce(Column.__add__, [F.get("_n", F.lit(i)) * F.lit(b) for i, b in enumerate(self.coefficients[n:])], margin)
        return rows.select("_given.*", (1 / (1 + F.exp(-margin))).alias("probability"))


def term_vectors(df: DataFrame, label: str, terms: Terms, numbers: Numbers, text: str, weight: float = 1.0) -> DataFrame:
    """(label, features): sparse vectors of term weights and scaled numbers, written once for the passes of a fit.

    A sparse vector is stored as a struct, so the struct is written and read back as a vector: no row passes through Python.
    """
    n = len(terms.terms)
    block = F.array(*numbers.scaled()).cast("array<double>")
    rows = term_weights(spread(df.select(F.col(label).alias("label"), F.col(text).alias("_t"), block.alias("_n"))), terms, "_t", "_x", weight)
    places = F.sequence(F.lit(n), F.lit(n + len(numbers.names) - 1)) if numbers.names else F.array().cast("array<int>")
    indices, values = F.concat(F.transform("_x", lambda x: x["index"]), places), F.concat(F.transform("_x", lambda x: x["weight"]), F.col("_n"))
    size = F.lit(n + len(numbers.names))
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), size.alias("size"), indices.alias("indices"), values.alias("values"))
    path = scratch_path(df.sparkSession, "vectors")
    out = rows.select("label", stored.alias("features"))
    out.write.parquet(path)
    read = df.sparkSession.read.schema(StructType([out.schema["label"], StructField("features", VectorUDT())])).parquet(path)
    return read.coalesce(max(1, min(read.rdd.getNumPartitions(), read.count() // LEAST)))  # a pass of a fit over few rows costs its tasks


def fit_text(train: DataFrame, label: str, text: str, numeric: Sequence[str] = (), c: float = 1.0, min_df: int = 2, top: int = 5000, weight: float = 3.0, stop_words: Sequence[str] | None = None, iterations: int = 200, shared: dict | None = None) -> TextModel:
    """L2 logistic regression over the TF-IDF weights of ``text`` and, beside them, scaled ``numeric`` columns.

    Vocabulary, idf, medians and scales come from ``train`` alone. With numbers the terms weigh ``weight`` times as
    much, without them once. Missing numbers take the train median and a 0/1 column where train lacks some.
    Labels other than 0 and 1 are not for training. An error if there is neither a term nor a number. ``shared`` keeps
    the vocabulary for other fits on the same train rows.
    """
    train = train.filter(F.col(label).isin(0, 1))
    shared, key = {} if shared is None else shared, (label, text, min_df, top, None if stop_words is None else tuple(stop_words))
    if key not in shared:
        shared[key] = fit_terms(train, text, min_df, top, stop_words)
    terms, numbers = shared[key], fit_numbers(train, numeric)
    if not terms.terms and not numbers.names:
        raise ValueError("no term and no number to fit on")
    scale = weight if numbers.names else 1.0
    model = logistic(term_vectors(train, label, terms, numbers, text, scale), "label", c, iterations=iterations)
    return TextModel(terms, numbers, text, scale, [float(x) for x in model.coefficients.toArray()], float(model.intercept))


def text_fitter(label: str, text: str, numeric: Sequence[str] = (), **options: object) -> Fit:
    """``fit_text`` as a candidate for the runners of ``models``; its ``sharing`` is one that shares vocabularies."""
    sharing = lambda shared: lambda train: fit_text(train, label, text, numeric, **options, shared=shared)
    fit = lambda train: sharing({})(train)
    fit.sharing = sharing
    return fit
