"""Text classifiers, signals and TF-IDF."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tessera.functions.columns import any_of, count_of
from tessera.sources.arrow import map_arrow
from tessera.sources.scratch import written

#: A word of TF-IDF, how many terms a task counts at a time, and how many rows it reads at a time.
WORD = re.compile(r"\w\w+")
HELD = 100_000
WEIGHED = 256
#: Bits of the bucket that a bigram is counted in, and odd numbers that its words' hashes are multiplied by.
BITS = 20
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

# Words of the endpoint classifier, of its result-title variant, and codes.
SURVIVAL = ("overall survival", "mortality", "time to death")
PROGRESSION = ("progression-free", "progression free", "time to progression")
RESPONSE = ("response rate", "objective response", "complete response", "partial response", "disease control rate", "clinical benefit rate")
BIOMARKER = ("biomarker", "expression", "mutation")
TITLE_RULES = (
    ("survival", ("overall survival", "os ", "death")),
    ("pfs", ("progression", "pfs", "progression-free")),
    ("response", ("response", "orr", "objective response", "complete response")),
    ("biomarker", ("biomarker", "expression", "mutation")),
)
ENDPOINT_CODES = {"survival": 0, "pfs": 1, "response": 2, "biomarker": 3, "other": 4}
# Stop reasons.
SAFETY = ("toxicity", "adverse", "safety", "side effect", "dose limiting")
ACCRUAL = ("poor accrual", "slow enrollment", "low enrollment", "insufficient enrollment", "inadequate accrual", "accrual", "enrollment", "recruitment difficulty")


def endpoint_class(text: Column) -> Column:
    """survival, pfs, response, biomarker, other; null for blank text. The first rule that holds wins."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(F.trim(t) == "", F.lit(None))
        .when(any_of(t, SURVIVAL) | (t.rlike(r"\bos\b") & ~t.rlike(r"\bdose\b")), "survival")
        .when(any_of(t, PROGRESSION) | t.rlike(r"\bpfs\b"), "pfs")
        .when(any_of(t, RESPONSE) | t.rlike(r"\borr\b"), "response")
        .when(any_of(t, BIOMARKER), "biomarker")
        .otherwise("other")
    )


def endpoint_code(kind: Column) -> Column:
    out = F.when(kind.isNull(), -1)
    for k, v in ENDPOINT_CODES.items():
        out = out.when(kind == k, v)
    return out.otherwise(4)


def result_endpoint(title: Column) -> Column:
    """As ``endpoint_class`` for result titles: substrings only."""
    out = None
    for kind, words in TITLE_RULES:
        out = F.when(any_of(title, words), kind) if out is None else out.when(any_of(title, words), kind)
    return out.otherwise("other")


def text_signal(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """negative if it has any negative trigger and no more positive ones; else positive if any; else neutral."""
    pos, neg = count_of(text, positive), count_of(text, negative)
    return F.when((neg > 0) & (neg >= pos), "negative").when(pos > 0, "positive").otherwise("neutral")


def stop_flags(reason: Column, efficacy: Sequence[str]) -> dict[str, Column]:
    return {"is_efficacy": any_of(reason, efficacy), "is_safety": any_of(reason, SAFETY), "is_accrual": any_of(reason, ACCRUAL)}


def tolerant_number(c: Column) -> Column:
    """A double from text such as ``<0.05``; null if it is none."""
    return F.trim(F.regexp_replace(c, "[<>]", "")).try_cast("double")


def last_number(values: Column) -> Column:
    """The last of an array of texts that is a number."""
    found = F.filter(F.transform(values, tolerant_number), lambda x: x.isNotNull())
    return F.try_element_at(found, F.lit(-1))


def filled_mechanism(given: Column, derived: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), derived, F.lit("unknown"))


def modality_class(modality: Column, biologics: Sequence[str]) -> Column:
    return F.when(F.lower(modality).isin(*biologics), "biologic").otherwise("small_molecule")


def completed_without_results(status: Column, posted: Column) -> Column:
    return ((status == "COMPLETED") & (posted.isNull() | (posted == ""))).cast("int")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores where a small table has fewer; for work that is dear by the row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@dataclass
class Words:
    """Words of some rows: all as they are, then places, numbers and rows of those that are no stop words, and which of these are followed by another in their row."""

    texts: list[list[str]]
    flat: list[str]
    place: np.ndarray
    number: np.ndarray
    row: np.ndarray
    follows: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, numbers: Callable[[list[str]], Iterator[int]], stop_words: Container[str]) -> Words:
        """Words are lower-cased and have two or more word characters; ``numbers`` gives a number for each."""
        texts = [WORD.findall((x.as_py() or "").lower()) for x in column]
        flat = list(chain.from_iterable(texts))
        place = np.flatnonzero(~np.fromiter(map(stop_words.__contains__, flat), bool, len(flat)))
        number = np.fromiter(numbers(flat), np.int64, len(flat))[place]
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[place]
        return cls(texts, flat, place, number, row, np.flatnonzero(row[1:] == row[:-1]))

    def buckets(self) -> np.ndarray:
        """Of each two words that follow each other, by ``follows``; numbers are hashes."""
        h = self.number.astype(np.uint64)
        return ((h[self.follows] * FIRST + h[self.follows + 1] * SECOND) >> np.uint64(64 - BITS)).astype(np.int64)


def hashes(words: list[str]) -> Iterator[int]:
    return map(zlib.crc32, map(str.encode, words))


@dataclass(frozen=True)
class Terms:
    """A vocabulary with its weights, learned from some rows; a term's place is its index."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    stop_words: tuple[str, ...]


def counted(rows: Counter[str], total: Counter[str], stop_words: Iterable[str] = ()) -> pa.RecordBatch:
    """(term, bucket, df, total) of what a task counted, less stop words; both begin anew."""
    for t in stop_words:
        rows.pop(t, None)
    found = pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.string()), pa.nulls(len(rows), pa.int32()), pa.array(rows.values(), pa.int64()), pa.array([total[t] for t in rows], pa.int64())], COUNTED)
    rows.clear()
    total.clear()
    return found


COUNTED = ["term", "bucket", "df", "total"]


def fit_terms(train: DataFrame, text: str, min_df: int = 2, top: int = 5000, stop_words: Sequence[str] | None = None) -> Terms:
    """The vocabulary of ``train`` alone: uni- and bigrams in ``min_df`` rows or more, the ``top`` most frequent, ties by the term.

    A term weighs ln((1 + rows) / (1 + rows with it)) + 1. Terms are counted in two passes, as most bigrams are rare: the first
    counts words, and bigrams by a hash of BITS bits alone. A bigram stands no more often than all of its bucket,
    so only those of buckets that have as many as the last of the ``top`` words (or ``min_df``, where there are fewer words) can be among the most frequent;
    the second pass counts these one by one. The result is that of counting all. Tasks count up to HELD terms at a time,
    so what is exchanged are partial sums by term or bucket. The vocabulary, which ``top`` bounds, and a bit for each bucket
    come to the driver. Null and empty texts have no terms but count as rows.
    """
    stops = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else list(stop_words)
    texts, known = spread(train.select(F.col(text).cast("string"))), frozenset(stops)

    def slices(parts: Iterator[pa.RecordBatch]) -> Iterator[Words]:
        for batch in parts:
            for start in range(0, batch.num_rows, WEIGHED):
                yield Words.of(batch.column(0).slice(start, WEIGHED), hashes, known)

    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, buckets = Counter[str](), Counter[str](), np.zeros(1 << BITS, np.int64)
        for words in slices(parts):
            buckets += np.bincount(words.buckets(), minlength=1 << BITS)
            rows.update(chain.from_iterable(map(set, words.texts)))
            total.update(words.flat)
            if len(rows) > HELD:
                yield counted(rows, total, known)
        yield counted(rows, total, known)
        some = np.flatnonzero(buckets)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.array(some, pa.int32()), pa.array(np.zeros(len(some), np.int64)), pa.array(buckets[some])], COUNTED)

    def summed(run: Callable) -> DataFrame:
        each = map_arrow(texts, run, "term string, bucket int, df bigint, total bigint")
        return each.groupBy("term", "bucket").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))

    def most(found: DataFrame) -> list[tuple[str, int, int]]:
        return [tuple(r) for r in found.filter(F.col("df") >= min_df).orderBy(F.col("total").desc(), "term").limit(top).select("term", "df", "total").collect()]

    sums = written(summed(first))
    singles = most(sums.filter("term IS NOT NULL"))
    least = singles[-1][2] if len(singles) == top else min_df
    likely = np.zeros(1 << BITS, bool)
    likely[sums.filter(F.col("bucket").isNotNull() & (F.col("total") >= least)).select("bucket").toArrow().column("bucket").to_numpy()] = True
    packed = np.packbits(likely)

    def second(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, wanted = Counter[str](), Counter[str](), np.unpackbits(packed).astype(bool)
        for words in slices(parts):
            at = words.follows[wanted[words.buckets()]]
            pairs = [f"{words.flat[a]} {words.flat[b]}" for a, b in zip(words.place[at].tolist(), words.place[at + 1].tolist(), strict=True)]
            total.update(pairs)
            rows.update(t for _, t in set(zip(words.row[at].tolist(), pairs, strict=True)))
            if len(rows) > HELD:
                yield counted(rows, total)
        yield counted(rows, total)

    pairs = most(summed(second)) if likely.any() else []
    kept = sorted(singles + pairs, key=lambda r: (-r[2], r[0]))[:top]
    n = train.count()
    return Terms(tuple(t for t, _, _ in kept), tuple(math.log((1 + n) / (1 + df)) + 1 for _, df, _ in kept), tuple(stops))


def term_weights(df: DataFrame, terms: Terms, text: str, name: str = "weights", weight: float = 1.0) -> DataFrame:
    """``df`` with ``name``, an array of structs (index, term, weight) by index: (1 + ln tf) x idf, each row of length ``weight``.

    A row is weighed on its own, by a vocabulary that other rows may have taught: no exchange. Terms that
    the vocabulary lacks count for nothing; a row without any has an empty array.
    """
    fields = [f.name for f in df.schema]
    place_of = fields.index(text) if text in fields and isinstance(df.schema[text].dataType, StringType) else None
    kind = pa.list_(pa.struct([("index", pa.int32()), ("term", pa.string()), ("weight", pa.float64())]))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = [t.split(" ") for t in terms.terms]
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        stops, many, coded = frozenset(terms.stop_words), len(number) + 1, []
        single = np.full(many, -1, np.int64)
        for i, t in enumerate([number[w] for w in t] for t in split):
            if len(t) == 1:
                single[t[0]] = i
            if len(t) == 2:
                coded.append((t[0] * many + t[1], i))
        coded.sort()
        codes, index_of = (np.array([x[k] for x in coded], np.int64) for k in range(2))
        idf, every = np.array(terms.idf), pa.array(terms.terms, pa.string())
        for batch in parts:
            for start in range(0, batch.num_rows, WEIGHED):  # what a task holds beside its batch doesn't grow with the batch
                given = batch.column("_row").slice(start, WEIGHED).flatten()
                words = Words.of(batch.column("_text").slice(start, WEIGHED) if place_of is None else given[place_of], lambda flat: map(number.get, flat, repeat(-1)), stops)
                one = np.where(words.number >= 0, single[words.number], -1)
                a, b = words.number[words.follows], words.number[words.follows + 1]
                pair = np.where((a >= 0) & (b >= 0), a * many + b, -1)
                near = np.minimum(np.searchsorted(codes, pair), max(0, len(codes) - 1))
                two = np.where(codes[near] == pair, index_of[near], -1) if len(codes) else np.full(len(pair), -1)
                found, row = np.concatenate([one, two]), np.concatenate([words.row, words.row[words.follows]])
                key, times = np.unique((row * len(every) + found)[found >= 0], return_counts=True)
                row, at = np.divmod(key, max(1, len(every)))
                size = np.bincount(row, minlength=len(given[0]))
                raw = (1 + np.log(times)) * idf[at]
                scaled = raw / np.sqrt(np.bincount(row, raw * raw, len(size)))[row] * weight
                at = pa.array(at.astype(np.int32))
                found = pa.StructArray.from_arrays([at, every.take(at), pa.array(scaled)], names=["index", "term", "weight"])
                offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*given, pa.ListArray.from_arrays(offsets, found).cast(kind)], [*fields, name])

    item = StructType([StructField("index", IntegerType()), StructField("term", StringType()), StructField("weight", DoubleType())])
    other = [F.col(text).cast("string").alias("_text")] if place_of is None else []  # a text that the row holds isn't sent twice
    rows = df.select(F.struct("*").alias("_row"), *other)
    return map_arrow(rows, batches, StructType([*df.schema.fields, StructField(name, ArrayType(item))]))


def tfidf(df: DataFrame, id_: str, text: str, min_df: int = 2, top: int = 5000, stop_words: Sequence[str] | None = None, weight: float = 1.0) -> DataFrame:
    """(id, term, weight) of the rows by the vocabulary that they teach themselves; see ``fit_terms`` and ``term_weights``."""
    terms = fit_terms(df, text, min_df, top, stop_words)
    rows = term_weights(spread(df.select(F.col(id_).alias("_id"), F.col(text).alias("_t"))), terms, "_t", "_x", weight)
    return rows.select(F.col("_id").alias(id_), F.explode("_x").alias("x")).select(id_, "x.term", "x.weight")
