"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm.common import map_arrow, stage

UNKNOWN = "und"
#: Bound of what is sent to every task: so many languages, each with ``top`` n-grams.
MOST_LANGUAGES = 10_000
_CODE = 21
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def ngrams(text: str) -> np.ndarray:
    """Keys of the 1- to 3-grams of the lower-cased words of ``text``; words are runs of letters.

    Words are padded by one space on either side. A key has 21 bits for each character, so keys
    of different lengths differ. Empty if there is no letter.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = letters()[code]
    if not letter.any():
        return np.zeros(0, np.int64)
    code = np.where(letter, code, 32)
    code = np.concatenate(([32], code[letter | np.append(True, letter[:-1])], [32]))
    if code[1] == 32:
        code = code[1:]
    if code[-2] == 32:
        code = code[:-1]
    pairs = (code[:-1] << _CODE) | code[1:]
    triples = (pairs[:-1] << _CODE) | code[2:]
    return np.concatenate((code[code != 32], pairs, triples[code[1:-1] != 32]))


def ranked(keys: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent keys in order of rank; equal counts in order of the key."""
    values, count = np.unique(keys, return_counts=True)
    return values[np.argsort(-count, kind="stable")[:top]]


def learn_profiles(docs: DataFrame, top: int = 400) -> DataFrame:
    """(lang, key, rank) of (lang, text): the ``top`` n-grams of each language over all rows.

    Rows without a language or text are left out. Counts are summed in each task before the
    shuffle, and the ranks taken first within parts of a language, so a language that most rows
    have is not ranked in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(lang: str, keys: list[np.ndarray]) -> pa.RecordBatch:
            values, count = np.unique(np.concatenate(keys), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(count)], ["lang", "key", "count"])

        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1)
            for i, lang in enumerate(batch.column(0).to_pylist()):
                keys = ngrams(texts[i].as_py())
                held.setdefault(lang, []).append(keys)
                size[lang] = size.get(lang, 0) + len(keys)
                if size[lang] > 1 << 21:
                    yield counted(lang, held.pop(lang))
                    del size[lang]
        for lang, keys in held.items():
            yield counted(lang, keys)

    known = docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = map_arrow(known, run, "lang string, key long, count long").groupBy("lang", "key").agg(F.sum("count").alias("count"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(32))).orderBy(F.col("count").desc(), "key")
    whole = Window.partitionBy("lang").orderBy(F.col("count").desc(), "key")
    some = counts.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= top)
    return some.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top).select("lang", "key", "rank")


def identify(docs: DataFrame, profiles: DataFrame, top: int = 400, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score``, and the columns ``keep`` as they are.

    The distance of a text to a language sums, over the text's ``top`` n-grams, how far the
    two ranks are apart; an n-gram that the profile lacks counts as ``top``. The language of
    the smallest distance wins, the first by name among equals. ``score`` is 1 less the
    distance over the largest one possible. Null texts, texts without a letter, and any text when nothing
    was learned, get ``und`` and 0. Rows are judged alone, so repeated rows agree. Columns
    named ``lang_pred`` or ``score`` are not kept; put a row in a struct to keep all of it.
    """
    if profiles.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; are these labels languages?")
    learned = profiles.toPandas()
    tables = {}
    for lang, part in sorted(learned.groupby("lang"), key=lambda x: x[0]):
        part = part.sort_values("key")
        tables[lang] = (part["key"].to_numpy(), part["rank"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def judge(text: str | None) -> tuple[str, float]:
        best = ranked(ngrams(text), top) if text else ()
        if not len(best) or not shared.value:
            return UNKNOWN, 0.0
        mine = np.arange(1, len(best) + 1)
        found = []
        for lang, (keys, rank) in shared.value.items():
            at = np.minimum(np.searchsorted(keys, best), len(keys) - 1)
            found.append((int(np.where(keys[at] == best, np.abs(rank[at] - mine), top).sum()), lang))
        distance, lang = min(found)
        return lang, 1 - distance / (top * len(best))

    kept = [c for c in keep or [] if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [judge(x.as_py()) for x in batch.column(1)]
            lang, score = zip(*judged, strict=True) if judged else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names)

    names = ["doc_id", *kept, "lang_pred", "score"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(c) for c in kept])
    fields = [rows.schema[c] for c in ["doc_id", *kept]]
    return map_arrow(rows, run, StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 1


def predict_languages(docs: DataFrame, top: int = 400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from labelled rows that are not held out.

    A null id is not held out.
    """
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    profiles = stage(learn_profiles(docs.filter(~out), top))
    return identify(docs, profiles, top).select("doc_id", out.alias("held_out"), "lang_pred", "score")
