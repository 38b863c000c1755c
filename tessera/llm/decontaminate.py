"""Benchmark decontamination as a prefix-filtered set join over item-sized windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, stage
from tessera.llm.tokens import ALPHANUMERIC, BLOCK, U, blocks, grams, mix, pieces, words

_DOWN = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
#: The filter of item shingles has so many bits a shingle, and never more than MOST_BITS (16 MB).
BITS_EACH, MOST_BITS = 256, 1 << 27


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    z = mix(h.view(U))
    return z & U(bits - 1), (z >> U(32)) & U(bits - 1)


def item_windows(items: DataFrame, window: int, size: int) -> DataFrame:
    """(item_id, window, n, shingles) of (item_id, text); a shingle's place is its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                doc, start, end, hashed, joined = words(texts, ALPHANUMERIC)
                joined = joined.translate(_DOWN)
                count = np.bincount(doc, minlength=len(texts))
                begins = np.cumsum(count) - count
                by_size = {k: grams(hashed, k) for k in range(1, size + 1)}
                ids, texts_out, n_out, shingles = [], [], [], []
                for i in np.flatnonzero(count):
                    n = min(window, int(count[i]))
                    k = min(size, n)
                    for a in range(begins[i], begins[i] + count[i] - n + 1):
                        ids.append(first + i)
                        texts_out.append(" ".join(joined[start[w] : end[w]].decode() for w in range(a, a + n)))
                        n_out.append(n)
                        shingles.append(by_size[k][a : a + n - k + 1].view(np.int64))
                taken = batch.column(0).take(pa.array(np.array(ids, np.int64)))
                arrays = [taken, pa.array(texts_out, pa.string()), pa.array(n_out, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["item_id", "window", "n", "shingles"])

    kind = items.schema["item_id"].dataType.simpleString()
    return map_arrow(items, run, f"item_id {kind}, window string, n int, shingles array<long>")


def shingle_filter(shingles: DataFrame) -> tuple[np.ndarray, int]:
    """Bloom filter with two probes of the distinct column ``h``, as 64-bit words.

    Built by a grouped bit_or, so that the driver gets at most MOST_BITS bits, however many
    shingles there are; more shingles than it holds well let more of the others through,
    which the join drops.
    """
    count = max(1, shingles.count())
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * count - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_probes(batch.column(0).to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> U(6)).view(np.int64)), pa.array((at & U(63)).view(np.int64))], ["word", "bit"])

    set_bits = map_arrow(shingles, run, "word long, bit long").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit AS INT))")).alias("mask"))
    found = set_bits.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy()
    return out.view(U), bits


def shingle_hits(docs: DataFrame, filter_: np.ndarray, bits: int, sizes: list[int], size: int, window: int) -> DataFrame:
    """(_row, doc_id, n_words, hits); a hit is a shingle that passes the filter with the words around it.

    Around a shingle of ``size`` words stand those that a window with it may have; a shorter one is a window itself. A
    long text is taken in pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def scan(texts: list[bytes], own: int = 0, at: int = 0, more: bool = False) -> tuple[np.ndarray, list[list]]:
        """Words and hits of each text; of a piece (which has ``more`` after it), those of own words, and places from ``at`` on."""
        table, one = shared.value, U(1)
        doc, start, end, hashed, joined = words(texts, ALPHANUMERIC)
        joined = joined.translate(_DOWN)
        count = np.bincount(doc, minlength=len(texts))
        begins = np.cumsum(count) - count
        last = len(doc) - (window - 1) if more else len(doc)
        found: list[list] = [[] for _ in texts]
        for k in sizes:
            g = grams(hashed, k)
            hit = doc[: len(g)] == doc[k - 1 :] if len(g) else np.zeros(0, bool)
            for p in _probes(g, bits):
                hit = hit & ((table[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & one).astype(bool)
            for a in np.flatnonzero(hit[own:last]) + own:
                d = doc[a]
                lo, hi = (max(begins[d], a - window + k), min(begins[d] + count[d], a + window)) if k == size else (a, a + k)
                around = [joined[start[w] : end[w]].decode() for w in range(lo, hi)]
                found[d].append({"h": int(g[a].view(np.int64)), "pos": int(a - begins[d] + at), "lead": int(a - lo), "around": around})
        return count, found

    def scan_long(text: bytes) -> tuple[np.ndarray, list[list]]:
        n, found, waiting = 0, [], None
        parts = pieces(text, ALPHANUMERIC, window - 1, window - 1)
        while True:
            piece = next(parts, None)
            if waiting is not None:
                at, first, part = waiting
                count, hits = scan([part], first - at, at, piece is not None)
                found += hits[0]
                n = at + int(count[0])
            if piece is None:
                return np.array([n]), [found]
            waiting = piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(2)):
                count, found = scan_long(texts[0]) if len(texts) == 1 and len(texts[0]) > 2 * BLOCK else scan(texts)
                arrays = [batch.column(c).slice(first, len(texts)) for c in (0, 1)]
                arrays += [pa.array(count.astype(np.int64)), pa.array(found, HITS)]
                yield pa.RecordBatch.from_arrays(arrays, ["_row", "doc_id", "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("_row", "doc_id", "text"), run, f"_row long, doc_id {kind}, n_words long, hits array<struct<h:long,pos:int,lead:int,around:array<string>>>")


HITS = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("lead", pa.int32()), ("around", pa.list_(pa.string()))]))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    size: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_hit``, ``item_ids``, ``starts``.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item. A
    window occurs in a document only if all its ``size``-word shingles do; so its rarest one
    alone is joined (for full containment, a prefix of one token in order of rarity). A shingle that
    no document holds rules its window out. The place of the shingle in both fixes where the
    window would start; occurrences that would begin before or end after the document are dropped
    (positional and length bounds), and the words themselves are compared.

    Documents are scanned once; only shingles that pass a filter of item shingles of bounded
    size leave the scan. ``starts`` has the first word and number of words of each occurrence.
    Null texts and texts without words have no words and no hits; items without words have
    no windows. Rows that repeat an id are judged each on its own. Empty tables give empty
    results or no hits. Columns not named are not read.
    """
    kept_items = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    windows = stage(item_windows(kept_items, window, size))
    shingles = windows.select(F.explode("shingles").alias("h")).distinct()
    table, bits = shingle_filter(shingles)
    shortest = windows.agg(F.min("n")).first()[0]
    sizes = [size] if shortest is None else list(range(min(size, shortest), size + 1))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanned = stage(shingle_hits(rows, table, bits, sizes, size, window))

    hits = scanned.select("_row", "n_words", F.explode("hits").alias("hit")).select("_row", "n_words", "hit.*")
    rarity = hits.groupBy("h").agg(F.count(F.lit(1)).alias("_df"))
    tokens = windows.select("window", "n", F.posexplode("shingles").alias("off", "h")).distinct()
    ranked = tokens.join(rarity, "h", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    prefix = ranked.groupBy("window", "n").agg(F.min(F.struct("_df", "h", "off")).alias("_p")).filter("_p._df > 0").select("window", "n", "_p.h", "_p.off")
    start = F.col("pos") - F.col("off")
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice("around", F.col("lead") - F.col("off") + 1, F.col("n")), " ") == F.col("window")
    occurs = stage(hits.join(prefix, "h").filter(inside).filter(same).select("_row", start.alias("start"), "n", "window").distinct())

    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    per_doc = occurs.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("starts"))
    by_item = occurs.select("_row", "window").distinct().join(windows.select("window", "item_id").distinct(), "window")
    named = by_item.groupBy("_row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    return scanned.select("_row", "doc_id", "n_words").join(per_doc, "_row", "left").join(named, "_row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("starts", F.array().cast("array<struct<start:int,n:int>>")).alias("starts"),
    )


def contamination_digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
m AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM m)),
sizes AS (SELECT DISTINCT n FROM win),
placed AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - n + 2))) AS s FROM d, sizes)),
occ AS (SELECT doc_id, item_id, n, s FROM placed JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
