"""Removal of repeated runs of lines, found by content-defined chunks and then by the few lines inside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

#: Lines that the rolling hash sees, and lines between two boundaries on average (a power of two).
WINDOW, SPACING = 3, 8


def text_of(lines: str, first: Column, last: Column) -> Column:
    """These lines of a text; ``slice`` would copy the whole array for each."""
    return F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(lines, i)), "\n")


def rolling(hashes: str, i: Column, window: int) -> Column:
    """The cyclic polynomial of the ``window`` line hashes that end with line ``i``: each is turned left once a step."""

    def turned(k: int) -> Column:
        h = F.get(hashes, i - k)
        return F.shiftleft(h, k).bitwiseOR(F.shiftrightunsigned(h, 64 - k)) if k else h

    return reduce(lambda a, b: a.bitwiseXOR(b), [turned(k) for k in range(window)])


def line_chunks(rows: DataFrame, n: int, window: int = WINDOW, spacing: int = SPACING) -> DataFrame:
    """(doc_id, row, start, h, parts) of (doc_id, row, text): content-defined chunks of lines.

    A boundary stands where the rolling hash of the last ``window`` lines is 0 modulo ``spacing``, so lines put in or
    taken out move no boundary beyond the next ``window`` lines, and a long run is cut alike wherever it stands.
    A chunk goes on over the first ``n - 1`` lines of the next, so every ``n`` lines that follow each other lie
    in one chunk whole. ``h`` has 128 bits of the chunk's bytes; ``parts`` the 64-bit hashes of its ``n`` lines from each line on.
    """
    lines = rows.select("doc_id", "row", F.split("text", "\n", -1).alias("lines")).filter(F.size("lines") >= n)
    lines = lines.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    starts = F.sequence(F.lit(0), F.size("lines") - n)
    lines = lines.withColumn("parts", F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(n)])))
    mask = F.lit(spacing - 1).cast("long")
    cut = F.filter(starts, lambda i: (i == 0) | ((i >= window - 1) & (rolling("hashes", i, window).bitwiseAND(mask) == 0)))
    lines = lines.select("doc_id", "row", "lines", "parts", cut.alias("cut"))

    def chunk(a: Column, k: Column) -> Column:
        end = F.coalesce(F.get("cut", k + 1), F.size("parts")) - 1
        inside = F.transform(F.sequence(a, end), lambda i: F.get("parts", i))
        return F.struct(a.alias("start"), hash_of(text_of("lines", a, end + (n - 1))).alias("h"), inside.alias("parts"))

    return lines.select("doc_id", "row", F.explode(F.transform("cut", chunk)).alias("c")).select("doc_id", "row", "c.*")


def runs(lines: Column) -> Column:
    """The array<struct<start,n>> of maximal runs in ``lines``, increasing numbers."""
    starts = F.filter(lines, lambda x, k: (k == 0) | (F.get(lines, k - 1) < x - 1))
    ends = F.filter(lines, lambda x, k: (k == F.size(lines) - 1) | (F.get(lines, k + 1) > x + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("n")))


def hash_of(text: Column) -> Column:
    """128 bits."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def dedup_lines(docs: DataFrame, least_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_lines``, ``n_removed`` (lines), ``removed`` spans, ``text``.

    A run of ``least_lines`` lines or more that occurs again anywhere, the same document included,
    stays where it occurs first (by id, then line) and goes elsewhere. ``least_lines`` lines that overlap their
    own first occurrence stay. Of each line that goes, an equal one stays further ahead.

    Content-defined chunks are grouped by hash, so of a chunk that is repeated all over the corpus one goes on, with its first place and
    its count. Runs may end within chunks, or be shorter than one: so the different chunks are held against each other
    by the ``least_lines`` lines from each of their lines on, which extends what chunks share up to its
    ends. What is found in a chunk holds for all its occurrences, and is merged into maximal runs.

    Up to there hashes decide, without texts; chunks of one hash that differ in the hashes of their lines are classes of their own. Places found are then brought to the documents, where their bytes are
    read again and compared by grouping by (hash, bytes): texts that share a hash are told apart, and nothing goes that is not
    equal. Groupings send one row for each key and task; what is collected is one chunk's lines, or one document's.

    A very long text is cut in one task, whose memory grows with that text; its chunks are spread. Null text counts as empty. Texts of one line never lose it. A document may end empty when all its lines occur
    earlier. Rows that repeat an id with the same text keep and lose the same lines; with other texts,
    or without an id, each is a document of its own. An empty table gives an empty result. Columns
    not named are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("row"), text.alias("text"))
    chunks = line_chunks(rows, least_lines)
    place = F.struct("doc_id", "row", "start")
    classes = stage(chunks.groupBy("h", "parts").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
    alike = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunk = F.col("h") if alike.isEmpty() else F.struct("h", "parts")  # chunks that share a hash are told apart by their lines
    parts = classes.select(chunk.alias("chunk"), "first", "n", F.posexplode("parts").alias("at", "h"))
    here = F.struct("first.doc_id", "first.row", (F.col("first.start") + F.col("at")).alias("start"))
    repeated = stage(parts.groupBy("h").agg(F.min(here).alias("first"), F.sum("n").alias("n")).filter("n > 1").select("h", "first"))
    inside = parts.select("chunk", "at", "h").join(repeated, "h").groupBy("chunk").agg(F.collect_list(F.struct("at", "h", "first")).alias("inside"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    later = ~(same & (F.col("start") < F.col("first.start") + least_lines))
    met = chunks.select("doc_id", "row", "start", chunk.alias("chunk")).join(inside, "chunk").select("doc_id", "row", "start", F.explode("inside").alias("i"))
    met = met.select("doc_id", "row", (F.col("start") + F.col("i.at")).alias("start"), "i.h", "i.first")
    met = met.select("doc_id", "row", F.struct("start", "h", later.alias("later")).alias("at"))
    match = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.row") == F.col("g.row"))

    def with_places(met: DataFrame) -> DataFrame:
        per_doc = met.groupBy("doc_id", "row").agg(F.collect_set("at").alias("found"))
        return stage(rows.alias("d").join(per_doc.alias("g"), match, "left").select("d.doc_id", "d.row", "text", "found"))

    both = with_places(met)
    each = both.filter("found is not null").select("doc_id", "row", F.split("text", "\n", -1).alias("lines"), "found")
    read = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["h"].alias("h"), text_of("lines", x["start"], x["start"] + (least_lines - 1)).alias("text")))
    each = each.select("doc_id", "row", F.explode(read).alias("at")).select("doc_id", "row", "at.*")
    classes = each.groupBy("h", "text").agg(F.min(place).alias("first"))
    shared = stage(classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    if not shared.isEmpty():
        apart = each.join(shared, "h", "left_semi").join(stage(classes.join(shared, "h", "left_semi")), ["h", "text"])
        apart = apart.select("doc_id", "row", F.struct("start", "h", later.alias("later")).alias("at"))
        both = with_places(met.join(shared, F.col("at.h") == F.col("h"), "left_anti").unionByName(apart))
    starts = F.array_sort(F.transform(F.filter("found", lambda x: x["later"]), lambda x: x["start"]))
    gone = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (least_lines - 1)))))
    out = both.select("doc_id", "text", F.split("text", "\n", -1).alias("lines"), F.when(F.size(starts) > 0, gone).alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNotNull(), runs(F.col("gone"))).otherwise(F.array().cast("array<struct<start:int,n:int>>")).alias("removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )


OP5_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
c AS (SELECT doc_id, s, l[s] || chr(10) || l[s + 1] AS t FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS s FROM d)),
f AS (SELECT t, min(doc_id) AS doc_id FROM c GROUP BY t HAVING count(*) > 1),
g AS (SELECT t, f.doc_id AS first_id, min(s) AS first_s FROM c JOIN f USING (t, doc_id) GROUP BY ALL),
x AS (SELECT DISTINCT doc_id, unnest([s, s + 1]) AS s FROM c JOIN g USING (t) WHERE NOT (doc_id = first_id AND s < first_s + 2)),
k AS (SELECT doc_id, string_agg(v, chr(10) ORDER BY s) AS kept FROM (SELECT doc_id, generate_subscripts(l, 1) AS s, unnest(l) AS v FROM d) ANTI JOIN x USING (doc_id, s) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(n, 0) AS n_removed, coalesce(kept, '') AS text
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
