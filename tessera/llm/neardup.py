"""Near-duplicate groups by SuperMinHash signatures, banding, verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, stage
from tessera.llm.links import components
from tessera.llm.tokens import NOT_SPACE, U, blocks, mix, shingle_sets

#: Elements whose permutations are held at a time.
ELEMENTS = 1 << 16
#: Members of a bucket, and shingles of theirs, in one chunk, about; two chunks are compared in one task.
TILE, TILE_SHINGLES = 2048, 1 << 20


def superminhash(doc: np.ndarray, values: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) signatures of the sets given as (doc, element hash).

    Each element draws one permutation of the m places, step by step; in step j it offers
    j + r, r uniform, to the j-th place of its permutation. Ranks are thus correlated over
    the places, which lowers the variance against independent minima, and a set is done
    when no place holds more than the step's number: later offers can't be smaller. A value
    is kept as j * 2^32 + r * 2^32.
    """
    sig = np.full(n_docs * m, np.iinfo(np.uint64).max, U)
    for at in range(0, len(doc), ELEMENTS):
        d, state = doc[at : at + ELEMENTS], mix(values[at : at + ELEMENTS] ^ U(0x2545F4914F6CDD1D))
        live = np.arange(len(d))
        perm = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(d), 1))
        for j in range(m):
            state[live] += U(0x9E3779B97F4A7C15)
            z = mix(state[live])
            k = j + (((z & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)
            place = perm[live, k]
            perm[live, k] = perm[live, j]
            np.minimum.at(sig, d[live] * m + place, (U(j) << U(32)) | (z >> U(32)))
            near = np.unique(d[live])
            open_ = np.zeros(n_docs, bool)
            open_[near] = sig.reshape(n_docs, m)[near].max(axis=1) > (U(j + 1) << U(32))
            live = live[open_[d[live]]]
            if not len(live):
                break
    return sig.reshape(n_docs, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), -1, rows)
    key = np.tile(np.arange(parts.shape[1], dtype=U), (len(sig), 1))
    for r in range(rows):
        key = mix(key * U(3) + parts[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, size: int, bands: int, rows: int, kind: np.ndarray = NOT_SPACE) -> DataFrame:
    """(doc_id, n, s1, s2, bands) of (doc_id, text); n distinct shingles, s1 and s2 identify the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                doc, values = shingle_sets(texts, kind, size)
                n = np.bincount(doc, minlength=len(texts))
                starts = np.cumsum(n) - n
                some = np.flatnonzero(n)
                sums = []
                for salt in (U(0x51ED270B), U(0xD6E8FEB8)):
                    s = np.zeros(len(texts), U)
                    if len(some):
                        s[some] = np.add.reduceat(mix(values ^ salt), starts[some])
                    sums.append(pa.array(s.view(np.int64)))
                keys = np.zeros((len(texts), bands), np.int64)
                if len(some):
                    compact = np.zeros(len(texts), np.int64)
                    compact[some] = np.arange(len(some))
                    keys[some] = band_keys(superminhash(compact[doc], values, len(some), bands * rows), rows)
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), *sums, lists], ["doc_id", "n", "s1", "s2", "bands"])

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind_of_id}, n long, s1 long, s2 long, bands array<long>")


def full_sets(docs: DataFrame, size: int, kind: np.ndarray = NOT_SPACE) -> DataFrame:
    """(doc_id, shingles) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                doc, values = shingle_sets(texts, kind, size)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts))))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), lists], ["doc_id", "shingles"])

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind_of_id}, shingles array<long>")


def tile_links(members: list[tuple], percent: int, left: set[int], right: set[int]) -> list[tuple]:
    """Links between (rep, component, shingles) of different components, one for each member and other component.

    ``left`` and ``right`` are the places to compare. Only members outside the largest
    component are looked up, each over the lists of its shingles, so that most members of a
    bucket of copies cost nothing.
    """
    reps, comps = [m[0] for m in members], {}
    comp = np.array([comps.setdefault(m[1], len(comps)) for m in members])
    size = np.array([len(m[2]) for m in members])
    owner = np.repeat(np.arange(len(members)), size)
    values = np.concatenate([m[2] for m in members])
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    largest = np.bincount(comp).argmax()
    found = []
    for x in np.flatnonzero(comp != largest):
        others = right if x in left else left
        lo, hi = (np.searchsorted(values, members[x][2], side=s) for s in ("left", "right"))
        posts = np.concatenate([owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
        common = np.bincount(posts, minlength=len(members))
        linked = np.flatnonzero((comp != comp[x]) & (common * 100 >= (size[x] + size - common) * percent) & (common > 0))
        for y in {comp[y]: y for y in linked.tolist() if y in others or (x in right and y in left)}.values():
            found.append((reps[x], reps[y]))
    return found


def bucket_links(apart: DataFrame, percent: int) -> DataFrame:
    """(a, b) of links within a bucket between members of different components.

    ``apart`` is (key, _size, _shingles, rep, component, shingles). A bucket of more than TILE members or TILE_SHINGLES
    shingles is cut into chunks, and each two chunks are a task's work of their own; no pairs are listed.
    """
    chunks = F.ceil(F.greatest(F.col("_size") / TILE, F.col("_shingles") / TILE_SHINGLES)).cast("int")
    chunk = F.pmod(F.xxhash64("rep"), chunks).cast("int")
    dealt = apart.withColumn("_c", chunk).withColumn("_o", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.select("key", F.least("_c", "_o").alias("i"), F.greatest("_c", "_o").alias("j"), "_c", "rep", "component", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def done() -> pa.RecordBatch:
            left = {k for k, m in enumerate(held) if m[3] == at[1]}
            right = {k for k, m in enumerate(held) if m[3] == at[2]}
            links = tile_links(held, percent, left, right) if held else []
            a, b = zip(*[(min(x), max(x)) for x in links], strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

        kind = None
        for batch in batches:
            kind = batch.column(4).type
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            for n, key in enumerate(keys):
                if key != at:
                    if held:
                        yield done()
                    held, at = [], key
                held.append((batch.column(4)[n].as_py(), batch.column(5)[n].as_py(), batch.column(6)[n].values.to_numpy(), batch.column(3)[n].as_py()))
        if held:
            yield done()

    name = apart.schema["rep"].dataType.simpleString()
    return map_arrow(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, f"a {name}, b {name}")


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 75,
    bands: int = 40,
    rows: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents link when 100 x intersection >= ``percent`` x union of their sets of
    ``size``-word shingles. Equal sets are one class, which has a number of its own. Classes
    that share a band of their signatures are candidates: at a similarity of 0.75, a pair
    shares none of 40 bands of 5 with probability 2e-5. Pairs are not listed within a
    bucket: first each member is held against the bucket's most central one (that which meets
    most others over all buckets), and confirmed links are joined into components; then only
    members of one bucket that are still in different components are compared with each
    other, in tiles of bounded size that give links and not pairs. Every pair that shares a
    bucket is thus in one component or verified on its full sets. That last step reads each
    leftover bucket once for every tile row, so its rows grow with a bucket's size over TILE.

    Null texts and texts without words have an empty set and link with nothing. Rows that
    repeat an id get the same component. An empty table gives an empty result. Columns not
    named are not read.
    """
    rows_in = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col))).alias("row"), F.col(text_col).alias("text"))
    own = F.struct("id", "row")
    sig = stage(signatures(rows_in.select(own.alias("doc_id"), "text"), size, bands, rows).select("doc_id.*", "n", "s1", "s2", "bands"))
    classes = sig.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("least"), F.min(own).alias("own"), F.first("bands").alias("bands"))
    classes = stage(classes.withColumn("rep", F.monotonically_increasing_id()))  # fixed once written
    buckets = classes.select(F.explode("bands").alias("key"), "rep", "n")
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    found = stage(buckets.join(shared, "key"))
    central = found.join(found.groupBy("rep").agg(F.sum("_c").alias("_central")), "rep")
    hubs = central.groupBy("key").agg(F.max(F.struct("_central", "rep", "n")).alias("hub"))
    members = stage(found.drop("_c").join(hubs, "key"))
    wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "own.*")
    texts = rows_in.alias("r").join(wanted.alias("w"), (F.col("r.row") == F.col("w.row")) & F.col("r.id").eqNullSafe(F.col("w.id")))
    sets = stage(full_sets(texts.select(F.col("rep").alias("doc_id"), "text"), size).dropDuplicates(["doc_id"]))

    def fits(a: Column, b: Column) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_x"))
        b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_y"))
        both = pairs.join(a, "a").join(b, "b").withColumn("_i", F.size(F.array_intersect("_x", "_y")))
        return both.filter(F.col("_i") * 100 >= (F.size("_x") + F.size("_y") - F.col("_i")) * percent).select("a", "b")

    others = members.filter((F.col("rep") != F.col("hub.rep")) & fits(F.col("n"), F.col("hub.n")))
    tried = stage(others.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct())
    links = stage(confirmed(tried))
    groups = components(links)
    placed = members.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("_size"), F.sum("n").alias("_shingles")).filter("_lo <> _hi")
    apart = placed.join(split.select("key", "_size", "_shingles"), "key").join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    more = stage(bucket_links(apart, percent).distinct())
    if not more.isEmpty():
        groups = components(links.union(more))
    linked = groups.withColumnRenamed("id", "rep").join(classes.select("rep", "least"), "rep")
    reached = linked.join(linked.groupBy("component").agg(F.min("least").alias("_reached")), "component").select("rep", "_reached", F.lit(True).alias("_linked"))
    final = classes.select("n", "s1", "s2", "rep", "least").join(reached, "rep", "left")
    final = final.select("n", "s1", "s2", F.lit(True).alias("_set"), F.when(F.col("_linked"), F.col("_reached")).otherwise(F.col("least")).alias("_id"))
    component = F.when(F.col("_set"), F.col("_id")).otherwise(F.col("id"))
    return sig.drop("bands").join(final, ["n", "s1", "s2"], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id, min(b) = doc_id AS kept
FROM r JOIN documents ON doc_id = a LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
