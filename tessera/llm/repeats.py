"""Removal of repeated byte strings, found by a column-wise construction over many contexts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, stage
from tessera.llm.tokens import BASE, BLOCK, U, blocks, mix

#: Bytes of the strings by which contexts find each other.
ANCHOR = 128
#: Contexts of one construction, about, and different ones of one group at most; larger groups are split by longer anchors.
COLLECTION, GROUP = 4096, 8192


def anchor_runs(text: bytes, length: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor place, anchor hash) of runs of starts.

    Each string of ``length`` bytes chooses the leftmost ``anchor``-byte string in it of the
    smallest hash. Equal strings choose alike, so they find each other by the anchor's hash
    and stand at the same distance from it. Consecutive starts with one anchor make a run.
    """
    raw = np.frombuffer(text, np.uint8)
    h, step = raw.astype(U) + U(1), 1
    while step < anchor:
        h = h[:-step] * U(pow(int(BASE), step, 1 << 64)) + h[step:]
        step *= 2
    h = mix(h)
    low = U((1 << len(h).bit_length()) - 1)
    best = (h & ~low) | np.arange(len(h), dtype=U)
    width, step = length - anchor + 1, 1
    while step * 2 <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
    place = (best & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count = np.diff(np.append(first, len(place)))
    return first, count, place[first], h[place[first]]


def run_keys(docs: DataFrame, length: int) -> DataFrame:
    """(key) of the runs of (text), once for each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in blocks(batch.column(0)):
                keys = [anchor_runs(piece, length)[3] for text in texts for _, piece in pieces(text, length)]
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], ["key"])

    return map_arrow(docs.select("text"), run, "key long")


def pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, bytes) of pieces that overlap so that each string of ``length`` bytes is in one; so memory does not grow with a text."""
    for at in range(0, len(text) - length + 1, BLOCK):
        yield at, text[at : at + BLOCK + length - 1]


def runs(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, row, key, c1, c2, start, n, lead) of (doc_id, row, text); c1 and c2 are the context's hash.

    A context is a run's bytes: its starts and the strings from them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row0, texts in blocks(batch.column(2)):
                rows, key, ctx, start, n, lead = [], [], [], [], [], []
                for i, text in enumerate(texts):
                    for at, piece in pieces(text, length):
                        first, count, place, hashed = anchor_runs(piece, length)
                        view = memoryview(piece)
                        ctx += [xxhash.xxh3_128_digest(view[a : a + c + length - 1]) for a, c in zip(first.tolist(), count.tolist(), strict=True)]
                        rows.append(np.full(len(first), row0 + i))
                        key.append(hashed)
                        start.append(first + at)
                        n.append(count)
                        lead.append(place - first)
                if rows:
                    c = np.frombuffer(b"".join(ctx), np.int64).reshape(-1, 2)
                    longs = [np.concatenate(key).view(np.int64), c[:, 0].copy(), c[:, 1].copy()]
                    ints = [np.concatenate(x).astype(np.int32) for x in (start, n, lead)]
                    at = pa.array(np.concatenate(rows))
                    ids = [batch.column(c).take(at) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, longs), *map(pa.array, ints)], RUN)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select(*ROW, "text"), run, f"doc_id {kind}, row long, key long, c1 long, c2 long, start int, n int, lead int")


#: What tells rows apart: the id and a hash of the text, so a repeated or missing id may have several texts.
ROW = ("doc_id", "row")
RUN = [*ROW, "key", "c1", "c2", "start", "n", "lead"]


def same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))


def contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, c1, c2, times, n, lead, bytes) of the contexts ``wanted``, cut from the text in which each stands first."""
    per_doc = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("key", "c1", "c2", "times", "start", "n", "lead")).alias("runs"))
    both = docs.alias("d").join(per_doc.alias("p"), same_row("d", "p")).select("text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "c1", "c2", "times", "n", "lead"]
        for batch in batches:
            lists = batch.column(1)
            flat, parent = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            texts = batch.column(0).cast(pa.large_binary())
            start, n = (flat.field(x).to_numpy() for x in ("start", "n"))
            for lo in range(0, len(parent), 4096):
                part, held, cut = flat.slice(lo, 4096), -1, []
                for p, a, c in zip(parent[lo : lo + 4096].tolist(), start[lo : lo + 4096].tolist(), n[lo : lo + 4096].tolist(), strict=True):
                    if p != held:
                        held, text = p, texts[p].as_py()
                    cut.append(text[a : a + c + length - 1])
                yield pa.RecordBatch.from_arrays([*(part.field(x) for x in names), pa.array(cut, pa.binary())], [*names, "bytes"])

    return map_arrow(both, run, CONTEXT)


CONTEXT = "key long, c1 long, c2 long, times long, n int, lead int, bytes binary"


class Columns:
    """Texts side by side with their ``lead``-th bytes in one column; ``begin`` and ``end`` are their first and last columns."""

    def __init__(self, texts: list[bytes], lead: np.ndarray) -> None:
        self.texts = texts
        self.shift = int(lead.max())
        self.begin = self.shift - lead
        self.end = self.begin + np.array([len(x) for x in texts])
        self.width = int(self.end.max())
        self._leaves = np.bincount(self.begin, minlength=self.width + 1)
        by_end = np.argsort(self.end, kind="stable")
        self._enters = [np.zeros(0, np.int64)] * (self.width + 1)
        for e, part in zip(*_split(self.end[by_end], by_end), strict=True):
            self._enters[e] = part

    def symbols(self, to: BinaryIO) -> None:
        """Write the texts' symbols column by column, the last column first."""
        grid = np.zeros((len(self.texts), self.width), np.uint8)
        for i, x in enumerate(self.texts):
            grid[i, self.begin[i] : self.end[i]] = np.frombuffer(x, np.uint8)
        np.ascontiguousarray(grid.T[::-1]).tofile(to)
        to.seek(0)

    def turn(self, column: int, order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and common prefixes of the suffixes from ``column + 1`` that go on into ``column``.

        Texts that begin at ``column + 1`` leave; texts that end there enter, as empty suffixes before all others.
        """
        if self._leaves[column + 1] and len(order):
            kept = np.flatnonzero(self.begin[order] <= column)
            common = np.minimum.reduceat(common[: kept[-1] + 1], np.append(0, kept[:-1] + 1)) if len(kept) else common[:0]
            order = order[kept]
        fresh = self._enters[column + 1]
        if len(fresh):
            order = np.concatenate((fresh, order))
            common = np.concatenate((np.zeros(len(fresh), common.dtype), common))
        if len(order):
            common[0] = 0
        return order, common


def construct(columns: Columns, transform: BinaryIO, prefixes: BinaryIO) -> None:
    """Write the collection's transform and common prefixes, column by column from the last to the first.

    Each round puts one symbol in front of every text's suffix. The symbols that precede the
    ordered suffixes of the last round are the transform's column; suffixes of the last round are in
    order, so a stable sort by the new symbol alone orders the new ones, and the common prefix of neighbours
    that got the same symbol is one more than the least one that lay between them. Symbols come
    from a file in column order; all files are used front to back, and only one column is in memory.
    """
    with tempfile.TemporaryFile() as symbols:
        columns.symbols(symbols)
        order, common = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for column in range(columns.width - 1, -1, -1):
            order, common = columns.turn(column, order, common)
            before = np.fromfile(symbols, np.uint8, len(columns.texts))[order]
            before.tofile(transform)
            rank = np.argsort(before, kind="stable")
            placed = before[rank]
            same = np.flatnonzero(placed[1:] == placed[:-1]) + 1
            after = np.zeros(len(order), np.int32)
            after[same] = 1 + _least_between(common, rank[same - 1] + 1, rank[same])
            order, common = order[rank], after
            common.tofile(prefixes)
    transform.seek(0)
    prefixes.seek(0)


def walk(columns: Columns, transform: BinaryIO, prefixes: BinaryIO) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(column, order, symbols, common prefixes) of the suffixes that start in each column, from the files of ``construct``.

    Which text stands where follows from the transform: a suffix's place in the next column is the
    number of smaller symbols in the transform's column, and of equal ones before it.
    """
    order = np.zeros(0, np.int64)
    for column in range(columns.width - 1, -1, -1):
        order, _ = columns.turn(column, order, np.zeros(len(order), np.int32))
        before = np.fromfile(transform, np.uint8, len(order))
        rank = np.argsort(before, kind="stable")
        order = order[rank]
        yield column, order, before[rank], np.fromfile(prefixes, np.int32, len(order))


def column_wise(texts: list[bytes], lead: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``walk`` over the transform and common prefixes of the texts."""
    columns = Columns(texts, lead)
    with tempfile.TemporaryFile() as transform, tempfile.TemporaryFile() as prefixes:
        construct(columns, transform, prefixes)
        yield from walk(columns, transform, prefixes)


def _split(sorted_: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    cuts = np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1
    return sorted_[np.append(0, cuts)].tolist(), np.split(values, cuts)


def _least_between(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo..hi]) of each pair, both ends counted."""
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out = np.empty(len(lo), x.dtype)
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            x = np.minimum(x[: -(1 << (k - 1))], x[1 << (k - 1) :])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(x[lo[at]], x[hi[at] - (1 << k) + 1])
    return out


def repeated_starts(texts: list[bytes], lead: np.ndarray, length: int) -> list[np.ndarray]:
    """Of each text, the starts of strings of ``length`` bytes that another text has in the same place from its lead."""
    shift = int(lead.max()) - lead
    size = np.array([len(x) for x in texts])
    at, of = [], []
    for column, order, _, common in column_wise(texts, lead):
        best = common.copy()
        best[:-1] = np.maximum(best[:-1], common[1:])
        hit = order[best >= length]
        if len(hit):
            hit = hit[size[hit] - (column - shift[hit]) >= length]
            of.append(hit)
            at.append(column - shift[hit])
    if not of:
        return [np.zeros(0, np.int64)] * len(texts)
    of, at = np.concatenate(of), np.concatenate(at)
    by = np.lexsort((at, of))
    return np.split(at[by], np.cumsum(np.bincount(of, minlength=len(texts)))[:-1])


def spans_of(starts: np.ndarray) -> list[dict]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    first, last = starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)]
    return [{"o": int(a), "l": int(b - a + 1)} for a, b in zip(first, last, strict=True)]


SPANS = pa.list_(pa.struct([("o", pa.int32()), ("l", pa.int32())]))


def marked(found: DataFrame, length: int) -> DataFrame:
    """(key, c1, c2, spans) of contexts; spans are runs of starts whose strings stand elsewhere.

    All of those of a context that occurs again, and of others those that another context of the group has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[pa.RecordBatch]) -> pa.Table:
            t = pa.Table.from_batches(rows).combine_chunks()
            hits = repeated_starts(t["bytes"].to_pylist(), t["lead"].to_numpy(), length)
            again = zip(hits, t["times"].to_pylist(), t["n"].to_pylist(), strict=True)
            spans = [[{"o": 0, "l": n}] if times > 1 else spans_of(x) for x, times, n in again]
            out = pa.table({"key": t["key"], "c1": t["c1"], "c2": t["c2"], "spans": pa.array(spans, SPANS)})
            return out.filter(pa.array([len(x) > 0 for x in spans]))

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            if held and len(key) and held[-1].column(0)[-1].as_py() == key[0]:
                cuts = cuts[1:]
                held.append(batch.slice(0, cuts[0]))
                size += cuts[0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if size >= COLLECTION:
                    yield from done(held).to_batches()
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += b - a
        if size:
            yield from done(held).to_batches()

    return map_arrow(found.repartition("key").sortWithinPartitions("key"), run, MARKS)


MARKS = "key long, c1 long, c2 long, spans array<struct<o:int,l:int>>"


def longer_anchors(found: DataFrame, width: int, length: int) -> DataFrame:
    """The contexts ``found`` cut at an anchor ``width`` + half of the rest long: (key0, c10, c20, off) of where it comes from, and a context.

    A string of ``length`` bytes with the anchor of ``width`` bytes in it goes on for half of the rest
    at least on one side of it. Where that is the right side the longer anchor goes on to the
    right, else to the left. Equal strings choose alike, and each choice's starts follow each
    other, so a context is cut in two at most, from its start ``off`` on.
    """
    rest = length - width
    half = (rest + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cut, hashed, parts = [], [], [], []
            for i, (n, lead, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (4, 5, 6)), strict=True)):
                turn = min(n, max(0, lead - (rest - half)))  # from this start on the right side is long enough
                for a, z, place in ((0, turn, lead - half), (turn, n, lead)):
                    if a < z:
                        at.append(i)
                        cut.append((a, z - a, place - a))
                        parts.append(text[a : z + length - 1])
                        hashed.append(xxhash.xxh3_64_digest(text[place : place + width + half]) + xxhash.xxh3_128_digest(parts[-1], place - a))
            ids = pa.array(np.array(at, np.int64))
            off, n, lead = (pa.array(x.copy()) for x in np.array(cut, np.int32).reshape(-1, 3).T)
            key, c1, c2 = (pa.array(x.copy()) for x in np.frombuffer(b"".join(hashed), np.int64).reshape(-1, 3).T)
            key0, c10, c20, times = (batch.column(c).take(ids) for c in range(4))
            columns = [key0, c10, c20, off, key, c1, c2, times, n, lead, pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key0", "c10", "c20", "off", "key", "c1", "c2", "times", "n", "lead", "bytes"])

    return map_arrow(found, run, "key0 long, c10 long, c20 long, off int, " + CONTEXT)


def repeated_in(distinct: DataFrame, found: Callable[[DataFrame], DataFrame], length: int, width: int = ANCHOR) -> DataFrame:
    """(key, c1, c2, spans) of the different contexts (key, c1, c2, times, n, ...); ``found`` gives some of them their bytes.

    A context alone in its group is repeated as a whole or not at all, and needs no bytes. Groups of up to GROUP
    contexts are marked column by column. Larger ones are cut at longer anchors, which
    makes groups anew, until none is large; at an anchor of ``length`` bytes a group has one context.
    """
    sizes = stage(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("_size")))
    sized = distinct.join(sizes, "key")
    whole = F.array(F.struct(F.lit(0).alias("o"), F.col("n").alias("l")))
    alone = sized.filter("_size = 1 AND times > 1").select("key", "c1", "c2", whole.alias("spans"))
    several = found(sized.filter("_size > 1").drop("_size"))
    large = sizes.filter(F.col("_size") > GROUP).select("key")
    if large.isEmpty():
        return alone.unionByName(marked(several, length))
    several = stage(several)
    cut = stage(longer_anchors(several.join(large, "key", "left_semi").select(*several.columns), width, length))
    first = [F.first(c).alias(c) for c in ("n", "lead", "bytes")]  # equal in all rows of a context
    parts = stage(cut.groupBy("key", "c1", "c2").agg(F.sum("times").alias("times"), *first))
    deeper = repeated_in(parts, lambda some: some, length, width + (length - width + 1) // 2)
    back = cut.select("key0", "c10", "c20", "off", "key", "c1", "c2").join(deeper, ["key", "c1", "c2"])
    moved = F.transform("spans", lambda x: F.struct((x["o"] + F.col("off")).alias("o"), x["l"].alias("l")))
    back = back.select(F.col("key0").alias("key"), F.col("c10").alias("c1"), F.col("c20").alias("c2"), moved.alias("spans"))
    return alone.unionByName(marked(several.join(large, "key", "left_anti").select(*several.columns), length)).unionByName(back)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``spans`` array<struct<start, end>>, ``kept`` binary.

    Bytes covered by a ``length``-byte string that also starts anywhere else, in this or another text, are
    removed; strings are judged on the input and overlaps count. The
    collection is built column by column over the contexts around anchors that occur twice
    or more: a document's other bytes can't be in a repeated string (see ``anchor_runs``).
    Equal contexts go into it once and share what is found, so a group of copies costs as much
    as one of them; groups of more than GROUP different contexts are cut at longer anchors
    (``repeated_in``).

    Null text counts as empty: no bytes, no spans. Texts shorter than ``length`` keep all.
    Rows that repeat an id, or have none, are told apart by their texts; equal ones count as copies of
    each other. An empty table gives an empty result. Columns not named are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    # tables of their own, so that both sides of the join are plain exchanges, which Spark splits at a hot anchor
    twice = stage(run_keys(rows, length).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key"))
    shared = stage(runs(rows, length).join(twice, "key"))
    place = [F.first(c).alias(c) for c in (*ROW, "start", "n", "lead")]  # all of one row; any will do
    distinct = stage(shared.groupBy("key", "c1", "c2").agg(F.count(F.lit(1)).alias("times"), *place))
    marks = repeated_in(distinct, lambda some: contexts(rows, some, length), length)
    hits = shared.join(stage(marks), ["key", "c1", "c2"])
    hits = hits.select(*ROW, F.explode(F.transform("spans", lambda s: F.struct((F.col("start") + s["o"]).alias("start"), s["l"].alias("n")))).alias("s"))
    per_doc = hits.groupBy(*ROW).agg(F.sort_array(F.collect_set("s")).alias("marks"))
    both = rows.alias("d").join(per_doc.alias("p"), same_row("d", "p"), "left").select("d.doc_id", "text", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2)
            for first, texts in blocks(batch.column(1)):
                spans, kept = [], []
                for i, text in enumerate(texts):
                    merged: list[list[int]] = []
                    for s in marks[first + i].as_py() or ():
                        a, b = s["start"], s["start"] + s["n"] - 1 + length
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    at = [0, *(x for s in merged for x in s), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True)))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                sizes = pa.array([len(x) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), sizes, pa.array(spans, CUT), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(both, cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


CUT = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def repeats_digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
