"""Runs: stretches of words that repeat with a period, by Baier's grouping and the runs theorem."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORDS, map_arrow
from tessera.llm.tokens import BLOCK, NOT_SPACE, blocks, grams, mix, pieces, words

OUT = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lyndon_lengths(word: list[int], falling: bool = False) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, in rising or falling order of the letters.

    The first phase of Baier's suffix sorter. Groups hold the places whose known prefix, the group's context, is the same, and
    stand in the order of their contexts. From the highest group down: for each of its places the nearest
    place before it that is in a lower group takes the context up, once for each place that points to it; places of one
    group that took equally many form a group just above their old one, those that took more above
    those that took fewer. When its group is reached, a place's context is its longest Lyndon prefix.
    """
    letters = sorted(set(word), reverse=falling)
    number = {c: k for k, c in enumerate(letters)}
    group = [number[c] for c in word]
    members: list[list[int] | None] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(letters)
    lower, upper = list(range(-1, len(letters) - 1)), list(range(1, len(letters) + 1))
    top = len(letters) - 1
    out = [0] * len(word)
    near = list(range(len(word) + 1))  # of place + 1: itself, or what to look at before it once it is done; 0 is none
    while top >= 0:
        here = [i for i in members[top] if group[i] == top]
        members[top] = None
        length = size[top]
        for i in here:
            out[i], near[i + 1] = length, i
        taken: dict[int, int] = {}
        for i in here:
            p = i
            while near[p] != p:
                near[p] = p = near[near[p]]
            if p:
                taken[p - 1] = taken.get(p - 1, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in taken.items():
            moved.setdefault((times, group[p]), []).append(p)
        for times, old in sorted(moved, reverse=True):
            new = len(members)
            members.append(moved[times, old])
            size.append(size[old] + times * length)
            lower[upper[old]] = new  # never past the end: the old group is below the one at hand
            lower.append(old)
            upper.append(upper[old])
            upper[old] = new
            for p in members[new]:
                group[p] = new
        top = lower[top]
    return out


class Extensions:
    """How far two places of a text agree: names of all blocks of 2^k letters, equal where the blocks are."""

    def __init__(self, text: np.ndarray, longest: int) -> None:
        self.names = [np.unique(text, return_inverse=True)[1].astype(np.int32)]
        while 2 ** len(self.names) <= longest and len(self.names[-1]) > 2 ** (len(self.names) - 1):
            half, last = 2 ** (len(self.names) - 1), self.names[-1]
            pair = last[:-half].astype(np.int64) << 32 | last[half:]
            self.names.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Letters from ``a`` and ``b`` on that agree, a < b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            same = np.flatnonzero(b + out < len(names))
            same = same[names[a[same] + out[same]] == names[b[same] + out[same]]]
            out[same] += 2**k
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Letters before ``a`` and ``b`` that agree, a < b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            same = np.flatnonzero(a - out >= 2**k)
            same = same[names[a[same] - out[same] - 2**k] == names[b[same] - out[same] - 2**k]]
            out[same] += 2**k
        return out


def find_runs(parts: list[list[int]], least: int = 2) -> np.ndarray:
    """(part, start, length, period) of the runs of at least ``least`` letters in each part, by part, start and period.

    Each run has a root that is, in one of the two orders, the longest Lyndon word at its place. So all roots of both
    orders are extended by their length as the period, as far as the text agrees with itself.
    """
    if not any(parts):
        return np.zeros((0, 4), np.int64)
    first = np.cumsum([0, *[len(p) + 1 for p in parts]])
    text = np.full(first[-1], -1, np.int64)
    for k, p in enumerate(parts):
        text[first[k] : first[k + 1] - 1] = p
        text[first[k + 1] - 1] = -1 - k  # differs from all else, so that nothing extends over it
    agree = Extensions(text, max(map(len, parts)))
    found = []
    for falling in (False, True):
        root = np.ones(len(text), np.int64)
        for k, p in enumerate(parts):
            root[first[k] : first[k + 1] - 1] = lyndon_lengths(p, falling)
        at = np.flatnonzero(text >= 0)
        end = at + root[at]
        at, end = (x[(text[at] == text[end]) | ((at > 0) & (text[at - 1] == text[end - 1]))] for x in (at, end))
        start, stop = at - agree.left(at, end), end + agree.right(at, end)
        fit = stop - start >= np.maximum(least, 2 * (end - at))
        found.append(np.stack([start, stop - start, end - at], 1)[fit])
    runs = np.unique(np.concatenate(found), axis=0)
    part = np.searchsorted(first, runs[:, 0], side="right") - 1
    runs = np.column_stack([part, runs[:, 0] - first[part], runs[:, 1], runs[:, 2]])
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def repeated_stretches(texts: list[bytes], size: int) -> Iterator[tuple[int, int, int]]:
    """(text, first word, end) of stretches of words covered by ``size`` words that stand twice in the text.

    By hashes of words without their case: a stretch may be longer than need be, none is missing.
    """
    if len(texts) == 1 and len(texts[0]) > 2 * BLOCK:
        hashed = np.concatenate([words([x], NOT_SPACE)[3] for _, _, x in pieces(texts[0], NOT_SPACE, 0, 0)] or [np.zeros(0, np.uint64)])
        doc = np.zeros(len(hashed), np.int64)
    else:
        doc, _, _, hashed, _ = words(texts, NOT_SPACE)
    g = grams(hashed, size)
    if not len(g):
        return
    key = mix(g ^ mix(doc[: len(g)].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    twice &= doc[: len(g)] == doc[size - 1 :]
    edge = np.zeros(len(doc) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + size] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    new = np.append(True, doc[1:] != doc[:-1])
    start = np.flatnonzero(covered & (new | ~np.append(False, covered[:-1])))
    stop = np.flatnonzero(covered & (np.append(new[1:], True) | ~np.append(covered[1:], False))) + 1
    first = np.searchsorted(doc, doc[start]) if len(start) else start
    yield from zip(doc[start].tolist(), (start - first).tolist(), (stop - first).tolist(), strict=True)


def runs_of_texts(texts: list[bytes], least: int) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """(runs, collapsed text) of each text."""
    stretches = list(repeated_stretches(texts, (least + 1) // 2))
    split = {k: texts[k].split() for k in {s[0] for s in stretches}}
    number: dict[bytes, int] = {}
    found = find_runs([[number.setdefault(w, len(number)) for w in split[k][a:b]] for k, a, b in stretches], least)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for part, start, length, period in found.tolist():
        k, a, _ = stretches[part]
        runs.setdefault(k, []).append((a + start, length, period))
    out = []
    for k, text in enumerate(texts):
        here = split[k] if k in split else text.split()
        if k in runs:
            edge = np.zeros(len(here) + 1, np.int64)
            np.add.at(edge, [s + p for s, _, p in runs[k]], 1)
            np.add.at(edge, [s + n for s, n, _ in runs[k]], -1)
            here = [w for w, drop in zip(here, np.cumsum(edge)[:-1].tolist(), strict=True) if not drop]
        out.append((runs.get(k, []), b" ".join(here)))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(id, runs, collapsed): the runs of each text's words, and the text without what repeats.

    A run (start, length, period) is a stretch of at least ``least`` words and two periods whose words a
    period apart are the same, with no smaller period, that can't be made longer. ``runs`` are ordered by start, then period;
    ``collapsed`` has the words that no run contains after its first period, joined by one space.

    A run repeats each half of ``least`` of its words, so only stretches that are covered by so many words that
    stand twice in the text are looked at, by ``find_runs``; no run crosses the end of such a stretch. One pass without a shuffle. A
    text is in memory whole, with some 400 bytes for each word of such stretches; so a text is one task's work.

    Null and empty texts have no runs and an empty ``collapsed``. Repeated and null ids give a row each. Columns
    other than the two named ones are not read. An empty table gives an empty one.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            done = [x for _, block in blocks(batch.column("_text")) for x in runs_of_texts(block, least)]
            runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r, _ in done], kind)
            text = pa.array([t for _, t in done], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), runs, text], [batch.schema.names[0], "runs", "collapsed"])

    given = rows.schema[0]
    return map_arrow(rows, batches, f"`{given.name}` {given.dataType.simpleString()}, runs {OUT}, collapsed string")


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which the words of every tenth document, by its id's hash, repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", g.alias("_g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("_w"))
    rows = rows.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    places = F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)
    made = F.transform(places, lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.concat_ws(" ", made)).otherwise(F.col("text")).alias("text"))


def runs_digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``periodic_runs``'s rows."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), F.array_join(lines, "").alias("_lines"), longest.alias("_l"))
    length = -F.col("_l.shorter")
    return rows.select(
        "doc_id", "n_runs", F.col("_l.start").alias("start"), length.alias("length"), F.col("_l.period").alias("period"), F.floor(1000 * length / F.col("_l.period")).cast("long").alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
