"""Large dictionaries in texts: every pattern is reached by its rarest window of eight bytes alone.

The windows of all patterns' choice are looked up at each place of a block of texts, behind a filter of bits;
where one stands, the pattern is compared whole. What leaves a task is true hits and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.sources.arrow import map_arrow

U = np.uint64
#: Bytes of a window, of texts that are looked at together, and pairs that are compared at a time.
WIDE, BLOCK, PAIRS = 8, 1 << 21, 1 << 20
#: Patterns and their bytes at most; the index is sent to the tasks.
MOST, MOST_BYTES = 1_000_000, 1 << 26


def _packed(raw: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each place on as one number; a text shorter than that has none."""
    n = max(0, len(raw) - width + 1)
    out = np.zeros(n, U)
    for k in range(width):
        out = (out << U(8)) | raw[k : k + n]
    return out


@dataclass
class _Windows:
    """Patterns of one window width by their window: sorted ``keys``, the ``patterns`` of each, where the window stands in them."""

    width: int
    keys: np.ndarray
    first: np.ndarray
    patterns: np.ndarray
    places: np.ndarray
    bits: np.ndarray

    def slots(self, packed: np.ndarray) -> np.ndarray:
        return (packed * U(0x9E3779B97F4A7C15)) >> U(64 - (len(self.bits) - 1).bit_length())

    @classmethod
    def of(cls, width: int, keys: np.ndarray, patterns: np.ndarray, places: np.ndarray) -> _Windows:
        order = np.argsort(keys, kind="stable")
        unique, first = np.unique(keys[order], return_index=True)
        out = cls(width, unique, np.append(first, len(keys)), patterns[order], places[order], np.zeros(1 << max(10, (32 * len(keys)).bit_length()), bool))
        out.bits[out.slots(unique)] = True
        return out


@dataclass
class Dictionary:
    """An index of distinct patterns, which are not empty; a pattern's number is its place in the list."""

    size: np.ndarray
    start: np.ndarray
    packed: np.ndarray
    windows: list[_Windows]

    @classmethod
    def of(cls, patterns: Sequence[bytes]) -> Dictionary:
        if len(patterns) > MOST or sum(map(len, patterns)) > MOST_BYTES:
            raise ValueError(f"a dictionary has {MOST} patterns and {MOST_BYTES} bytes at most")
        if not all(patterns):
            raise ValueError("empty patterns match nothing and have no place in a dictionary")
        size = np.array([*map(len, patterns)], np.int64)
        start = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(patterns), np.uint8)
        packed = _packed(np.append(raw, np.zeros(WIDE - 1, np.uint8)), WIDE)
        windows = []
        for width in range(1, WIDE + 1):
            mine = np.flatnonzero(size == width if width < WIDE else size >= WIDE)
            if not len(mine):
                continue
            count = size[mine] - width + 1
            head = np.cumsum(count) - count
            place = np.arange(count.sum()) - np.repeat(head, count)
            key = packed[np.repeat(start[mine], count) + place] >> U(8 * (WIDE - width))
            _, same, times = np.unique(key, return_inverse=True, return_counts=True)
            rarest = np.minimum.reduceat(times[same] * (int(size.max()) + 1) + place, head) % (int(size.max()) + 1)
            windows.append(_Windows.of(width, key[head + rarest], mine, rarest))
        return cls(size, start, packed, windows)

    def hits(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, pattern) of what is contained, each pair once, in order."""
        ends = np.cumsum([*map(len, texts)])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        wide = _packed(np.append(raw, np.zeros(WIDE - 1, np.uint8)), WIDE)
        found = [np.zeros(0, np.int64)]
        for w in self.windows:
            packed = wide >> U(8 * (WIDE - w.width))
            at = np.flatnonzero(w.bits[w.slots(packed)])
            key = np.minimum(np.searchsorted(w.keys, packed[at]), len(w.keys) - 1)
            same = w.keys[key] == packed[at]
            at, key = at[same], key[same]
            upto = np.cumsum(w.first[key + 1] - w.first[key])
            lo = 0
            while lo < len(at):  # some pairs at a time
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS)))
                found.append(self._compared(w, at[lo:hi], key[lo:hi], wide, ends))
                lo = hi
        return np.divmod(np.unique(np.concatenate(found)), len(self.size))

    def _compared(self, w: _Windows, at: np.ndarray, key: np.ndarray, wide: np.ndarray, ends: np.ndarray) -> np.ndarray:
        count = w.first[key + 1] - w.first[key]
        slot = np.arange(count.sum()) + np.repeat(w.first[key] - (np.cumsum(count) - count), count)
        pattern = w.patterns[slot]
        begin = np.repeat(at, count) - w.places[slot]
        text = np.searchsorted(ends, begin, side="right")
        fine = begin >= 0
        fine[fine] = begin[fine] + self.size[pattern[fine]] <= ends[np.minimum(text[fine], len(ends) - 1)]
        pattern, begin, text = pattern[fine], begin[fine], text[fine]
        if w.width == WIDE:
            for off in range(0, int(self.size[pattern].max(initial=0)), WIDE):  # eight bytes a step, the last ones from the end
                step = np.minimum(off, self.size[pattern] - WIDE)
                same = wide[begin + step] == self.packed[self.start[pattern] + step]
                pattern, begin, text = pattern[same], begin[same], text[same]
        return np.unique(text * len(self.size) + pattern)

    def of_rows(self, texts: Sequence[bytes | None]) -> list[np.ndarray]:
        """Numbers of the patterns in each text, in order. A long text is looked at in overlapping pieces."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        over = int(self.size.max(initial=1)) - 1

        def flush() -> None:
            text, pattern = self.hits([t for _, t in held])
            for k, part in enumerate(np.split(pattern, np.searchsorted(text, np.arange(1, len(held))))):
                if len(part):
                    out[held[k][0]].append(part)
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            for a in range(0, max(1, len(text or b"") - over), BLOCK):
                piece = (text or b"")[a : a + BLOCK + over]
                held.append((i, piece))
                size += len(piece)
                if size >= BLOCK:
                    flush()
                    size = 0
        if held:
            flush()
        return [np.unique(np.concatenate(x)).astype(np.int32) if x else np.zeros(0, np.int32) for x in out]


def pattern_hits(df: DataFrame, text: str, dictionary: Dictionary, name: str = "hits") -> DataFrame:
    """``df`` with ``name``: the numbers of the dictionary's patterns that ``text`` contains, in order; null text has none.

    Rows stay where they are: no exchange and no row for a pattern that is not contained.
    """
    shared = df.sparkSession.sparkContext.broadcast(dictionary)  # MOST_BYTES bound it
    fields = [f.name for f in df.schema]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = shared.value.of_rows(batch.column("_text").cast(pa.large_binary()).to_pylist())
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int32)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.column("_row").flatten(), hits], [*fields, name])

    schema = StructType([*df.schema.fields, StructField(name, ArrayType(IntegerType()))])
    return map_arrow(df.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), batches, schema)
