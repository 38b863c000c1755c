"""Byte-level BPE by a given rank file: texts to ids and back, in length-bucketed padded matrices."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessera.llm.common import map_arrow

#: No rank: greater than any.
NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Widths of the padded matrices; a longer match is a row of its own.
WIDTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512, 1024, 2048)
#: Cells of a matrix, pieces of a text and bytes of texts that are taken at a time.
CELLS, PIECES, BLOCK = 1 << 19, 1 << 17, 1 << 21


@dataclass
class Vocabulary:
    """Ranks of byte strings with the pairs of tokens that merge into one, in a table of hashed pairs."""

    flat: bytes
    ends: np.ndarray
    keys: np.ndarray
    merged: np.ndarray
    pattern: str

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        """An error if a byte has no rank of its own or ranks are not 0..n-1: some text would have no ids."""
        if not all(bytes([b]) in ranks for b in range(256)) or sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must be 0..n-1 and hold each single byte")
        tokens = sorted(ranks, key=ranks.get)
        pairs = [(a << 32 | b, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        keys, values = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int32)
        bits = max(4, (4 * len(pairs)).bit_length())
        table, merged = np.full(1 << bits, EMPTY), np.full(1 << bits, NONE, np.int32)
        slot, left = (keys * _SPREAD) >> np.uint64(64 - bits), np.arange(len(keys))
        while len(left):  # open addressing: of those that want a free slot one gets it, the others go on
            free = left[table[slot[left]] == EMPTY]
            _, one = np.unique(slot[free], return_index=True)
            table[slot[free[one]]], merged[slot[free[one]]] = keys[free[one]], values[free[one]]
            left = left[table[slot[left]] != keys[left]]
            slot[left] = (slot[left] + np.uint64(1)) & np.uint64(len(table) - 1)
        return cls(b"".join(tokens), np.cumsum([0, *map(len, tokens)]), table, merged, pattern)

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a file of lines ``base64 rank``."""
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
        return cls.of({base64.b64decode(a): int(b) for a, b in lines}, pattern)

    @cached_property
    def whole(self) -> dict[bytes, int]:
        return {self.flat[a:b]: i for i, (a, b) in enumerate(zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True))}

    @cached_property
    def bytes_(self) -> np.ndarray:
        return np.array([self.whole[bytes([b])] for b in range(256)], np.int32)

    @cached_property
    def split(self) -> regex.Pattern:
        return regex.compile(self.pattern)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into; NONE where there is none or a side is padding (-1)."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = (key * _SPREAD) >> np.uint64(64 - (len(self.keys).bit_length() - 1))
        held = self.keys[slot]
        out = np.where(held == key, self.merged[slot], NONE)
        away = np.nonzero((held != key) & (held != EMPTY))
        while len(away[0]):
            slot[away] = (slot[away] + np.uint64(1)) & np.uint64(len(self.keys) - 1)
            held = self.keys[slot[away]]
            same = held == key[away]
            out[tuple(x[same] for x in away)] = self.merged[slot[away][same]]
            away = tuple(x[~same & (held != EMPTY)] for x in away)
        out[(a < 0) | (b < 0)] = NONE
        return out

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The tokens' bytes joined, and where each one ends."""
        start = self.ends[ids]
        size = self.ends[ids + 1] - start
        end = np.cumsum(size)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)
        return np.frombuffer(self.flat, np.uint8)[at].tobytes(), end


def merge_rows(ids: np.ndarray, vocab: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of rows, their final ids padded with -1). Each round merges every row's leftmost pair of the least rank.

    The row is then closed up by one column; rows without a pair leave the matrix.
    """
    row = np.arange(len(ids))
    ranks = vocab.pairs(ids[:, :-1], ids[:, 1:])
    while ids.shape[1] > 1:
        at = ranks.argmin(1)
        best = ranks[np.arange(len(ids)), at]
        live = best < NONE
        if not live.all():
            yield row[~live], ids[~live]
            row, ids, ranks, at, best = row[live], ids[live], ranks[live], at[live], best[live]
        if not len(row):
            return
        here = np.arange(len(row))
        after = np.arange(ids.shape[1] - 1) > at[:, None]
        ids = np.where(after, ids[:, 1:], ids[:, :-1])
        ids[here, at] = best
        if ids.shape[1] > 1:
            ranks = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            before, behind = here[at > 0], here[at < ranks.shape[1]]
            ranks[before, at[before] - 1] = vocab.pairs(ids[before, at[before] - 1], best[before])
            ranks[behind, at[behind]] = vocab.pairs(best[behind], ids[behind, at[behind] + 1])
    yield row, ids


def merge_long(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Final ids of one long row.

    Merging leftmost pairs one by one, the same rank comes next as long as no new pair has a lower one. So a round
    merges all occurrences of the least rank, from the left and without overlap, or the leftmost alone
    where a new pair would have a lower rank. The row is closed up whenever half of it is gone.
    """
    while True:
        n = len(ids)
        following, last = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks = np.append(vocab.pairs(ids[:-1], ids[1:]), NONE)
        ids, held = ids.copy(), n
        while 2 * held > n or n < 2:
            best = ranks.min()
            if best == NONE:
                return ids[ids >= 0]
            at = np.flatnonzero(ranks == best)
            joined = following[at[:-1]] == at[1:]
            if joined.any():  # a a a: of pairs that share a token every second one
                start = np.flatnonzero(np.append(True, ~joined))
                at = at[(np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 0]
            new = np.full(len(at), best, np.int32)
            padded = np.append(ids, np.int32(-1))  # the end and what is before the start have no token
            lower = np.minimum(vocab.pairs(padded[last[at]], new), vocab.pairs(new, padded[following[following[at]]])).min()
            if len(at) > 1 and min(lower, vocab.pairs(new[:1], new[:1])[0]) < best:
                at, new = at[:1], new[:1]
            right = following[at]
            ids[at], ids[right], ranks[right] = best, -1, NONE
            following[at] = following[right]
            inner = following[at] < n
            last[following[at][inner]] = at[inner]
            held -= len(at)
            padded = np.append(ids, np.int32(-1))
            ranks[at] = vocab.pairs(new, padded[following[at]])
            some = last[at] >= 0
            ranks[last[at][some]] = vocab.pairs(ids[last[at][some]], new[some])
        ids = ids[ids >= 0]


def encode_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words joined, number of ids of each). A word that is itself a token is that token."""
    known = np.array([vocab.whole.get(w, -1) for w in words], np.int64)
    size = np.array([*map(len, words)])
    rows, found = [np.flatnonzero(known >= 0)], [known[known >= 0].astype(np.int32)]
    count = np.where(known >= 0, 1, 0)
    narrow = 0
    for width in WIDTHS:
        fit = np.flatnonzero((known < 0) & (size > narrow) & (size <= width))
        narrow = width
        step = max(1, CELLS // width)
        for part in (fit[k : k + step] for k in range(0, len(fit), step)):
            filled = np.arange(width) < size[part][:, None]
            ids = np.full(filled.shape, -1, np.int32)
            ids[filled] = vocab.bytes_[np.frombuffer(b"".join([words[i] for i in part]), np.uint8)]
            for row, final in merge_rows(ids, vocab):
                count[part[row]] = (final >= 0).sum(1)
                rows.append(np.repeat(part[row], count[part[row]]))
                found.append(final[final >= 0])
    for i in np.flatnonzero((known < 0) & (size > narrow)):
        final = merge_long(vocab.bytes_[np.frombuffer(words[i], np.uint8)], vocab)
        count[i] = len(final)
        rows.append(np.full(len(final), i))
        found.append(final)
    order = np.argsort(np.concatenate(rows), kind="stable")  # the ids of a word are in order already
    return np.concatenate(found)[order], count


def _pieces(texts: list[str], vocab: Vocabulary) -> Iterator[tuple[int, list[str]]]:
    """(text, some of its next pieces); a long text gives several, so that memory holds PIECES of it."""
    for i, text in enumerate(texts):
        if len(text) <= BLOCK:
            yield i, vocab.split.findall(text)
        else:
            matches = vocab.split.finditer(text)
            while some := [m.group() for m in islice(matches, PIECES)]:
                yield i, some


def encode_texts(texts: list[str], vocab: Vocabulary) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    out: list[list[bytes]] = [[] for _ in texts]

    def flush(held: list[tuple[int, int]], numbers: list[int], seen: dict[str, int]) -> None:
        ids, count = encode_words([w.encode() for w in seen], vocab)
        first = np.cumsum(count) - count
        word = np.array(numbers)
        size = count[word]
        end = np.cumsum(size)
        packed = ids[np.arange(end[-1]) + np.repeat(first[word] - (end - size), size)].astype("<u4").tobytes()
        place = 0
        for i, n in held:
            stop = place + n
            out[i].append(packed[4 * int(end[place - 1]) if place else 0 : 4 * int(end[stop - 1])])
            place = stop

    held, numbers, seen = [], [], {}
    for i, some in _pieces(texts, vocab):
        if some:
            held.append((i, len(some)))
            numbers += [seen.setdefault(w, len(seen)) for w in some]
        if len(numbers) >= 4 * PIECES:
            flush(held, numbers, seen)
            held, numbers, seen = [], [], {}
    if numbers:
        flush(held, numbers, seen)
    return [b"".join(x) for x in out]


def decode_texts(packed: list[bytes], vocab: Vocabulary) -> list[bytes]:
    ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
    if len(ids) and ids.max() >= len(vocab.ends) - 1:
        raise ValueError(f"no token has the id {ids.max()}")
    joined, end = vocab.bytes_of(ids)
    end = np.append(0, end)[np.cumsum([0, *[len(x) // 4 for x in packed]])].tolist()
    return [joined[a:b] for a, b in zip(end[:-1], end[1:], strict=True)]


def _blocks(values: list, most: int) -> Iterator[list]:
    """Values in lists of about ``most`` characters; a longer value is alone."""
    held, size = [], 0
    for x in values:
        if held and size + len(x) > most:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def _mapped(df: DataFrame, column: str, out: str, vocab: Vocabulary, run) -> DataFrame:  # noqa: ANN001
    """``df`` with the binary column ``out``: ``run`` of the values of ``column``, null where it is null."""
    shared = df.sparkSession.sparkContext.broadcast(vocab)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            values = batch.column(column).to_pylist()
            some = [x for x in values if x is not None]
            done = iter([y for block in _blocks(some, BLOCK) for y in run(block, shared.value)])
            made = pa.array([None if x is None else next(done) for x in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out])

    return map_arrow(df, batches, StructType([*df.schema.fields, StructField(out, BinaryType())]))


def encode_bpe(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each text's token ids as little-endian unsigned 32-bit numbers, four bytes an id.

    Every match of the vocabulary's pattern is encoded by itself: it is its own token if it is one, else its bytes are
    merged. Equal matches of a block are merged once, in matrices of padded rows of like length: each round looks
    up pairs by hash, merges every row's leftmost pair of the least rank and closes the row up. One pass
    over the rows without a shuffle; the vocabulary, whose size the rank file bounds, is broadcast. Matches of over 2,048
    bytes are rows of their own (see ``merge_long``), texts of over 2 million characters are taken in pieces, so memory is
    bounded by a text and its ids.

    A null or empty text has no ids. Rows are told apart by nothing: repeated and null ids give
    a row each. No special tokens: their strings are text. An empty table gives an empty one. Columns other than the two named ones are not read.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return _mapped(rows, "_text", "ids", vocab, encode_texts).drop("_text")


def decode_bpe(encoded: DataFrame, vocab: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids joined; they are UTF-8 where the ids are those of a whole text.

    Null ids give null, none give no bytes, an id that no token has is an error. One pass without a shuffle.
    """
    return _mapped(encoded, ids_col, "decoded", vocab, decode_texts)


def bpe_digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``decode_bpe``'s rows."""
    count = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", count.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
