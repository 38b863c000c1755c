"""Words and shingles of many texts at a time, as NumPy arrays, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers = [np.ones(1, U), np.ones(1, U)]

#: Texts are handled in blocks of about so many bytes.
BLOCK = 1 << 21


def _lower() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


LOWER = _lower()
#: Bytes of words that are anything but white space.
NOT_SPACE = np.array([not (b == 0x20 or 9 <= b <= 13) for b in range(256)])
#: Bytes of words made of ASCII letters, digits and everything beyond ASCII.
ALPHANUMERIC = np.array([48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, _INVERSE)):
            x = np.full(size, b, U)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in blocks of about BLOCK bytes; null as empty; a text of more than that is alone."""
    rows = [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]
    first, size = 0, 0
    for i, x in enumerate(rows):
        if i > first and size + len(x) > BLOCK:
            yield first, rows[first:i]
            first, size = i, 0
        size += len(x)
    if rows:
        yield first, rows[first:]


def pieces(text: bytes, kind: np.ndarray, before: int, after: int) -> Iterator[tuple[int, int, bytes]]:
    """(number of the piece's first word, first own word, bytes) of pieces of about BLOCK bytes, each of whole words.

    Own words of a piece begin where those of the last one ended; up to ``before`` words stand before
    them and ``after`` words after them. So what is looked at word by word needs memory for one piece alone.
    """
    inside = kind[np.frombuffer(text, np.uint8)]
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if len(inside) and inside[0]:
        start = np.append(0, start)
    del inside
    first = 0
    while first < len(start):
        end = int(np.searchsorted(start, start[first] + BLOCK))
        lo, hi = max(0, first - before), end + after
        yield lo, first, text[start[lo] : start[hi] if hi < len(start) else len(text)]
        first = end


def words(texts: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of each word: its text's number, first byte, end and 64-bit hash; and the joined bytes.

    ASCII letters count as lower case in the hash.
    """
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    inside = kind[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((LOWER[raw].astype(U) + U(1)) * up[:-1], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start])
    ends = np.cumsum([len(x) + 1 for x in texts])
    return np.searchsorted(ends, start, side="right"), start, end, hashed, joined


def grams(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; meaningless for the last size - 1."""
    n = max(0, len(hashed) - size + 1)
    out = np.full(n, U(size), U)
    for k in range(size):
        out = mix(out * U(3) + hashed[k : k + n])
    return out


def shingle_sets(texts: list[bytes], kind: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of each text, sorted.

    A text with fewer words than ``size``, but not none, has its whole word sequence as one. A long
    text is taken in pieces.
    """
    if len(texts) == 1 and len(texts[0]) > 2 * BLOCK:
        found = [np.unique(grams(words([piece], kind)[3], size)) for _, _, piece in pieces(texts[0], kind, 0, size - 1)]
        found = np.unique(np.concatenate([*found, np.zeros(0, U)]))
        if len(found):
            return np.zeros(len(found), np.int64), found
    doc, _, _, hashed, _ = words(texts, kind)
    count = np.bincount(doc, minlength=len(texts))
    g = grams(hashed, size)
    whole = doc[: len(g)] == doc[size - 1 :] if len(g) else np.zeros(0, bool)
    docs, values = [doc[: len(g)][whole]], [g[whole]]
    first = np.cumsum(count) - count
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            docs.append(short)
            values.append(grams(hashed, n)[first[short]])
    docs, values = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    return docs[fresh], values[fresh]
