"""Vectorised views of text columns: bytes, words and hashes without a Python loop per word.

A word is a maximal run of bytes outside `[\\x20\\x09-\\x0D]`; A-Z are lower-cased first. Words are hashed
to 64 bits: a polynomial over the bytes modulo 2**64 (prefix sums give the hash of any slice), then a
bijective mix. Long texts are cut into pieces at white space, so memory is bounded by the piece size
and by the longest single word, never by the longest text. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept between calls."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, PIECE + 4096)
        with np.errstate(over="ignore"):
            up, down = np.full(size, BASE), np.full(size, BASE_INVERSE)
            up[0] = down[0] = 1
            _powers, _inverses = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and int64 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first row, bytes, offsets, more) of groups of whole texts up to limit bytes. A longer text comes
    alone, cut at white space; more tells that its next piece follows."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        if end > row:
            yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], False
            row = end
            continue
        at, stop = int(offsets[row]), int(offsets[row + 1])
        while at < stop:
            cut = min(at + limit, stop)
            while cut < stop:
                gaps = np.flatnonzero(SPACE[data[cut : cut + 65536]])
                cut = min(cut + 65536, stop) if not len(gaps) else cut + int(gaps[0])
                if len(gaps):
                    break
            yield row, data[at:cut], np.array([0, cut - at], np.int64), cut < stop
            at = cut
        row += 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1] | edge[1:-1]
    last[:-1] &= space[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of (data[k] + 1) * BASE**k over i <= k < j."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], given prefix_hash(data)."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's first index among them (one more at the end).
    fold maps bytes first; it must keep white space. With stems, each word is followed by the hashes of
    its first so many bytes, 0 where it has no more than that."""
    data = fold[data]
    starts, ends, first = word_spans(data, offsets)
    prefix = prefix_hash(data)
    words = slice_hash(prefix, starts, ends)
    if stems:
        short = [np.where(ends - starts > k, slice_hash(prefix, starts, np.minimum(ends, starts + k)) ^ np.uint64(k), np.uint64(0)) for k in stems]
        words, first = np.stack([words, *short], axis=1).reshape(-1), first * (1 + len(stems))
    return words, first


def words_of_texts(column: pa.Array, fold: np.ndarray = LOWER, stems: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, firsts) of whole texts; the pieces of a long text are put together again."""
    data, offsets = text_buffers(column)
    held: list[np.ndarray] = []
    for row, part, bounds, more in pieces(data, offsets):
        hashes, first = word_hashes(part, bounds, fold, stems)
        if more or held:
            held.append(hashes)
            if more:
                continue
            hashes, held = np.concatenate(held), []
            first = np.array([0, len(hashes)], np.int64)
        yield row, row + len(first) - 1, hashes, first


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a text and each text's first index among them. A text with
    fewer words, but one at least, has its whole sequence as the only shingle."""
    count = np.diff(first)
    own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_first = np.concatenate([[0], np.cumsum(own)]).astype(np.int64)
    at = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], own)
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        size = np.repeat(np.minimum(count, n), own)
        for k in range(n):
            has = size > k
            take = words[np.where(has, at + k, 0)] if len(words) else np.zeros(len(at), np.uint64)
            total = total * np.uint64(0xD6E8FEB86659FD93) + np.where(has, take, np.uint64(0))
        return mix(total + size.astype(np.uint64)), out_first
