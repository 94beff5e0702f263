"""Vectorised tokenising of Arrow string columns: words, their 64-bit hashes and shingles.

A batch of texts stays one UTF-8 buffer.  Words are runs of bytes of a class given as a table of
256 flags; their hashes take eight bytes of all words at a time, so that no Python loop touches single
words but very long ones.  Work goes by slices and windows of bounded size, so that memory does not
follow the length of a text by more than what is kept of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles at most, unless a single text is longer; and texts.
SLICE_BYTES, SLICE_ROWS = 512 << 10, 16_383
#: Bytes from which a word is hashed on its own.
LONG_WORD = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first k bytes of a little-endian long.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _flags(chars) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Words of the contracts: all but space and \t \n \v \f \r.
NON_SPACE = ~_flags([0x20, *range(0x09, 0x0E)])
#: ASCII digits and letters, and whatever is not ASCII.
ALNUM = _flags([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Maps A-Z to a-z and keeps every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of at most limit bytes; a longer text makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + SLICE_ROWS)
        yield i, j
        i = j


def windows(size: int, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Consecutive ranges that cover 0 to size."""
    step = limit or SLICE_BYTES
    for lo in range(0, size, step):
        yield lo, min(lo + step, size)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; by a sort, which vectorises where np.unique hashes one value at a time."""
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return values[fresh]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the n + 1 offsets of each text's words."""
    found: tuple[list, list] = ([], [])
    for lo, hi in windows(len(data)):
        flags = np.zeros(hi - lo + 2, bool)  # with a byte before and one behind
        a, b = max(lo - 1, 0), min(hi + 1, len(data))
        flags[a - lo + 1 : b - lo + 1] = inside[data[a:b]]
        own = flags[1:-1]
        edges = own & ~flags[:-2], own & ~flags[2:]
        for edge, places, out in zip(edges, (offsets[:-1], offsets[1:] - 1), found, strict=True):
            at = places[np.searchsorted(places, lo) : np.searchsorted(places, hi)] - lo
            edge[at] = own[at]  # words end where texts do
            out.append(np.flatnonzero(edge) + lo)
    starts, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    return starts, last + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hashes of byte spans, in ascending order of their starts, after mapping each byte by fold."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        lo = int(starts[done])
        upto = max(done + 1, int(np.searchsorted(ends, lo + SLICE_BYTES, "right")))
        body = np.zeros(int(ends[upto - 1]) - lo + 8, np.uint8)
        body[:-8] = fold[data[lo : lo + len(body) - 8]]
        out[done:upto] = _hashed(body, starts[done:upto] - lo, (ends - starts)[done:upto])
        done = upto
    return out


def _hashed(body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the spans of a body with eight spare bytes behind."""
    longs = np.ndarray((len(body) - 7,), "<u8", body, strides=(1,))  # the eight bytes from each place on
    h = mix((longs[starts] & _FIRST[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * _BASE)
    left = np.flatnonzero(sizes > 8)
    if len(left):
        far = sizes[left] > LONG_WORD
        for k in left[far].tolist():
            whole = body[starts[k] : starts[k] + sizes[k]].tobytes()
            h[k] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
        left, done = left[~far], 8
        while len(left):
            part = longs[starts[left] + done] & _FIRST[np.minimum(sizes[left] - done, 8)]
            h[left] = mix(h[left] * _BASE + part)
            done += 8
            left = left[sizes[left] > done]
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and the n + 1 offsets of each text's words."""
    starts, ends, words = spans(data, offsets, inside)
    return span_hashes(data, starts, ends, fold), words


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one text; of the whole text if it has fewer words."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    out = np.full(n - size + 1, np.uint64(size), np.uint64)
    for j in range(size):
        out = out * _BASE + words[j : n - size + 1 + j]
    return mix(out)


def each_slice(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column, slice by slice."""
    data, offsets = utf8(column)
    for i, j in slices(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def folding(inside: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """A table that maps bytes of words by fold and all others to a space."""
    return np.where(inside, fold, 0x20).astype(np.uint8)


def tokens(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as they are spelled after folding() by the table, and the text of each."""
    body = table[data]
    texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
    split = pc.ascii_split_whitespace(texts)
    words, parents = pc.list_flatten(split), pc.list_parent_indices(split)
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), parents.filter(some).to_numpy().astype(np.int64)
