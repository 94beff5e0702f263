"""Byte-level BPE of whole texts with the tokenizers library, each distinct piece encoded once.

The library's pre-tokeniser splits a text by a fixed pattern before any merge; no merge crosses such
a split.  Texts are cut at places that are splits for certain: before a single space or newline
between printable characters, after such a newline, and between a letter or digit and punctuation.
A piece's ids do not depend on its surroundings, so a text's ids are those of its pieces in turn.
"""

from __future__ import annotations

import os

import numpy as np

from . import _text

_PRINTABLE = _text._flags(range(0x21, 0x7F))
_ALNUM_ASCII = _text._flags([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
_PUNCTUATION = _PRINTABLE & ~_ALNUM_ASCII
_PUNCTUATION[0x27] = False  # an apostrophe may begin a contraction
#: Pieces that a worker keeps at most, and their bytes; then it starts again with none.
CACHE_PIECES, CACHE_BYTES = 800_000, 16 << 20
_SLOT_BITS = 20


def piece_starts(data: np.ndarray, offsets: np.ndarray, whole: list[bytes] = ()) -> np.ndarray:
    """Sorted starts of the pieces of all texts; no cut falls inside one of the strings of whole."""
    found = []
    for lo, hi in _text.windows(len(data)):
        near = slice(max(0, lo - 3), min(len(data), hi + 1))  # a cut depends on three bytes before and one behind
        cut = _cuts(data[near])[lo - near.start :][: hi - lo]
        found.append(np.flatnonzero(cut) + lo)
    # at the border of two texts the rules judge by the other text's byte, which does no harm: a
    # space or newline that ends a text is a split of its own, and every text begins a piece
    starts = np.concatenate([*found, offsets[:-1][np.diff(offsets) > 0]])
    starts = _text.distinct(starts)
    if whole and len(starts):
        raw, keep = data.tobytes(), np.ones(len(starts), bool)
        for token in whole:
            at = raw.find(token)
            while at >= 0:
                keep[np.searchsorted(starts, at + 1) : np.searchsorted(starts, at + len(token))] = False
                at = raw.find(token, at + 1)
        keep[np.searchsorted(starts, offsets[:-1][np.diff(offsets) > 0])] = True
        starts = starts[keep]
    return starts


def _cuts(data: np.ndarray) -> np.ndarray:
    n = len(data)
    b = np.zeros(n + 3, np.uint8)  # two bytes before, one after
    b[2 : n + 2] = data
    latin = np.zeros(n + 3, bool)  # the second byte of U+00C0..U+00FF
    latin[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80)
    printable = _PRINTABLE[b] | latin
    letter = _ALNUM_ASCII[b] | (latin & (b != 0x97) & (b != 0xB7))
    begins = _PRINTABLE[b] | (b == 0xC3)
    here, before, after = slice(2, n + 2), slice(1, n + 1), slice(3, n + 3)
    gap = printable[before] & begins[after]
    newline = gap & (b[here] == 0x0A)
    cut = (gap & (b[here] == 0x20)) | newline | (letter[before] & _PUNCTUATION[b[here]])
    cut[1:] |= newline[:-1]
    return cut


def _high(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _low(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    if size <= len(a):
        return a
    out = np.zeros(max(size, len(a) + len(a) // 2), a.dtype)
    out[: len(a)] = a
    return out


class PieceEncoder:
    """Encodes batches of texts; keeps the ids and the bytes of the pieces it has met, up to CACHE_PIECES.

    A piece is found by a hash and then compared byte by byte, so that pieces of equal hashes keep their
    own ids.  Pieces longer than LONG_WORD bytes are encoded each time."""

    def __init__(self, path: str, encode_special_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = encode_special_tokens
        #: Strings that the library takes out of a text before it splits it; never cut inside them.
        self.special = [] if encode_special_tokens else [str(t).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.begins, self.counts, self.at, self.sizes = (np.zeros(1 << 12, np.int32) for _ in range(4))
        self.body = np.zeros(1 << 16, np.uint8)
        self.ids, self.pieces, self.used, self.bytes = np.zeros(1 << 14, np.uint32), 0, 0, 0
        self.high, self.low = np.full(1 << _SLOT_BITS, -1, np.int32), np.full(1 << _SLOT_BITS, -1, np.int32)
        self.rest: dict[int, int] = {}

    def _learn(self, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray | None) -> np.ndarray:
        """Encode pieces and append them; with hashes, so that they can be found again."""
        raw = body.tobytes()
        pieces = [raw[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        got = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        counts = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.fromiter((i for ids in got for i in ids), np.uint32, int(counts.sum()))
        new = np.arange(self.pieces, self.pieces + len(got))
        text = np.frombuffer(b"".join(pieces), np.uint8) if hashes is not None else np.zeros(0, np.uint8)
        self.ids = _grown(self.ids, self.used + len(flat))
        self.body = _grown(self.body, self.bytes + len(text) + 8)
        self.begins, self.counts, self.at, self.sizes = (_grown(x, self.pieces + len(got)) for x in (self.begins, self.counts, self.at, self.sizes))
        self.begins[new], self.counts[new] = self.used + np.cumsum(counts) - counts, counts
        self.at[new], self.sizes[new] = self.bytes + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.body[self.bytes : self.bytes + len(text)] = text
        self.pieces, self.used, self.bytes = self.pieces + len(got), self.used + len(flat), self.bytes + len(text)
        known = new
        if hashes is not None:
            for table, slots in ((self.high, _high), (self.low, _low)):
                slot = slots(hashes)
                free = table[slot] < 0
                table[slot[free]] = new[free]
                left = table[slot] != new
                new, hashes = new[left], hashes[left]
            self.rest.update(zip(hashes.tolist(), new.tolist(), strict=True))
        return known

    def _same(self, index: np.ndarray, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the pieces kept at index are those of the body; false for an index of -1."""
        out = (index >= 0) & (self.sizes[index] == sizes)
        left, done = np.flatnonzero(out), 0
        mine, kept = (np.ndarray((len(x) - 7,), "<u8", x, strides=(1,)) for x in (body, self.body))
        while len(left):
            mask = _text._FIRST[np.minimum(sizes[left] - done, 8)]
            equal = (mine[starts[left] + done] ^ kept[self.at[index[left]] + done]) & mask == 0
            out[left[~equal]] = False
            left, done = left[equal], done + 8
            left = left[sizes[left] > done]
        return out

    def _find(self, hashes: np.ndarray, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the pieces are kept; -1 for those that are not."""
        index = self.high[_high(hashes)]
        index[~self._same(index, body, starts, sizes)] = -1
        for slots in (self.low, None):
            miss = np.flatnonzero(index < 0)
            if not len(miss):
                break
            if slots is not None:
                second = slots[_low(hashes[miss])]
            elif self.rest:
                second = np.fromiter((self.rest.get(h, -1) for h in hashes[miss].tolist()), np.int32, len(miss))
            else:
                break
            index[miss] = np.where(self._same(second, body, starts[miss], sizes[miss]), second, -1)
        return index

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of pieces, and how many each has."""
        if self.pieces > CACHE_PIECES or self.bytes > CACHE_BYTES or self.used > 4 * CACHE_PIECES:
            self._clear()
        body = np.zeros(len(data) + 8, np.uint8)
        body[:-8] = data
        hashes, sizes = _text.span_hashes(data, starts, ends, _text.SAME), ends - starts
        short = sizes <= _text.LONG_WORD
        index = np.full(len(starts), -1, np.int64)
        index[short] = self._find(hashes[short], body, starts[short], sizes[short])
        unknown = np.flatnonzero(short & (index < 0))
        if len(unknown):
            distinct, first = np.unique(hashes[unknown], return_index=True)
            new = unknown[first]
            self._learn(body, starts[new], sizes[new], distinct)
            index[unknown] = self._find(hashes[unknown], body, starts[unknown], sizes[unknown])
        odd = np.flatnonzero(index < 0)  # long ones, and those whose hash is another piece's
        if len(odd):
            index[odd] = self._learn(body, starts[odd], sizes[odd], None)
        counts = self.counts[index].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[np.repeat(self.begins[index].astype(np.int64) - upto[:-1], counts) + np.arange(upto[-1])], counts

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the n + 1 offsets of each text's ids."""
        starts = piece_starts(data, offsets, self.special)
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        parts, sizes, first = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        while first < len(starts):
            lo = int(starts[first])
            upto = max(first + 1, int(np.searchsorted(ends, lo + _text.SLICE_BYTES, "right")))
            ids, counts = self._encoded(data[lo : int(ends[upto - 1])], starts[first:upto] - lo, ends[first:upto] - lo)
            parts.append(ids)
            sizes.append(counts)
            first = upto
        flat = np.concatenate(parts)
        ids_at = np.cumsum(np.concatenate(sizes))[np.searchsorted(starts, offsets)]
        if end_id is None:
            return flat, ids_at
        n = len(offsets) - 1
        out = np.full(len(flat) + n, end_id, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(ids_at))] = flat
        return out, ids_at + np.arange(n + 1)


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, encode_special_tokens: bool = False) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; kept, within the bounds above, until other work comes."""
    key = (path, encode_special_tokens)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(path, encode_special_tokens)
    return _ENCODERS[key]


def release() -> bool:
    """Drop the worker's encoders; whether there were any."""
    some = bool(_ENCODERS)
    _ENCODERS.clear()
    return some
