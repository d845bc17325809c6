"""Vectorised hashes of words, word windows and byte windows (numpy, inside tasks).

A block of texts is one byte array plus document offsets. Every hash is a polynomial over 64-bit integers with random
byte values, taken from prefix sums and then mixed, so a window costs the same whatever its length. Equal content
always has equal hashes on every machine. Unequal content can be made to meet (a polynomial modulo 2**64 maps a long
Thue-Morse word and its complement to the same value), so these hashes only choose, sample, order and balance; where a
result depends on equality, contents are compared, or `strong` hashes are.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE_BYTE = 0x9E3779B97F4A7C15
_BASE_WORD = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE_BYTE))
_powers: dict[int, np.ndarray] = {}


#: Powers kept between calls; longer rows are made when needed, so that idle workers stay small.
_KEPT = 1 << 20


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        row = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        row[0] = 1
        have = np.multiply.accumulate(row)
        if len(have) <= _KEPT:
            _powers[base] = have
    return have[:n]


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * _power(base, len(values)), out=out[1:])
    return out


def _between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Mixed fingerprints of the ranges [start, end)."""
    inverse = _power(pow(base, -1, 1 << 64), len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + U(0x5851F42D4C957F2D))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[data]


def grams(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` values."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    prefix = _prefix(values, _BASE_WORD)
    inverse = _power(pow(_BASE_WORD, -1, 1 << 64), len(prefix))
    return mix((prefix[size:] - prefix[:-size]) * inverse[: len(prefix) - size] + U(0x5851F42D4C957F2D))


def slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over values[i : i + width], for each i with a whole range."""
    have, span = values, 1
    while span * 2 <= width:
        have, span = best(have[:-span], have[span:]), span * 2
    rest = width - span
    return best(have[: len(have) - rest], have[rest:]) if rest else have


def concat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: none) and the n + 1 offsets of the documents."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + 32, data).astype(np.uint8)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of the decontamination rule: digits, lower-case letters and all of UTF-8's multi-byte characters.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class Words:
    """Words of a block: byte ranges, document number of each, and per document the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
        inside = ~separator[data] if len(data) else np.zeros(0, bool)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edge] = inside[edge]
        finishes = inside.copy()
        finishes[:-1] &= ~inside[1:]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        finishes[last] = inside[last]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.start, offsets)  # words of document d: first[d] .. first[d + 1]
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def fingerprints(self) -> np.ndarray:
        return _between(_prefix(_BYTE_VALUE[self.data], _BASE_BYTE), self.start, self.end, _BASE_BYTE)

    def windows(self, size: int, prints: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words and fingerprints of all windows of `size` words inside one document."""
        at = np.flatnonzero(np.arange(len(self)) + size <= np.repeat(self.first[1:], np.diff(self.first)))
        prefix = _prefix(self.fingerprints() if prints is None else prints, _BASE_WORD)
        return at, _between(prefix, at, at + size, _BASE_WORD)


def sequences(prints: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the word sequences [start, end), given the words' own."""
    return _between(_prefix(prints, _BASE_WORD), start, end, _BASE_WORD)


def byte_windows(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of data[s : s + size] for each s in start."""
    return _between(_prefix(_BYTE_VALUE[data], _BASE_BYTE), start, start + size, _BASE_BYTE)


def dictionary(words: Words) -> tuple[np.ndarray, pa.Array]:
    """Each word's number, equal for equal bytes only, and the distinct words."""
    bounds = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    whole = words.data[np.repeat(words.start - bounds[:-1], np.diff(bounds)) + np.arange(bounds[-1])]
    found = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds), pa.py_buffer(whole)]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def strong(values: pa.Array) -> np.ndarray:
    """Two 64-bit numbers per string, of its 128-bit BLAKE2 digest."""
    raw = b"".join(blake2b(v, digest_size=16).digest() for v in values.cast(pa.large_binary()).to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def hash_strings(values: list[bytes]) -> np.ndarray:
    """The word fingerprints of given words."""
    data = np.frombuffer(b"".join(values), np.uint8)
    ends = np.cumsum([len(v) for v in values], dtype=np.int64) if values else np.zeros(0, np.int64)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if values else ends
    return _between(_prefix(_BYTE_VALUE[data], _BASE_BYTE), starts, ends, _BASE_BYTE)


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def covered(n: int, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Mask over n places of those inside any [s, s + size)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, np.minimum(start + size, n), -1)
    return np.cumsum(delta[:-1]) > 0
