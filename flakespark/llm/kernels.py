"""Vectorised text kernels: word and shingle hashes over concatenated UTF-8 rows."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Multipliers of the words of a shingle, first to fifth.
_WORD_MULTIPLIERS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
_LENGTH = 0x1D8E4E27C47D124F

GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=_U) + _U(77))
_powers = (np.ones(1, _U), np.ones(1, _U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.ones(1, _U)
            while len(t) < size:
                t = np.concatenate([t, t * _U(pow(base, len(t), 1 << 64))])
            tables.append(t)
        _powers = tuple(tables)
    return _powers


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each row's first word (rows + 1)."""
    word = ~GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Bytes whose words are hashed together.
SLICE = 1 << 22
#: What is left of eight bytes by the number of bytes that count.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, wherever they stand; another salt gives independent ones.

    Eight bytes at a time are mixed in, after the length, so no algebraic identity of
    the bytes carries over; long spans go through BLAKE2.
    """
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(size.astype(_U) * _U(_LENGTH) + _U(salt))
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=salt.to_bytes(8, "little")).digest(), "little")
    live, done = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        left = size[live] - done
        out[live] = mix(out[live] ^ (lanes[starts[live] + done] & _LEFT[np.minimum(left, 8)]))
        live, done = live[left > 8], done + 8
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of each row's first word (rows + 1); long rows are worked off in slices that end at gaps."""
    if len(data) <= 2 * SLICE:
        starts, ends, first = word_spans(data, offsets)
        return span_hashes(data, starts, ends), first
    gaps, hashes, begins, at = np.flatnonzero(GAP[data]), [], [], 0
    while at < len(data):
        k = int(np.searchsorted(gaps, at + SLICE))
        end = int(gaps[k]) if k < len(gaps) else len(data)
        inner = offsets[(offsets > at) & (offsets < end)]
        starts, ends, _ = word_spans(data[at:end], np.concatenate([[at], inner, [end]]) - at)
        hashes.append(span_hashes(data[at:end], starts, ends))
        begins.append(starts + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every byte window of a fixed width."""
    power, inverse = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * power[: len(data)], out=prefix[1:])
    count = max(0, len(data) - width + 1)
    return mix((prefix[width : width + count] - prefix[:count]) * inverse[:count])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all width-word windows, row after row, and each row's first window (rows + 1).

    A row with fewer words has one window, its whole sequence; a row without words none.
    """
    counts = np.diff(first)
    windows = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(windows)])
    out = np.zeros(at[-1], _U)
    row = np.repeat(np.arange(len(counts)), windows)
    start = first[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    used = np.minimum(counts, width)[row]
    for k in range(width):
        live = used > k
        if live.all():
            out += words[start + k] * _U(_WORD_MULTIPLIERS[k])
        else:
            out[live] += words[start[live] + k] * _U(_WORD_MULTIPLIERS[k])
    return mix(out + used.astype(_U) * _U(_LENGTH)), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row; A-Z is folded to a-z."""
    words, first = word_hashes(LOWER[data], offsets)
    shingles, at = shingle_hashes(words, first, width)
    return [np.unique(shingles[a:b]) for a, b in zip(at[:-1], at[1:])]


def set_signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One order-free 128-bit signature for each set, as two numbers a row; zeros for the empty set alone."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), 2), _U)
    filled = np.flatnonzero(sizes)
    if len(filled):
        flat, heads = np.concatenate([sets[k] for k in filled]), np.cumsum(sizes[filled]) - sizes[filled]
        for column, salt in enumerate((0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)):
            out[filled, column] = mix(np.add.reduceat(mix(flat ^ _U(salt)), heads) + sizes[filled].astype(_U)) | _U(1)
    return out
