"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D. All functions
work on whole texts; long texts are hashed piece by piece (cut at white space),
so memory is bounded by the pieces and by eight bytes per word.

A word is read as little-endian numbers of eight bytes. Each is mixed with its place
in the word by a bijection before they are summed, so words of up to eight bytes and
equal length never collide, and no pattern in a long word cancels out as it may in a
polynomial modulo 2**64. Two lanes with constants of their own are independent of each
other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64
#: For each lane: added by place, by length, and to the sum.
_LANES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D), (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0x5851F42D4C957F2D))
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (a bijection of 64-bit integers)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size - 1, b, np.uint64)])) for b in (base, inverse))
        if size <= 4 * PIECE:
            _powers[base] = have
    return have


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, bytes, is null) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    null = np.asarray(column.is_null(), dtype=bool) if column.null_count else np.zeros(n, bool)
    _, where, data = column.buffers()
    if not n or where is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8), null
    offsets = np.frombuffer(where, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # null slots may hold bytes
        lengths = np.diff(offsets)
        if lengths[null].any():
            return flat(column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""))[:2] + (null,)
    return offsets, body, null


def _hash_piece(buf: np.ndarray, cuts: np.ndarray, lower: bool, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (a row for each lane) and starts of the words of buf, which are also cut at cuts."""
    if lower:
        buf = _LOWER[buf]
    n = len(buf)
    inner = ~_SPACE[buf]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    last = inner.copy()
    last[:-1] &= ~inner[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inner[cuts]
    last[cuts - 1] = inner[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hash_words(buf, starts, ends - starts, lanes), starts


def _hash_words(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lanes: int) -> np.ndarray:
    """A row of hashes for each lane of the words of buf."""
    if not len(starts):
        return np.zeros((lanes, 0), np.uint64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    many = (sizes + 7) >> 3
    out = np.empty((lanes, len(starts)), np.uint64)
    if many.max() == 1:
        x = eights[starts].view(_U).ravel() & _TAIL[sizes]
        for k, (place, length, last) in enumerate(_LANES[:lanes]):
            out[k] = mix(mix(x ^ _U(place)) + sizes.astype(np.uint64) * _U(length) + _U(last))
        return out
    first = np.concatenate([[0], np.cumsum(many)[:-1]])
    nth = np.arange(int(many.sum())) - np.repeat(first, many)
    x = eights[np.repeat(starts, many) + 8 * nth].view(_U).ravel()
    x &= _TAIL[np.minimum(np.repeat(sizes, many) - 8 * nth, 8)]
    nth = nth.astype(np.uint64)
    for k, (place, length, last) in enumerate(_LANES[:lanes]):
        # the place goes through the bijection, too, so equal numbers at two places do not swap unseen
        total = np.add.reduceat(mix(x ^ mix(nth * _U(length)) ^ _U(place)), first)
        out[k] = mix(total + sizes.astype(np.uint64) * _U(length) + _U(last))
    return out


def word_groups(offsets: np.ndarray, body: np.ndarray, lower: bool = False, piece: int = PIECE, lanes: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, word hashes, word offsets) for runs of texts of about piece bytes; several lanes make a row of hashes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + piece, "right")) - 1
        j = min(max(j, i + 1), n)
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= piece:
            rel = offsets[i : j + 1] - a
            h, starts = _hash_piece(body[a:b], rel, lower, lanes) if b > a else (np.zeros((lanes, 0), np.uint64), np.zeros(0, np.int64))
            yield i, j, h if lanes > 1 else h[0], np.searchsorted(starts, rel)
        else:  # one long text, cut at white space
            parts = []
            while a < b:
                e = min(a + piece, b)
                while e < b and not _SPACE[body[e]]:
                    more = np.flatnonzero(_SPACE[body[e : min(e + piece, b)]])
                    e = e + int(more[0]) if len(more) else min(e + piece, b)
                parts.append(_hash_piece(body[a:e], np.zeros(0, np.int64), lower, lanes)[0])
                a = e
            h = np.concatenate(parts, axis=1)
            yield i, j, h if lanes > 1 else h[0], np.array([0, h.shape[1]])
        i = j


def window_hashes(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each n consecutive values of h (no regard to text bounds)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def window_starts(where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, text) of each window of n words inside one text."""
    counts = np.maximum(np.diff(where) - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    shift = np.repeat(where[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(len(text)) + shift, text


def _shingles(h: np.ndarray, where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all n-word shingles of each text, short texts at the end."""
    at, text = window_starts(where, n)
    keys = window_hashes(h, n, 0xA24BAED4963EE407 | 1)[at]
    words = np.diff(where)
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        whole = [mix(window_hashes(h[where[i] : where[i + 1]], int(words[i]), 0x9FB21C651E98DF25 | 1) + _U(int(words[i])))[0] for i in short]
        keys, text = np.concatenate([keys, np.array(whole, np.uint64)]), np.concatenate([text, short])
    return keys, text


def shingle_sets(h: np.ndarray, where: np.ndarray, n: int, other: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(hash, text) of the distinct n-word shingles of each text, by text and hash.

    A text with fewer words has its whole sequence as its only shingle; one
    without words has none. With the words' hashes of another lane in other, the
    shingles' hashes of that lane come third, and distinctness is by both.
    """
    keys, text = _shingles(h, where, n)
    more = () if other is None else (_shingles(other, where, n)[0],)
    order = np.lexsort((*more, keys, text))
    keys, text = keys[order], text[order]
    more = tuple(m[order] for m in more)
    if len(keys):
        new = np.ones(len(keys), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (keys, text, *more)])
        keys, text, more = keys[new], text[new], tuple(m[new] for m in more)
    return keys, text, *more
