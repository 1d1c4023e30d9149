"""Words and word shingles of whole batches of texts as 64-bit hashes, on numpy arrays.

A word's hash is that of its bytes under a polynomial over a random byte table, taken from prefix sums modulo 2**64, so
that no word is ever made a Python object. A-Z are lower-cased; words are runs of other bytes than ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
CHUNK = 400_000
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


LOWER = np.arange(256)
LOWER[65:91] += 32
BYTE = randoms(256, 11)[LOWER] | _U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
_BASE = 0xD6E8FEB86659FD93
_POWERS = {"up": np.ones(1, _U), "down": np.ones(1, _U)}
TURNS = randoms(WIDTH, 23) | _U(1)


def powers(kind: str, n: int) -> np.ndarray:
    """base**k, or its inverse's, for k below n."""
    found = _POWERS[kind]
    if len(found) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        while len(found) < n:
            found = np.concatenate([found, found * _U(pow(base, len(found), 1 << 64))])
        _POWERS[kind] = found
    return found


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and the offsets of its values in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def spans(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of about CHUNK bytes that don't end within a word."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + CHUNK, n)
        if end < n:
            gaps = np.flatnonzero(IS_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < n:
                    gaps = np.flatnonzero(IS_SPACE[data[end : end + CHUNK]])
                    end = min(n, end + (int(gaps[0]) + 1 if len(gaps) else CHUNK))
                    if len(gaps):
                        break
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in turn, and how many words lie before each offset."""
    hashes, begins = [], []
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    for at, end in spans(data):
        part = data[at:end]
        inside = ~IS_SPACE[part]
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        start = np.flatnonzero(inside & (~before | border[at:end]))
        stop = np.flatnonzero(inside & (~after | border[at + 1 : end + 1])) + 1
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(BYTE[part] * powers("up", len(part))[: len(part)], out=sums[1:])
        hashes.append(mix((sums[stop] - sums[start]) * powers("down", len(part))[start] + (stop - start).astype(_U)))
        begins.append(start + at)
    found = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    where = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return found, np.searchsorted(where, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles of five words, sorted; of fewer words, the whole sequence as one."""
    found, bounds = words(data, offsets)
    rows = np.zeros(max(0, len(found) - WIDTH + 1), _U)
    for k in range(WIDTH):
        rows += found[k : k + len(rows)] * TURNS[k]
    rows = mix(rows)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WIDTH:
            x = np.sort(rows[a : b - WIDTH + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            out.append(mix((found[a:b] * TURNS[: b - a]).sum(keepdims=True, dtype=_U) + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out
