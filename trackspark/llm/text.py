"""Words of whole texts as 64-bit hashes, computed for a batch of documents at once with numpy.

A text is handled as UTF-8 bytes: a word is a maximal run of bytes that are no separators, its hash a polynomial over
random byte values. Only ASCII letters are lower-cased and only ASCII bytes separate words, so multi-byte characters
stay whole. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of text per slice; a longer document is a slice of its own. Where only hashes or scores leave a slice, smaller ones do.
SLICE, SMALL_SLICE = 1 << 20, 1 << 17
_STEP = 0x9E3779B97F4A7C15
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x + np.uint64((salt * _STEP + _STEP) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = mix(np.arange(256, dtype=np.uint64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each; a waiting worker keeps no more than a power of two."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(int(_BASE), -1, 1 << 64)
        _powers[:] = [
            np.cumprod(np.append(np.ones(1, np.uint64), np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)))
            for base in (int(_BASE), inverse)
        ]
    return _powers[0], _powers[1]


def separators(extra: str = "") -> np.ndarray:
    """Which bytes separate words: white space, and with ``extra='punctuation'`` every ASCII byte but letters and digits."""
    flags = np.zeros(256, bool)
    flags[list(SPACES)] = True
    if extra == "punctuation":
        flags[:128] = [not chr(c).isalnum() for c in range(128)]
    return flags


WHITE = separators()
PLAIN = separators("punctuation")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each text starts (one offset more than texts)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``size`` bytes: first and last document, their bytes, their offsets."""
    raw, at = text_bytes(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(
    raw: np.ndarray, at: np.ndarray, separates: np.ndarray = WHITE, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of lower-cased texts, and how many words came before each text.

    With ``prefixes``, hashes have a column more for the first so many bytes of each longer word, 0 for other words.
    """
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        hashes = np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64)
        return hashes, none, none, np.zeros(len(at), np.int64)
    inside = ~separates[raw]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, inverse = _power_tables(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[LOWER[raw]] * power[:n], out=sums[1:])
    size, back = last - first, inverse[first]
    hashes = mix((sums[last] - sums[first]) * back + size.astype(np.uint64) * np.uint64(_STEP))
    if prefixes:
        starts = [mix((sums[np.minimum(first + k, n)] - sums[first]) * back, k) * (size > k) for k in prefixes]
        hashes = np.stack([hashes, *starts], 1)
    return hashes, first, last, np.searchsorted(first, at)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct ``k``-word shingles of each text; a shorter text is one shingle, a text without words none.

    ``counts`` holds how many words came before each text, as :func:`words` returns it.
    """
    odd = mix(np.arange(1, k + 1, dtype=np.uint64), 7) | np.uint64(1)
    n = len(hashes)
    whole = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k if len(whole) else 0):
        whole += hashes[j : n - k + 1 + j] * odd[j]
    whole = mix(whole)
    out = []
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * odd[: b - a]).sum(dtype=np.uint64)], np.uint64), k - (b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
