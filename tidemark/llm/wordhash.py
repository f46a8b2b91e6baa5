"""Hashes of all words of a batch of texts at once, in NumPy."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.RandomState(20240229)
#: Odd multipliers, one for each position in a word.
_PLACES = _RANDOM.randint(0, 1 << 62, 4096, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_U = np.uint64


def separators(alphanumeric: bool) -> np.ndarray:
    """Bytes between words: ASCII white space and control, or every ASCII byte that is no letter or digit."""
    is_sep = np.zeros(256, bool)
    is_sep[:33] = True
    if alphanumeric:
        is_sep[[b for b in range(128) if not chr(b).isalnum()]] = True
    return is_sep


SPACES, SIGNS = separators(False), separators(True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def spans(texts: list[str], is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes in a row, and of each word its first byte, its length and its text's number."""
    encoded = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    edge = np.diff(is_sep[data].astype(np.int8), prepend=1)
    first = np.flatnonzero(edge == -1)
    length = np.flatnonzero(edge == 1)[-len(first) :] - first if len(first) else first
    ends = np.cumsum([len(e) + 1 for e in encoded])
    return data, first, length, np.searchsorted(ends, first, "right")


def hash_spans(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    if not len(first):
        return np.zeros(0, np.uint64)
    before = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(before, length)
    values = (data[place + np.repeat(first, length)].astype(np.uint64) + _U(1)) * _PLACES[place & 4095]
    return mix(np.add.reduceat(values, before) + length.astype(np.uint64))


def words(texts: list[str], is_sep: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, lower-cased, in order."""
    data, first, length, of = spans([t.lower() for t in texts], is_sep)
    return hash_spans(data, first, length), of


def distinct(of: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, item and count of the distinct items of each text, in order of text and item."""
    if not len(items):
        return of, items, np.zeros(0, np.int64)
    order = np.lexsort((items, of))
    of, items = of[order], items[order]
    new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (items[1:] != items[:-1]))))
    return of[new], items[new], np.diff(np.append(new, len(items)))
