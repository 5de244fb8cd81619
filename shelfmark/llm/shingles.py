"""Sets of hashed word shingles, for batches of texts in numpy.

Words are runs of bytes other than ASCII white space, lower-case for A-Z. A text's set holds
its distinct shingles of k words; a text of fewer words has its whole sequence as the one
shingle; a text without words has the empty set. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# Bytes of text hashed at a time; what a worker needs for it is some sixty times as much.
BATCH_BYTES = 250_000
_SEED = 731
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random value per byte (letters A-Z like a-z), and which bytes are white space."""
    values = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return values, space


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BATCH_BYTES + 65_536)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            _powers[name] = np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, base, np.uint64))), dtype=np.uint64)
    return _powers["up"], _powers["down"]


@lru_cache(maxsize=4)
def _factors(k: int) -> np.ndarray:
    return np.random.default_rng(_SEED + 1).integers(1, 2**63, k, dtype=np.uint64) * _U(2) + _U(1)


def _batches(encoded: list[bytes]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, text in enumerate(encoded):
        if total and total + len(text) > BATCH_BYTES:
            yield start, i
            start, total = i, 0
        total += len(text) + 1
    if start < len(encoded):
        yield start, len(encoded)


def _shingles(encoded: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of some texts in a row, and how many each text has."""
    values, space = _bytes()
    data = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    blank = space[data]
    edge = np.diff(blank.astype(np.int8), prepend=1)
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) > len(begins):  # the text begins with white space
        ends = ends[1:]
    up, down = _power_tables(len(data) + 1)
    upto = np.concatenate(([_U(0)], np.cumsum(values[data] * up[: len(data)], dtype=np.uint64)))
    words = mix((upto[ends] - upto[begins]) * down[begins])

    text_ends = np.cumsum([len(t) + 1 for t in encoded])
    upto_word = np.concatenate(([0], np.searchsorted(begins, text_ends)))
    n_words = np.diff(upto_word)
    factors = _factors(k)
    n_shingles = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    # Where each shingle begins, and how many words it has.
    offset = np.repeat(upto_word[:-1] - (np.cumsum(n_shingles) - n_shingles), n_shingles)
    at = np.arange(int(n_shingles.sum())) + offset
    length = np.repeat(np.minimum(n_words, k), n_shingles)
    total = length.astype(np.uint64)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    for j in range(k):
        total += np.where(j < length, padded[at + j], _U(0)) * factors[j]
    return mix(total), n_shingles


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    for start, end in _batches(encoded):
        flat, sizes = _shingles(encoded[start:end], k)
        at = 0
        for n in sizes:
            part = np.sort(flat[at : at + n])
            at += n
            yield part[np.concatenate(([True], part[1:] != part[:-1]))] if n else part


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a set, independent of order."""
    out = []
    for salt in (0x632BE59BD9B4E019, 0xE95C6B3F0A1D2B77):
        total = mix(tokens + _U(salt)).sum(dtype=np.uint64) if len(tokens) else _U(0)
        out.append(int(mix(np.array([total + _U(len(tokens))], np.uint64)).view(np.int64)[0]))
    return out[0], out[1]
