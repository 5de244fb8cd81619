"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at
least ``LEAST_LENGTH`` words and ``LEAST_EXPONENT`` periods long, that no neighbouring word
extends. Collapsing a text keeps the first period of each run.

Periods below ``SHORT`` are too short for minimizers and are scanned for directly, one lag at a
time. At the scale of width w, for periods q from w to 2w - 1, a word's value is a hash of the block of
2w words that begins with it, and every window of w values gives its minimum. Inside a run the
windows repeat at distance q, so minima do too: a run of four periods is long enough for a window
whose block, and that block one period on, lie in it. Equal blocks cannot be closer than q there
(two periods on a block of q words or more make a smaller one), so these two are neighbours
among equal minima. Such pairs at a distance of the scale seed an interval in which words q apart
are equal; hashes of prefixes extend it both ways, and the words themselves verify it. Where they
refute it the lag is scanned directly. A stretch found with several periods counts with the smallest.

Scales double up to a quarter of a text, so the work is n log n, however long the runs are.

Cases: null and empty texts, and those of white space, have no words and no runs, and collapse to
the empty text. Rows that repeat each get theirs. Very long texts are worked on alone in their
task, short ones together; both are whole. Null identifiers are passed on. An empty table gives
an empty table. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, map_batches, slices_by_size, text_of
from shelfmark.llm.shingles import mix

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
SHORT = 8
BATCH_CHARS = 2_000_000
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_U = np.uint64
_find_words = re.compile(WORD).findall


def least_length(period: int | np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)


def lag_runs(ids: np.ndarray, period: int) -> np.ndarray:
    """(start, length, period) of the stretches in which ``ids`` a period apart are equal."""
    same = np.zeros(max(len(ids) - period, 0) + 2, np.int8)
    same[1:-1] = ids[:-period] == ids[period:]
    edges = np.diff(same)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    length = end - start + period
    long = length >= least_length(period)
    return np.column_stack((start[long], length[long], np.full(long.sum(), period)))


def sliding(best: np.ufunc, values: np.ndarray, width: int, neutral: int) -> np.ndarray:
    """The best of every window of ``width`` values, from running bests inside blocks."""
    padded = np.full(-(-len(values) // width) * width, neutral, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    upto = best.accumulate(blocks, axis=1).ravel()
    onward = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return best(onward[:n], upto[width - 1 : width - 1 + n])


class PrefixHashes:
    """Hashes of any stretch of ``ids`` from hashes of its prefixes."""

    def __init__(self, ids: np.ndarray):
        n = len(ids) + 1
        up = np.cumprod(np.concatenate(([_U(1)], np.full(n - 1, _BASE, _U))), dtype=_U)
        self.down = np.cumprod(np.concatenate(([_U(1)], np.full(n - 1, pow(_BASE, -1, 2**64), _U))), dtype=_U)
        values = mix(ids.astype(_U) + _U(0x5851F42D4C957F2D))
        self.upto = np.concatenate(([_U(0)], np.cumsum(values * up[:-1], dtype=_U)))

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.upto[end] - self.upto[start]) * self.down[start]

    def blocks(self, length: int) -> np.ndarray:
        """Of all stretches of one length."""
        return mix((self.upto[length:] - self.upto[:-length]) * self.down[:-length])

    def agreeing(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How far the ids from (or before) places a agree with those from (or before) b, a < b."""
        room = len(self.upto) - 1 - b if forward else a
        reach = np.zeros(len(a), np.int64)
        step = 1 << int(room.max(initial=0)).bit_length()
        while step:
            more = reach + step
            tried = np.flatnonzero(more <= room)
            x, y, m = a[tried], b[tried], more[tried]
            if forward:
                same = self.stretch(x, x + m) == self.stretch(y, y + m)
            else:
                same = self.stretch(x - m, x) == self.stretch(y - m, y)
            reach[tried[same]] = m[same]
            step >>= 1
        return reach


def seeds(hashes: PrefixHashes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period): intervals whose ids a period later are equal, for periods of the scale."""
    nothing = (np.zeros(0, np.int64),) * 3
    block = 2 * width
    if len(hashes.upto) <= block + width:
        return nothing
    values = hashes.blocks(block)
    minima = sliding(np.minimum, values, width, 2**64 - 1)
    around = np.zeros(len(minima) + 2 * (width - 1), _U)
    around[width - 1 : width - 1 + len(minima)] = minima
    # The minimum of a window that has it.
    at = np.flatnonzero(values == sliding(np.maximum, around, width, 0))
    order = np.argsort(values[at], kind="stable")
    place, value = at[order], values[at][order]
    apart = np.diff(place)
    pair = np.flatnonzero((value[1:] == value[:-1]) & (apart >= width) & (apart < block))
    if not len(pair):
        return nothing
    begin, period = place[pair], apart[pair]
    order = np.lexsort((begin, period))
    begin, period = begin[order], period[order]
    # Pairs of one period whose blocks touch are one interval.
    new = np.ones(len(begin), bool)
    new[1:] = (period[1:] != period[:-1]) | (begin[1:] > begin[:-1] + block)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    return begin[first], begin[last] + block, period[first]


def scale_runs(ids: np.ndarray, hashes: PrefixHashes, width: int) -> np.ndarray:
    """(start, length, period) of the runs with periods of the scale, and some with multiples."""
    begin, end, period = seeds(hashes, width)
    if not len(begin):
        return np.zeros((0, 3), np.int64)
    begin = begin - hashes.agreeing(begin, begin + period, forward=False)
    end = end + hashes.agreeing(end, end + period, forward=True)
    length = end - begin + period
    found = np.unique(np.column_stack((begin, length, period))[length >= least_length(period)], axis=0)
    good, refuted = np.ones(len(found), bool), set()
    for i, (s, n, q) in enumerate(found.tolist()):
        e = s + n
        bounded = (s == 0 or ids[s - 1] != ids[s - 1 + q]) and (e == len(ids) or ids[e] != ids[e - q])
        if not (bounded and np.array_equal(ids[s : e - q], ids[s + q : e])):
            good[i] = False
            refuted.add(q)
    return np.concatenate([found[good], *(lag_runs(ids, q) for q in sorted(refuted))])


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """(start, length, period) of the runs of each sequence of word numbers, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    numbers = int(max((t.max(initial=0) for t in texts), default=0)) + 1

    def joined(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some texts in a row, each followed by a number of its own, and where each starts."""
        ids = np.concatenate([p for i in chosen for p in (texts[i], np.array([numbers + i], np.int64))])
        return ids, np.cumsum(sizes[chosen] + 1) - sizes[chosen] - 1

    found = []

    def keep(runs: np.ndarray, chosen: np.ndarray, begins: np.ndarray) -> None:
        """Notes runs at the places that their words have with all texts in a row."""
        text = np.searchsorted(begins, runs[:, 0], side="right") - 1
        runs[:, 0] += starts[chosen[text]] - begins[text]
        found.append(runs)

    chosen = np.flatnonzero(sizes >= LEAST_LENGTH)
    if not len(chosen):
        return [np.zeros((0, 3), np.int64) for _ in texts]
    ids, begins = joined(chosen)
    for period in range(1, min(SHORT, int(sizes.max()) // LEAST_EXPONENT + 1)):
        keep(lag_runs(ids, period), chosen, begins)
    width, hashes = SHORT, None
    while LEAST_EXPONENT * width <= sizes.max():
        long = np.flatnonzero(sizes >= LEAST_EXPONENT * width)
        if hashes is None or len(long) < len(chosen):
            chosen = long
            ids, begins = joined(chosen)
            hashes = PrefixHashes(ids)
        keep(scale_runs(ids, hashes, width), chosen, begins)
        width *= 2
    runs = np.concatenate(found)
    # By place and length the smallest period counts.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    text = np.searchsorted(starts, runs[:, 0], side="right") - 1
    runs[:, 0] -= starts[text]
    return np.split(runs, np.searchsorted(text, np.arange(1, len(texts))))


def collapse(words: list[str], runs: np.ndarray) -> str:
    """The words that are in the first period of every run that has them, joined by blanks."""
    if not len(runs):
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length and period in words, by start,
    then period), collapsed (its words without the later periods of runs, joined by blanks)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("content"))

    def make():
        def step(batch):
            texts = batch.column("content").to_pylist()
            for start, end in slices_by_size(texts, BATCH_CHARS):
                numbers: dict[str, int] = {}
                words = [_find_words(t) for t in texts[start:end]]
                ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int64, len(ws)) for ws in words]
                found = runs_of(ids)
                flat = np.concatenate(found)
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in found])))
                values = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "length", "period"])
                yield {
                    "doc_id": batch.column("doc_id").slice(start, end - start), "n_words": [len(w) for w in words],
                    "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                    "collapsed": [collapse(w, r) for w, r in zip(words, found)],
                }

        return step

    return map_batches(
        rows, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string", make
    )
