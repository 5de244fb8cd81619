"""The default summary: the sentences of a whole text that say most of what it is about.

A text is read as units: its sentences, in stretches of at most ``longest`` words, each different
one once. The first and the last unit are taken, then those whose words most other units share,
until the budget of words is used; they are given in text order. A short text is its own summary.

Words of four characters and more count, by the number of units that have them, unless they are in
one unit only or in more than half of them. Scores are whole numbers, ties go to the earlier unit.

A text is read where it lies: no text is moved, sorted or joined, and a word is never a row. Units and
the letters and digits of their words are Spark expressions on the row of the text; counts, scores and
ranks are made for many texts at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import DOCUMENT_OPENING, WORD_GAP, sentences

LEAST_LETTERS = 4
# Words that a Python worker counts at once, at most about; a text is not cut.
TERMS_AT_ONCE = 500_000
TERM_GAP = "[^\\p{L}\\p{N}\n]+"


def units(text: Column, longest: int) -> Column:
    """The different stretches of up to ``longest`` words that the sentences of a text have."""

    def stretches(sentence: Column) -> Column:
        found = F.split(sentence, " ")
        starts = F.sequence(F.lit(1), F.size(found), F.lit(longest))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, F.lit(longest)), " "))

    # Words with single blanks between them; few sentences are too long for one unit.
    bare = F.transform(sentences(text), lambda s: F.trim(F.regexp_replace(s, WORD_GAP, " ")))
    cut = F.flatten(F.transform(bare, lambda s: F.when(n_words(s) > longest, stretches(s)).otherwise(F.array(s))))
    # Heading marks and the separators of a folder's summaries say nothing.
    unmarked = lambda u: F.when(F.contains(u, F.lit("#")), F.regexp_replace(u, "^[# ]+|[# ]+$", "")).otherwise(u)
    return F.array_distinct(F.filter(F.transform(cut, unmarked), lambda u: u != ""))


def n_words(unit: Column) -> Column:
    """Words of a text that has single blanks."""
    return F.length(unit) - F.length(F.replace(unit, F.lit(" "), F.lit(""))) + 1


def _places(n: int):
    """For each text the places of its kept units, from their letters and digits, a line for each
    unit, and their sizes."""

    def kept(lines: pa.Array, sizes: pa.ListArray) -> pa.ListArray:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lengths = lambda lists: lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = lengths(sizes)
        total, ends = int(counts.sum()), np.cumsum(counts)
        text = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(total) - np.repeat(ends - counts, counts)
        # A text without units has no line.
        words = pc.split_pattern(pc.split_pattern(lines.filter(pa.array(counts > 0)), "\n").flatten(), " ")
        unit, found = np.repeat(np.arange(total), lengths(words)), words.flatten()
        is_term = pc.greater_equal(pc.utf8_length(found), LEAST_LETTERS)
        unit, found = unit[is_term.to_numpy(zero_copy_only=False)], found.filter(is_term).dictionary_encode()
        n_terms = max(len(found.dictionary), 1)
        # By text, term and unit, in one sort; a term counts once in a unit.
        most = int(counts.max(initial=1))
        keys = (text[unit] * n_terms + found.indices.to_numpy(zero_copy_only=False)) * most + place[unit]
        keys.sort()
        pair, at = np.divmod(keys[np.diff(keys, prepend=-1) > 0], most)
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        shared = np.diff(starts, append=len(pair))
        weight, unit = np.repeat(shared, shared), (ends - counts)[pair // n_terms] + at
        weight = np.where((weight >= 2) & (2 * weight <= counts[text[unit]]), weight, 0)
        size = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        score = np.floor(1000 * np.bincount(unit, weight, total) / size)
        rank = np.where(place == 0, -np.inf, np.where(place == counts[text] - 1, -np.finfo(float).max, -score))
        order = np.lexsort((rank, text))  # stable: ties go by place
        upto = np.cumsum(size[order])
        before = np.concatenate([[0], upto])[ends - counts]
        taken = np.sort(order[upto - before[text] <= n])
        offsets = np.searchsorted(text[taken], np.arange(len(counts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[taken].astype(np.int32)))

    def run(lines: pa.Array, sizes: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        words = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
        share = words[sizes.offsets.to_numpy()[:-1] - sizes.offsets[0].as_py()] // TERMS_AT_ONCE
        starts = [*np.flatnonzero(np.diff(share, prepend=-1)), len(sizes)]
        done = [kept(lines[a:b], sizes[a:b]) for a, b in zip(starts, starts[1:])]
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    run.__annotations__ = {"lines": pa.Array, "sizes": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>").asNondeterministic()


def _with_kept(texts: DataFrame, text: str, n: int, longest: int) -> DataFrame:
    """``texts`` with _units and _kept: the units of each text, and places of those that make the summary."""
    rows = texts.withColumn("_units", F.coalesce(units(F.col(text), longest), F.array().cast("array<string>")))
    lines = F.regexp_replace(F.lower(F.array_join("_units", "\n")), TERM_GAP, " ")
    return rows.withColumn("_kept", _places(n)(lines, F.transform("_units", n_words)))


def kept_units(texts: DataFrame, key: str, text: str, n: int, longest: int) -> DataFrame:
    """(key, kept): places of the units that make the summary, for texts with a key of their own."""
    return _with_kept(texts.select(key, text), text, n, longest).select(key, "_kept")


@dataclass(frozen=True)
class KeySentences:
    """A provider: the opening phrase and the key sentences of the whole text, ``n`` words at most.

    Null where a text is null or has no word.
    """

    opening: str = DOCUMENT_OPENING
    n: int = 100
    longest: int = 40

    def table(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """``df`` with a summary for the text of each row, made where the row lies."""
        chosen = F.array_join(F.transform("_kept", lambda i: F.get("_units", i)), " ")
        summary = F.when(F.size("_kept") > 0, F.concat(F.lit(self.opening), chosen))
        return _with_kept(df, text, self.n, self.longest).withColumn(out, summary).drop("_units", "_kept")
