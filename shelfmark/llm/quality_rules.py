"""Quality rules by weak supervision. DataFrame functions only.

Rules look at counts of a text and vote that it is good, vote that it is bad, or abstain. Nobody
says how far a rule can be trusted: expectation-maximisation estimates that from all documents.
Its model is that a document is good with some probability, and that a rule which votes is right
with one probability on good documents and with another on bad ones, whatever the other rules
do. Steps run over the distinct vote patterns with their counts, of which there are at most
three to the power of the number of rules (177,147 for these eleven), not over documents. A document's posterior
probability of being good, not whether it passes every rule, decides.

Repeated windows are found inside a row: 64-bit hashes of all windows of eight words, sorted with
their places if any two are equal, give the words they cover. A text never leaves its row.

Cases: a null text has no words; a text without words gets bad votes for its length and for nothing
else. Rules for which a text is too short abstain. Ties at a posterior of exactly one half keep.
Rows that repeat each get theirs, and each count. Very long texts are counted whole. Null
identifiers are passed on. An empty table gives an empty table and the accuracies the method
starts from. Columns with clashing names are kept, the result's is renamed with a leading ``_``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import fresh, text_of
from shelfmark.runtime import materialise

WINDOW = 8  # three doublings
LEAST_WORDS, REPEAT_PERCENT = 20, 30
ROUNDS = 20
# Where the estimate starts: the share of good documents, and how often a vote is right on good and
# on bad ones; and how many documents' votes these beginnings count for, as shares of all
# documents. Bad documents fail few rules each, in ways of their own. The weight on that side keeps
# the class from becoming the one kind that fails most rules at once.
START_GOOD, START_RIGHT_ON_GOOD, START_RIGHT_ON_BAD = 0.85, 0.95, 0.3
WEIGHT_ON_GOOD, WEIGHT_ON_BAD = 0.01, 0.1
GOOD, BAD, ABSTAIN = 1, -1, 0

SPACE = r"\x20\x09-\x0D"
# Frequent short words of four languages (fixed values).
FUNCTION_WORDS = (
    "the of and to in is that it was for on are with as be at by this have from or an not but which you "
    "de la le les et des un une du est que qui dans en pour pas sur au avec ce il elle ne se plus par "
    "der die das und den von zu mit sich auf dem ist nicht ein eine als auch es an werden aus er hat "
    "el los las del por con una su para como al lo sus este ha me si sin sobre muy también"
).split()

# Counts of a text: DataFrame expression over content, words, lines. ASCII white space parts words.
PATTERNS = {
    "n_symbols": r"[#*$%&|<>]",
    "n_capitals": r"\p{Lu}",
    "n_digits": r"[0-9]",
    "n_ends": rf"[.!?](?:[{SPACE}]|\z)",
    # Words that end with a character that words do not end with, or with more than one mark.
    "n_odd_ends": rf"(?:[#*$%&|<>=+/\\@^_~{{}}\[\]]|!!|\?\?)(?:[{SPACE}]|\z)",
}


@dataclass(frozen=True)
class Rule:
    """``good`` and ``bad`` are SQL conditions over the counts, understood alike by Spark and
    DuckDB; a text for which neither holds gets no vote."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 50 AND n_words <= 100000", "n_words < 20 OR n_words > 500000"),
    Rule("word_length", "n_words >= 20 AND word_chars >= 3 * n_words AND word_chars <= 9 * n_words",
         "n_words >= 20 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)"),
    Rule("symbols", "n_words >= 20 AND 50 * n_symbols < n_words", "n_words >= 20 AND 10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines >= 3 AND 20 * n_dup_lines <= n_lines", "n_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("repeated_windows", "n_words >= 20 AND 50 * n_repeat_words <= n_words", "n_words >= 20 AND 5 * n_repeat_words > n_words"),
    Rule("capitals", "word_chars >= 50 AND 100 * n_capitals <= 15 * word_chars", "word_chars >= 50 AND 100 * n_capitals > 40 * word_chars"),
    Rule("function_words", "n_words >= 30 AND n_function_words >= 3", "n_words >= 30 AND n_function_words = 0"),
    Rule("variety", "n_words >= 30 AND n_distinct_words * n_distinct_words >= 9 * n_words",
         "n_words >= 30 AND n_distinct_words * n_distinct_words < 2 * n_words"),
    Rule("sentence_ends", "n_words >= 30 AND 100 * n_ends >= n_words AND 3 * n_ends <= n_words",
         "n_words >= 100 AND n_ends = 0 OR n_words >= 30 AND 2 * n_ends > n_words"),
    Rule("odd_ends", "n_words >= 20 AND 50 * n_odd_ends <= n_words", "n_words >= 20 AND 5 * n_odd_ends > n_words"),
    Rule("digits", "word_chars >= 100 AND 50 * n_digits <= word_chars", "word_chars >= 100 AND 5 * n_digits > word_chars"),
)


@dataclass(frozen=True)
class Model:
    """How many documents are good, and how often each rule's vote is right on good and on bad ones."""

    good: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]

    def log_odds(self, votes: Column) -> Column:
        """Of a document being good, given its votes."""
        table = F.array(*[
            F.struct(F.lit(math.log(g / (1 - b))).alias("up"), F.lit(math.log((1 - g) / b)).alias("down"))
            for g, b in zip(self.right_on_good, self.right_on_bad)
        ])
        weights = F.zip_with(votes, table, lambda v, w: F.when(v == GOOD, w["up"]).when(v == BAD, w["down"]).otherwise(0.0))
        return F.aggregate(weights, F.lit(math.log(self.good / (1 - self.good))), lambda total, w: total + w)

    def posterior(self, votes: Column) -> Column:
        """Probability of a document being good, given its votes."""
        return 1 / (1 + F.exp(-self.log_odds(votes)))


def start(rules: tuple[Rule, ...] = RULES) -> Model:
    return Model(START_GOOD, (START_RIGHT_ON_GOOD,) * len(rules), (START_RIGHT_ON_BAD,) * len(rules))


def _repeat_words(windows: Column, order: Column) -> Column:
    """Words in the windows that are there twice, from hashes of windows sorted with their places."""
    same = lambda a, b: F.coalesce(F.get(order, a)["hash"] == b, F.lit(False))
    again = F.filter(order, lambda e, i: same(i - 1, e["hash"]) | same(i + 1, e["hash"]))
    places = F.sort_array(F.transform(again, lambda e: e["place"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
        lambda c, p: F.struct(p.alias("last"), (c["total"] + F.least(F.lit(WINDOW), p - c["last"])).alias("total")),
        lambda c: c["total"],
    )
    return F.when(order.isNull(), 0).otherwise(covered)


def measure(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "quality") -> DataFrame:
    """``docs`` with a struct of counts and votes, called ``name``."""
    result, content, words, lines, windows, order = fresh(docs, name, "content", "words", "lines", "windows", "order")
    kept = [F.col(c) for c in docs.columns]
    col = F.col
    parted = docs.withColumn(content, text_of(text_col)).withColumn(words, F.array_remove(F.split(col(content), f"[{SPACE}]+"), ""))
    parted = parted.withColumn(lines, F.filter(F.split(col(content), "\n"), lambda l: l.rlike(f"[^{SPACE}]")))
    # Hashes of one, two, four and eight words in a row, each from two of the step before.
    parted = parted.withColumn(windows, F.transform(words, lambda w: F.xxhash64(w)))
    for reach in (1, 2, 4):
        parted = parted.withColumn(windows, F.transform(windows, lambda h, i: F.xxhash64(h, F.get(col(windows), i + reach))))
    n_windows = F.size(words) - (WINDOW - 1)
    parted = parted.withColumn(windows, F.when(n_windows > 0, F.slice(windows, F.lit(1), n_windows)))
    paired = F.transform(col(windows), lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
    parted = parted.withColumn(order, F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(paired)))
    counts = {
        "n_words": F.size(words), "word_chars": F.length(F.array_join(words, "")),
        "n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(col(windows), col(order)),
        "n_distinct_words": F.size(F.array_distinct(words)),
        "n_function_words": F.size(F.array_intersect(col(words), F.array(*map(F.lit, FUNCTION_WORDS)))),
        **{c: F.regexp_count(col(content), F.lit(p)) for c, p in PATTERNS.items()},
    }
    # A row of one element: beyond it no filter or projection repeats the expressions above.
    counted = F.explode(F.array(F.struct(*[c.cast("long").alias(n) for n, c in counts.items()]))).alias(result)
    return parted.select(*kept, counted).withColumn(result, F.col(result).withField("votes", _votes(rules, result)))


def _votes(rules: tuple[Rule, ...], struct: str) -> Column:
    """One vote a rule; the counts are fields of a struct column."""
    field = lambda condition: F.expr(re.sub(r"\b(n_\w+|word_chars)\b", rf"`{struct}`.\1", condition))
    return F.array(*[
        F.when(field(r.bad), BAD).when(field(r.good), GOOD).otherwise(ABSTAIN).cast("tinyint") for r in rules
    ])


def fit(measured: DataFrame, name: str = "quality", rounds: int = ROUNDS) -> Model:
    """Accuracies of the rules, estimated from the votes of all documents."""
    votes = measured.select(F.col(name)["votes"].alias("votes"))
    patterns = materialise(votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "votes")
    # At most 3 ** rules rows: one task without exchanges a round.
    patterns = patterns.coalesce(1)
    n_rules = (patterns.select(F.size("votes")).first() or [len(RULES)])[0]
    model = Model(START_GOOD, (START_RIGHT_ON_GOOD,) * n_rules, (START_RIGHT_ON_BAD,) * n_rules)
    good, bad, vote = F.col("good"), F.col("bad"), F.col("vote")
    sums = {
        "n": F.col("n"), "good": good,
        "right_on_good": F.when(vote == GOOD, good), "voted_on_good": F.when(vote != ABSTAIN, good),
        "right_on_bad": F.when(vote == BAD, bad), "voted_on_bad": F.when(vote != ABSTAIN, bad),
    }
    for _ in range(rounds):
        weighed = patterns.select(
            "n", (F.col("n") * model.posterior(F.col("votes"))).alias("good"), F.posexplode("votes").alias("rule", "vote")
        ).withColumn("bad", F.col("n") - good)
        rows = weighed.groupBy("rule").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(s) for s, c in sums.items()]).orderBy("rule").collect()
        if not rows:
            break
        n = rows[0]["n"]
        rate = lambda right, voted, begin, weight: (right + weight * n * begin) / (voted + weight * n)
        model = Model(
            rate(rows[0]["good"], n, START_GOOD, WEIGHT_ON_GOOD),
            tuple(rate(r["right_on_good"], r["voted_on_good"], START_RIGHT_ON_GOOD, WEIGHT_ON_GOOD) for r in rows),
            tuple(rate(r["right_on_bad"], r["voted_on_bad"], START_RIGHT_ON_BAD, WEIGHT_ON_BAD) for r in rows),
        )
    return model


def judge(measured: DataFrame, model: Model, name: str = "quality") -> DataFrame:
    """``measured`` with posterior, base_failed and kept among the fields of its struct."""
    q = F.col(name)
    failed = (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > REPEAT_PERCENT * q["n_words"])
    known = measured.withColumn(name, q.withField("posterior", model.posterior(q["votes"])).withField("base_failed", failed))
    return known.withColumn(name, q.withField("kept", ~q["base_failed"] & (q["posterior"] >= 0.5)))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that are kept. Texts are read twice, for the accuracies and for the verdict,
    and not moved."""
    name, = fresh(docs, "quality")
    measured = measure(docs, text_col, rules, name)
    return judge(measured, fit(measured, name), name).where(F.col(name)["kept"]).select(*docs.columns)
