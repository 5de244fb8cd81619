"""The default summary reads whole texts: against a plain version, and what it costs."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from shelfmark.operators import BatchModel, KeySentences, summarise
from shelfmark.operators.key_sentences import kept_units


def plain_summary(text, opening="This document ", n=100, longest=40):
    if text is None:
        return None
    units = []
    for sentence in re.split(r"(?<=[.!?])[ \t\r\n]+|\n+", text):
        words = [w for w in re.split("[ \t\n\r\f]+", sentence) if w]
        for i in range(0, max(len(words), 1), longest):
            unit = re.sub("^[# ]+|[# ]+$", "", " ".join(words[i : i + longest]))
            if unit and unit not in units:
                units.append(unit)
    if not units:
        return None
    terms = [{t for t in re.split(r"[\W_]+", u.lower()) if len(t) >= 4} for u in units]
    shared = Counter(t for ts in terms for t in ts)
    score = [
        math.floor(1000 * sum(shared[t] for t in ts if shared[t] >= 2 and 2 * shared[t] <= len(units)) / len(u.split(" ")))
        for u, ts in zip(units, terms)
    ]
    last = len(units) - 1
    kept, total = [], 0
    for i in sorted(range(len(units)), key=lambda i: (i != 0, i != last, -score[i], i)):
        total += len(units[i].split(" "))
        if total > n:
            break
        kept.append(i)
    return opening + " ".join(units[i] for i in sorted(kept))


def random_text(rnd):
    vocabulary = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 7))) for _ in range(60)]
    words = [rnd.choice(vocabulary) + rnd.choice(["", "", "", "", ".", "!", ",", ".\n", "\n", "###\n"]) for _ in range(rnd.choice([0, 1, 30, 99, 300, 900]))]
    return rnd.choice([" ", "  ", " "]).join(words)


def test_against_plain_version(spark):
    rnd = random.Random(4)
    texts = [random_text(rnd) for _ in range(120)] + ["", " \n ", None, "###\n###", "word " * 500, "one. " * 300, "Same line.\n" * 90 + "End here now."]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[7])] * 3
    df = spark.createDataFrame(rows, "id int, text string")
    for n, longest in ((100, 40), (30, 7)):
        done = KeySentences("This document ", n, longest).table(df, "text", "s").collect()
        assert Counter((r["id"], r["text"], r["s"]) for r in done) == Counter((i, t, plain_summary(t, n=n, longest=longest)) for i, t in rows)
        assert all(len(r["s"].split()) <= n + 2 for r in done if r["s"])


def test_the_end_of_a_long_text_reaches_its_summary(spark):
    rnd = random.Random(9)
    filler = [" ".join(rnd.choices([f"word{i}" for i in range(5000)], k=12)).capitalize() + "." for _ in range(20_000)]
    about = [f"The harbour budget was raised in year {i}." for i in range(3)]
    middle = filler[:9000] + about[:1] + filler[9000:15_000] + about[1:2] + filler[15_000:] + about[2:]
    text = " ".join(middle + ["In the end the bridge cost 7731 crowns."])
    summary = summarise(spark.createDataFrame([(text,)], "text string"), "text").first()["summary"]
    assert "the bridge cost 7731 crowns." in summary and filler[0] in summary
    assert len(summary.split()) <= 102


def test_what_many_sentences_share_is_taken(spark):
    rnd = random.Random(2)
    odd = [" ".join(f"x{rnd.randrange(10**6)}yz" for _ in range(8)) + "." for _ in range(200)]
    key = [f"Pump number {i} feeds the northern reservoir." for i in range(20)]
    text = " ".join(odd[:150] + key + odd[150:])
    summary = summarise(spark.createDataFrame([(text,)], "text string"), "text").first()["summary"]
    assert summary.count("northern reservoir") >= 10 and odd[0] in summary and odd[-1] in summary


def test_one_exchange_of_texts(spark):
    text = F.concat_ws(" ", F.lit("Some words here."), "id")
    df = spark.range(1000).select(F.sha2(text, 256).alias("id"), text.alias("text"))
    texts = df.groupBy("id").agg(F.first("text").alias("text"))
    plan = kept_units(texts, "id", "text", 100, 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_copies_are_summarised_once(spark):
    """A third of the rows have one text; rows without a text keep none."""
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.repeat(F.lit("A copied sentence. And more of it, part by part. "), 30))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("Row "), F.col("id").cast("string"))).alias("text"),
    )
    done = {r["id"]: r["summary"] for r in summarise(rows, "text").collect()}
    assert len(done) == 3000 and done[2] is None and done[1] == "This document Row 1"
    assert {done[i] for i in range(0, 3000, 3)} == {"This document A copied sentence. And more of it, part by part."}


def test_behind_a_model_that_fails(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import uuid

        def model(batch):
            with open(f"{folder}/{uuid.uuid4().hex}.log", "w") as log:
                log.write("x" * len(batch))
            return [None if t.startswith("bad") else t.upper() for t in batch]

        return model

    df = spark.createDataFrame([(1, "good one"), (2, "bad one"), (3, None), (4, "bad two")], "id int, text string")
    done = summarise(df, "text", [BatchModel(load), KeySentences("S: ")], message="none").collect()
    assert {r["id"]: r["summary"] for r in done} == {1: "GOOD ONE", 2: "S: bad one", 3: "none", 4: "S: bad two"}
    assert sum(len(p.read_text()) for p in tmp_path.glob("*.log")) == 3


def test_summaries_are_filtered_again_and_again(spark):
    """A filter on a summary is not moved below the function that makes it; every run in a session gives the same."""
    from shelfmark.operators import nonempty_summaries

    for _ in range(3):
        texts = spark.createDataFrame([(1, "A b. C d.", "x"), (2, "E f.", "y"), (3, None, "x")], "id int, text string, kind string")
        done = summarise(texts.repartition(2, "id"), "text").withColumn("summary", F.when(F.col("kind") != "y", F.col("summary")))
        assert [r["id"] for r in nonempty_summaries(done).select("id", "summary").collect()] == [1]
