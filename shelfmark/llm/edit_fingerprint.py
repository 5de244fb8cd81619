"""Document fingerprints from a randomised edit embedding.

A random walk shared by all texts reads a text's characters in order and stays on each for a
random time that depends on the character and the clock. The sequence of (time, character) is
an embedding in which a few edits change few places: after an edit two walks fall into step
again. A fingerprint is a sample of that sequence at ``SLOTS`` times. Each slot's time is the
one with the smallest shared random rank before the walk's end, so texts of nearly the same
length are sampled at nearly the same times. Each sample is one byte: a hash of the
character there and the three after it.

Likeness is the share of equal slots. Bands of slots find candidates (``near_documents``), the
whole fingerprint verifies them.

A walk starts anew every ``BLOCK`` characters, at twice the character's place on the clock, so
that many walks advance together in numpy whatever the lengths of the texts.

Cases: a null text is the empty text; the fingerprint of an empty text is all zeros, so empty
texts are alike among themselves. Equal texts have equal fingerprints. Rows that repeat each
get theirs. Documents are ordered by identifier descending, nulls last, ties by text. An empty
table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches, text_of
from shelfmark.runtime import materialise

SLOTS = 128
BANDS = 32  # of four slots each
BLOCK = 16_384
CLOCK = 4096  # the walk's random bits repeat after this many ticks
CLASSES = 64  # characters are told apart by the walk up to this many classes
BATCH_CHARS = 3_000_000
MAX_TIME = 1 << 40
RANGES_PER_TASK = 4
BLOCK_MEMBERS = 4096  # members of a bucket that are compared with each other at a time, about
SEED = 20_240_607


@lru_cache(maxsize=1)
def _dwell() -> np.ndarray:
    """(CLASSES * CLOCK) ticks that the walk stays on a character of a class at a time."""
    bits = np.random.default_rng(SEED).random((CLASSES, CLOCK)) < 0.5
    bits[:, -1] = True  # a walk waits for the end of a round at most
    at = np.where(bits, np.arange(CLOCK), CLOCK)
    following = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
    return (following - np.arange(CLOCK) + 1).astype(np.int32).ravel()


@lru_cache(maxsize=1)
def _record_times() -> list[np.ndarray]:
    """For each slot the times at which a new smallest rank appears, up to ``MAX_TIME``.

    The next record after time t comes at about t / U for uniform U: such a sequence is
    that of the records of independent ranks.
    """
    rng = np.random.default_rng(SEED + 1)
    out = []
    for _ in range(SLOTS):
        t, times = 0, []
        while t < MAX_TIME:
            times.append(t)
            t = int((t + 1) / max(rng.random(), 1e-9)) if t else int(1 / max(rng.random(), 1e-9))
        out.append(np.array(times, np.int64))
    return out


def _walk(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The time at the end of each character, for walks over ``codes[start : start + length]``.

    Walks are sorted by length, longest first; time counts from 0 in each.
    """
    dwell, tile = _dwell(), 64
    classes = ((codes * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int32)
    classes *= CLOCK
    ends = np.zeros(len(codes), np.int32)
    now = np.zeros(len(starts), np.int32)
    steps = np.arange(tile)[:, None]
    for t in range(0, int(lengths[0]), tile):
        alive = int(np.searchsorted(-lengths, -t, side="left"))
        whole = int(np.searchsorted(-lengths, -(t + tile), side="right"))
        # Characters of a tile, one row per step; reads past a text's end are not used.
        index = starts[:alive] + (t + steps)
        if whole < alive:
            np.minimum(index, len(codes) - 1, out=index)
        rows = classes.take(index)
        times = np.empty((tile, alive), np.int32)
        clock, slot = now[:alive], np.empty(alive, np.int32)
        for i in range(min(tile, int(lengths[0]) - t)):
            np.bitwise_and(clock, CLOCK - 1, out=slot)
            slot += rows[i]
            np.add(clock, dwell.take(slot), out=times[i])
            clock = times[i]
        now[:alive] = clock
        ends[index[:, :whole]] = times[:, :whole]
        if whole < alive:
            used = t + steps < lengths[whole:alive]
            ends[index[:, whole:][used]] = times[:, whole:][used]
    return ends


def fingerprint_texts(texts: list[str]) -> np.ndarray:
    """(len(texts), SLOTS) bytes."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return out
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = sizes[rows]
    after = np.cumsum(sizes)
    # Walks: the blocks of all texts.
    n_blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(rows)), n_blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    starts = (after - sizes)[owner] + nth * BLOCK
    lengths = np.minimum(sizes[owner] - nth * BLOCK, BLOCK)
    order = np.argsort(-lengths, kind="stable")
    ends = _walk(codes, starts[order], lengths[order])
    # One clock for a text: its blocks start at twice the place of their first character. A walk
    # that takes longer is cut there, one that takes less rests on its last character. And one
    # ascending key for all texts, so that one search finds the sampled characters.
    ticks = 2 * BLOCK
    base = (np.cumsum(n_blocks) - n_blocks) * ticks
    key = np.minimum(ends, ticks) + np.repeat(base[owner] + nth * ticks, lengths)
    finish = key[after - 1] - base

    found = np.empty((SLOTS, len(rows)), np.int64)
    for slot, times in enumerate(_record_times()):
        found[slot] = base + times[np.searchsorted(times, finish, side="left") - 1]
    found = np.minimum(np.searchsorted(key, found.T.ravel(), side="right").reshape(-1, SLOTS), (after - 1)[:, None])

    # The sampled character and the three after it; past a text's end there is nothing.
    gram = np.zeros(found.shape, np.uint64)
    for k, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        at = found + k
        inside = at < after[:, None]
        letter = codes.take(np.minimum(at, len(codes) - 1)).astype(np.uint64) + np.uint64(1)
        gram += np.where(inside, letter, np.uint64(0)) * np.uint64(factor)
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    out[rows] = (gram >> np.uint64(56)).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _batches(texts: list[str], limit: int) -> Iterator[slice]:
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total > limit:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex string)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("content"))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def step(batch):
            texts, hexes = batch.column("content").to_pylist(), []
            for part in _batches(texts, BATCH_CHARS):
                hexes += [bytes(f).hex() for f in fingerprint_texts(texts[part])]
            return {"doc_id": batch.column("doc_id"), "fingerprint": hexes}

        return step

    return map_batches(rows, f"doc_id {kind}, fingerprint string", make)


def near_documents(prints: DataFrame, least: float = 0.8, bands: int = BANDS, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """(doc_id, leader, likeness, fingerprint, leader_fingerprint): links between distinct
    fingerprints that share a band and reach ``least`` likeness. The leader is the smaller one, by
    identifier, nulls last, then by fingerprint.

    Any two fingerprints that share a band and reach ``least`` are connected by links, though not
    always by one of their own: a bucket's members are linked with its leader, the smallest. Members
    not like their leader are compared exactly with the bucket's other members, in pairs of blocks
    inside tasks, which link what is not connected there yet. So the rows grow with the members
    of a bucket, not with its pairs; the comparisons grow with the pairs of such members.

    Equal fingerprints are one candidate, with the smallest identifier; one that has only null
    identifiers keeps null.
    """
    width = 2 * SLOTS // bands
    ids = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    ids = materialise(ids.select(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "fingerprint").alias("m")), "prints")
    bits = ids.select("m", F.posexplode(F.array(*[
        F.substring("m.fingerprint", 1 + i * width, width) for i in range(bands)
    ])).alias("band", "bits"))
    leaders = bits.groupBy("band", "bits").agg(F.min("m").alias("l"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = bits.join(leaders, ["band", "bits"]).where("m <> l")
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: (
        F.substring(F.col("m.fingerprint"), 2 * i + 1, F.lit(2)) == F.substring(F.col("l.fingerprint"), 2 * i + 1, F.lit(2))
    )))
    compared = materialise(met.select("m", "l").distinct().withColumn("likeness", same / SLOTS), "compared")

    # Buckets with a member unlike the leader, and all their members but the leader.
    odd = compared.select(
        F.col("m.fingerprint").alias("f"), F.col("l.fingerprint").alias("lf"), (F.col("likeness") < least).alias("odd")
    )
    marked = met.join(odd, (F.col("m.fingerprint") == F.col("f")) & (F.col("l.fingerprint") == F.col("lf")))
    marked = materialise(marked.select("band", "bits", "n", "odd", "m"), "marked")
    open_buckets = marked.where("n > 2").groupBy("band", "bits").agg(F.count_if("odd").alias("n_odd")).where("n_odd > 0").select("band", "bits")
    blocks = F.ceil(F.col("n") / block_members)
    # A member of block i goes to every pair of blocks that has i.
    dealt = marked.join(open_buckets, ["band", "bits"]).withColumn("block", F.pmod(F.xxhash64("m.fingerprint"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    ).select("band", "bits", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "odd", "m")
    rows = dealt.repartition("band", "bits", "i", "j").sortWithinPartitions("band", "bits", "i", "j", "m").select(
        "band", "bits", "i", "j", "block", "odd", "m.doc_id", "m.fingerprint"
    )
    kind = prints.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leader {kind}, likeness double, fingerprint string, leader_fingerprint string"

    def run(batches):
        import pyarrow as pa

        held, key = [], None

        def settle():
            table = pa.Table.from_batches(held).combine_chunks()
            names, idents = table.column("fingerprint"), table.column("doc_id")
            slots = np.frombuffer(bytes.fromhex("".join(names.to_pylist())), np.uint8).reshape(-1, SLOTS)
            odd, block = (table.column(c).to_numpy() for c in ("odd", "block"))
            found = unconnected_links(slots, odd, block if key[2] != key[3] else None, least)
            if found:
                x, y, alike = zip(*found)
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (
                    idents.take(y), idents.take(x), pa.array(alike, pa.float64()), names.take(y), names.take(x)
                )], names=["doc_id", "leader", "likeness", "fingerprint", "leader_fingerprint"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4))))
            begin = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[begin]:
                    continue
                if held and keys[begin] != key:
                    yield from settle()
                    held.clear()
                key = keys[begin]
                held.append(batch.slice(begin, end - begin))
                begin = end
        if held:
            yield from settle()

    led = compared.where(F.col("likeness") >= least).select(
        "m.doc_id", F.col("l.doc_id").alias("leader"), "likeness", "m.fingerprint", F.col("l.fingerprint").alias("leader_fingerprint")
    )
    return led.unionByName(rows.mapInArrow(run, schema)).distinct()


def unconnected_links(slots: np.ndarray, odd: np.ndarray, block: np.ndarray | None, least: float) -> list[tuple[int, int, float]]:
    """(smaller, larger, likeness) places of rows of ``slots`` that reach ``least`` likeness, of which one
    is ``odd``, and that no earlier link connects. Rows that are not odd are connected. With
    ``block``, only rows of different blocks are compared."""
    found = []
    group = np.where(odd, np.arange(len(slots)) + 1, 0)
    for x in np.flatnonzero(odd):
        alike = likeness(slots, slots[x])
        good = (alike >= least) & (group != group[x])
        if block is not None:
            good &= block != block[x]
        places = np.flatnonzero(good)
        joined, first = np.unique(group[places], return_index=True)
        found += [(int(min(x, y)), int(max(x, y)), float(alike[y])) for y in places[first]]
        group[np.isin(group, joined)] = group[x]
    return found


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(ids: DataFrame, n: int) -> Bucketizer:
    """Places ``at`` in up to ``n`` ranges that deal the identifiers out evenly.

    As doubles the identifiers keep their order, which is all that the ranges need.
    """
    found = ids.select(F.percentile_approx("at", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    splits = [float("-inf"), *sorted(set(found or [0.0])), float("inf")]
    return Bucketizer(splits=splits, inputCol="at", outputCol="place", handleInvalid="keep")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_ranges: int | None = None) -> DataFrame:
    """Fingerprints next to those of the edited text and of the next document.

    One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, shared_bands (bands that the edited fingerprint shares). The next
    document is that with the next smaller identifier; after the smallest comes the largest.

    Identifier ranges are sorted side by side. The last document of a range has its next one
    in another range, so the first of each range is sent to the range before as well: one
    text more per range.
    """
    spark = docs.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ident = F.col(id_col).cast("long")
    rows = docs.select(ident.alias("doc_id"), text_of(text_col).alias("content"), ident.cast("double").alias("at"))
    ids = docs.select(ident.alias("doc_id"), ident.cast("double").alias("at"))
    # Several ranges a task, so that hashing them to tasks comes out even.
    ranges = _ranges(ids, n_ranges or RANGES_PER_TASK * n_tasks)
    # Range 0 has the largest identifiers; those without one come last.
    last = len(ranges.getSplits()) - 1
    place = F.when(F.col("doc_id").isNull(), last).otherwise(last - 1 - F.col("place")).cast("int").alias("range")
    # One row per range comes to the driver: its first identifier.
    firsts = sorted(
        (r["range"], r["first"])
        for r in ranges.transform(ids).groupBy(place).agg(F.max("doc_id").alias("first")).collect()
    )
    before = {r: firsts[i - 1][0] for i, (r, _) in enumerate(firsts)}
    heads = spark.createDataFrame([(r, first, before[r]) for r, first in firsts], "head_range int, head long, to int")

    dealt = ranges.transform(rows).select("doc_id", "content", place, F.lit(False).alias("halo"))
    # Of documents with the first identifier the first by text is the first of the range.
    at_head = dealt.join(F.broadcast(heads), (F.col("range") == F.col("head_range")) & F.col("doc_id").eqNullSafe(F.col("head")))
    halo = at_head.groupBy("to", "doc_id").agg(F.min("content").alias("content")).select(
        "doc_id", "content", F.col("to").alias("range"), F.lit(True).alias("halo")
    )
    together = dealt.unionByName(halo).repartition(n_tasks, "range").sortWithinPartitions(
        "range", "halo", F.col("doc_id").desc_nulls_last(), "content"
    )

    def run(batches):
        import pyarrow as pa

        held: list[tuple[int, int | None, str, bool]] = []  # range, identifier, text, halo, in order
        size = 0

        def emit(pairs: list[tuple[int | None, str, str]]):
            for part in _batches([t for _, t, _ in pairs], BATCH_CHARS):
                chosen = pairs[part]
                texts = [t for _, t, _ in chosen]
                edited = [edited_text(t, following) for _, t, following in chosen]
                # The next text is mostly the next row's own.
                unique = {}
                for text in (*texts, *(f for _, _, f in chosen)):
                    unique.setdefault(text, len(unique))
                prints = fingerprint_texts(list(unique))
                own = prints[[unique[t] for t in texts]]
                after = prints[[unique[f] for _, _, f in chosen]]
                changed = fingerprint_texts(edited)
                bands = (own == changed).reshape(len(own), BANDS, -1).all(axis=2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i, _, _ in chosen], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                    pa.array([bytes(f).hex() for f in own]), pa.array([bytes(f).hex() for f in changed]),
                    pa.array(likeness(own, changed)), pa.array(likeness(own, after)), pa.array(bands, pa.int32()),
                ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_bands"])

        def settle():
            pairs = []
            for (r, ident, text, halo), (r2, _, following, _) in zip(held, held[1:]):
                if not halo and r == r2:
                    pairs.append((ident, text, following))
            yield from emit(pairs)
            del held[:-1]

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "content", "halo"))):
                held.append(row)
                size += len(row[2])
                if size > BATCH_CHARS:
                    yield from settle()
                    size = len(held[0][2])
        yield from settle()

    return together.mapInArrow(run, (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, shared_bands int"
    ))
