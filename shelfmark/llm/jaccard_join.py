"""Jaccard join of word-shingle sets by universe partition and pigeonhole.

Two sets that reach the similarity differ in at most H elements, where H follows from the size
of the smaller. The universe is dealt by hash into segments. A segment is indexed as it is, or
with its one-deletion neighbourhood, that is also without each one of its elements in turn; in the
first kind linked sets must agree exactly to meet, in the second up to one element gone, or one
exchanged. A segment that they do not meet in holds one difference at least, or two. So with e
segments of the first kind and d of the second, e + 2 d > H, linked sets meet in some segment. Signatures are
hashes of (size band, segment, the set's elements in it). A set takes part in the scheme of its own
size band and of the lower bands where smaller partners may be.

Each size band has a scheme of its own (``Scheme``), allotted by cost: exact segments, some more
than the pigeonhole asks for, so that of a set's segments only the subset that tells it apart is
indexed (not those that are empty or have one element, which many strangers share; only sets with
more such segments than the slack covers keep theirs); deletion neighbourhoods alone, half as many
segments of twice the size; or some of either. What a scheme costs is counted on a sample of the
sets: the signatures it gives, and how many of them meet others. Exact segments give the fewest
signatures; where many sets share most of what they have, as texts of one template do, deletion
neighbourhoods of larger segments keep them apart. Each choice is complete, so the sample decides the cost only.

Sets meet in the buckets of their signatures. Linked sets share a known number of signatures, so
a set that meets others in fewer of a scheme's buckets leaves them. A bucket's leader is the
member that meets most others in all its buckets: in a group of edited copies that is mostly the
text they were made from. Every member is compared with its leaders, exactly. Members that this
does not connect with a leader are compared with its other members by their differences from
the leader: x and y differ where these differ, so one look over short lists is as exact as
comparing whole sets. Large groups are compared block by block; no pair becomes a row.

Cases: a null text is empty; empty texts and texts without words have no links. Equal sets are
one set. Rows that repeat are members of the same component. Very long texts give their whole set. Null identifiers count as the
largest: a component of null identifiers only has component_id null. An empty table gives an
empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import fresh, map_batches, text_of
from shelfmark.llm.shingles import mix, set_digest, shingle_sets
from shelfmark.runtime import materialise, small

BAND_RATIO = 1.3
SLACKS = (1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.8, 2.0)
# What signatures of segments with one element, and of empty ones, cost more than others by the
# formula that picks a band's exact scheme: strangers meet in them.
SINGLE_COST, EMPTY_COST = 0.5, 25
# Sets, about, on which schemes are compared, and what a signature that meets another costs there.
SAMPLE_SETS = 4000
MEET_COST = 20
# Texts of a batch that are read at a time, and elements whose signatures are made at a time.
TEXTS_AT_ONCE = 100
BATCH_TOKENS = 100_000
# Elements of differences in a block of members.
BLOCK_TOKENS = 250_000
# Members of one leader that are compared with each other at a time, about.
BLOCK_MEMBERS = 4096
PEELINGS = 3
_U = np.uint64


@lru_cache(maxsize=8)
def bands(percent: int, largest: int = 1 << 31) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each band."""
    low, high = [], []
    size = 1
    while size <= largest:
        low.append(size)
        high.append(max(size, math.floor(size * BAND_RATIO)))
        size = high[-1] + 1
    return np.array(low), np.array(high)


def differences(size: int, percent: int) -> int:
    """The most elements in which a set of up to ``size`` differs from a larger linked one."""
    return size * (100 - percent) // percent


class Scheme(NamedTuple):
    """``exact`` segments, of which those with up to ``weak`` elements are left out, and
    ``deletion`` segments, twice as large."""

    exact: int
    deletion: int
    weak: int


@lru_cache(maxsize=512)
def schemes(low: int, high: int, percent: int) -> tuple[Scheme, Scheme, Scheme]:
    """The schemes that are compared for a band: exact, mixed, deletion."""
    h = differences(high, percent)
    best = None
    for slack in SLACKS:
        exact = math.ceil((h + 1) * slack)
        # Segments with none and with one element, in the band's smallest sets.
        none = math.exp(-low / exact)
        one = none * low / exact
        for weak, left_out, single in ((0, none, one), (1, none + one, 0.0)):
            # How likely more of them are weak than the slack covers.
            spread = math.sqrt(2 * exact * left_out * (1 - left_out))
            lacking = math.erfc((exact - h - 0.5 - exact * left_out) / spread) / 2
            cost = exact * (1 - left_out + single * SINGLE_COST + lacking * left_out * EMPTY_COST)
            best = min(best or (cost, exact, weak), (cost, exact, weak))
    some = (h + 1) // 2
    return Scheme(best[1], 0, best[2]), Scheme(some, math.ceil((h + 1 - some) / 2), -1), Scheme(0, math.ceil((h + 1) / 2), -1)


def taking_part(sizes: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(band, places of the sets that take part in its scheme)."""
    low, high = bands(percent)
    own = np.searchsorted(high, sizes)
    for step in range(len(low)):
        band = own - step
        fits = (sizes > 0) & (band >= 0)
        # In the scheme of a lower band only as the larger partner of a set there.
        if step:
            fits &= high[np.maximum(band, 0)] * 100 // percent >= sizes
            if not fits.any():
                break
        for b in np.unique(band[fits]):
            if differences(int(high[b]), percent) > 0:  # else linked sets of this size are equal
                yield int(b), np.flatnonzero(fits & (band == b))


def signatures(sets: list[np.ndarray], percent: int, chosen: dict[int, Scheme]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, signature, need) of the sets; owner is the place in ``sets``. ``need`` is how many
    signatures of the scheme its owner shares with any linked set, at least. The last eight
    bits of a signature are the band. Bands that are not in ``chosen`` have their exact scheme."""
    low, high = bands(percent)
    owners, found, needs = [], [], []
    for b, members in taking_part(np.array([len(s) for s in sets], np.int64), percent):
        scheme = chosen.get(b) or schemes(int(low[b]), int(high[b]), percent)[0]
        o, s, need = band_signatures([sets[i] for i in members], b, differences(int(high[b]), percent), scheme)
        owners.append(members[o])
        found.append((s & ~_U(255)) | _U(b & 255))
        needs.append(need)
    if not owners:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(owners), np.concatenate(found).view(np.int64), np.concatenate(needs)


def band_signatures(sets: list[np.ndarray], band: int, h: int, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets, of which linked ones differ in up to ``h`` elements, under a scheme."""
    exact, deletion, least = scheme
    segments = exact + deletion
    tokens = mix(np.concatenate(sets) + _U(band * 2 + 1))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    part = ((tokens >> _U(33)) % _U(exact + 2 * deletion)).astype(np.int64)
    part = np.where(part < exact, part, exact + (part - exact) // 2)
    cell = owner * segments + part
    n_cells = len(sets) * segments
    # Sums modulo 2**64 from two halves, each exact in a double.
    low_half = np.bincount(cell, (tokens & _U(0xFFFFFFFF)).astype(np.float64), n_cells).astype(np.uint64)
    high_half = np.bincount(cell, (tokens >> _U(32)).astype(np.float64), n_cells).astype(np.uint64)
    content = low_half + (high_half << _U(32))
    salt = mix(np.arange(segments, dtype=np.uint64) + _U(band << 32))
    salts = np.tile(salt, len(sets))
    whole = mix(content + salts)
    cells = np.arange(n_cells)
    weak = (np.bincount(cell, minlength=n_cells) <= least) & (cells % segments < exact)
    # Segments that linked sets meet in, a deletion segment counting twice, are more than slack.
    slack = exact + 2 * deletion - h - weak.reshape(len(sets), segments).sum(axis=1)
    lacking = slack < 1
    need = np.where(lacking, 1, -(-slack // 2) if deletion else slack)
    kept = ~weak | np.repeat(lacking, segments)
    owners, found = cells[kept] // segments, whole[kept]
    if deletion:
        near = part >= exact
        without = mix(content[cell[near]] - tokens[near] + salts[cell[near]])
        owners, found = np.concatenate((owners, owner[near])), np.concatenate((found, without))
    return owners, found, need[owners]


def allotment(texts: DataFrame, text_col: str, k: int, percent: int, n_sets: int, sample_sets: int = SAMPLE_SETS) -> dict[int, Scheme]:
    """The cheapest scheme of each band that a sample of the ``n_sets`` different sets reaches.

    About ``sample_sets`` texts, by hash, are indexed under every scheme. A signature costs one,
    and ``MEET_COST`` more if another text of the sample has it. What comes to the driver
    is two numbers for each band and scheme.
    """
    low, high = bands(percent)
    content = text_of(text_col).alias("content")
    whole = 1 << 30
    rows = texts.select(content)
    if n_sets > sample_sets:
        rows = rows.where(F.pmod(F.xxhash64("content", F.lit(percent)), F.lit(whole)) < max(1, whole * sample_sets // n_sets))
    rows = rows.dropDuplicates(["content"])

    def make():
        def step(batch):
            for start in range(0, batch.num_rows, 64):
                sets = list(shingle_sets(batch.column("content").slice(start, 64).to_pylist(), k))
                found = {"band": [], "kind": [], "sig": []}
                for b, members in taking_part(np.array([len(s) for s in sets], np.int64), percent):
                    for kind, scheme in enumerate(schemes(int(low[b]), int(high[b]), percent)):
                        _, sig, _ = band_signatures([sets[i] for i in members], b, differences(int(high[b]), percent), scheme)
                        found["band"].append(np.full(len(sig), b)), found["kind"].append(np.full(len(sig), kind)), found["sig"].append(sig.view(np.int64))
                if found["sig"]:
                    yield {c: pa.array(np.concatenate(v)) for c, v in found.items()}

        return step

    counts = map_batches(rows, "band int, kind int, sig long", make).groupBy("band", "kind", "sig").agg(F.count(F.lit(1)).alias("n"))
    met = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    costs = counts.groupBy("band", "kind").agg((F.sum("n") + MEET_COST * met).alias("cost")).collect()
    cheapest = {}
    for r in sorted(costs, key=lambda r: (r["band"], r["cost"], r["kind"])):
        cheapest.setdefault(r["band"], schemes(int(low[r["band"]]), int(high[r["band"]]), percent)[r["kind"]])
    return cheapest


def _sets(content: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The set of each text of a column."""
    for start in range(0, len(content), TEXTS_AT_ONCE):
        yield from shingle_sets(content.slice(start, TEXTS_AT_ONCE).to_pylist(), k)


def _documents(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, h, n, d1, d2): set size and digests of each document; h is a hash of its text."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("content"))

    def make():
        def step(batch):
            sizes, first, second = [], [], []
            for tokens in _sets(batch.column("content"), k):
                a, b = set_digest(tokens)
                sizes.append(len(tokens)), first.append(a), second.append(b)
            return {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "n": sizes, "d1": first, "d2": second}

        return step

    return map_batches(rows, f"doc_id {kind}, h long, n long, d1 long, d2 long", make)


def _signature_rows(docs: DataFrame, text_col: str, k: int, percent: int, chosen: dict[int, Scheme]) -> DataFrame:
    """(sig, d1, need) of every set; sets that a task meets again give nothing."""

    def make():
        seen: set[int] = set()

        def step(batch):
            held, keys, total = [], [], 0
            for tokens in _sets(batch.column("content"), k):
                d1, _ = set_digest(tokens)
                if not len(tokens) or d1 in seen:
                    continue
                seen.add(d1)
                held.append(tokens), keys.append(d1)
                total += len(tokens)
                if total > BATCH_TOKENS:
                    yield rows(held, keys)
                    held, keys, total = [], [], 0
            if held:
                yield rows(held, keys)

        def rows(held, keys):
            owner, sig, need = signatures(held, percent, chosen)
            return {"sig": pa.array(sig), "d1": pa.array(np.array(keys, np.int64)[owner]), "need": pa.array(need, pa.int32())}

        return step

    return map_batches(docs.select(text_of(text_col).alias("content")), "sig long, d1 long, need int", make)


def _buckets(rows: DataFrame) -> DataFrame:
    """(sig, d1, need): the members of buckets with two sets or more.

    The rows of a signature are sorted next to each other and read as a stream; of a bucket
    nothing but its last row is held.
    """

    def run(batches):
        held = None  # the last row so far, as three arrays of one, and whether it was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                columns = [np.concatenate((h, c)) for h, c in zip(held[0], columns)]
            sig, d1, _ = columns
            same = (sig[1:] == sig[:-1]) & (d1[1:] != d1[:-1])
            again = np.concatenate(([False], (sig[1:] == sig[:-1]) & (d1[1:] == d1[:-1])))
            # A repeated row counts as its first one.
            met = np.zeros(len(sig), bool)
            met[1:] |= same
            met[:-1] |= same
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(sig))))
            found = np.zeros(len(sig), bool)
            np.logical_or.at(found, first, met)
            given = held is not None and held[1]
            out = found & ~again
            if given:
                out[0] = False
            last = first[-1]
            # The last row waits if it has met nobody yet; else it is only remembered.
            waits = not (found[last] or (last == 0 and given))
            held = ([c[last : last + 1] for c in columns], not waits)
            if out.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[out]), pa.array(d1[out]), pa.array(columns[2][out], pa.int32())], names=["sig", "d1", "need"]
                )

    sorted_rows = rows.repartition(F.col("sig")).sortWithinPartitions("sig", "d1")
    return sorted_rows.mapInArrow(run, "sig long, d1 long, need int")


def _peeled(members: DataFrame) -> DataFrame:
    """(sig, d1) without the sets that meet others in too few buckets of a scheme for a link."""
    scheme = F.pmod("sig", F.lit(256))
    for _ in range(PEELINGS):
        enough = members.groupBy("d1", scheme.alias("scheme")).agg(
            F.count(F.lit(1)).alias("n"), F.max("need").alias("need")
        ).where("n >= need").select("d1", "scheme")
        members = members.withColumn("scheme", scheme).join(enough, ["d1", "scheme"], "left_semi").drop("scheme")
        alive = members.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig")
        members = materialise(members.join(alive, "sig", "left_semi"), "members")
    return members.select("sig", "d1")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) is connected with.

    Labels go to neighbours and then to where the label's own label points, so paths are
    halved; every step is written down.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        offered = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("offer"))
        lower = labels.join(offered, labels["node"] == offered["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "offer").alias("label")
        )
        lower = materialise(lower, "labels")
        target = lower.select(F.col("node").alias("t"), F.col("label").alias("further"))
        jumped = materialise(
            lower.join(target, lower["label"] == target["t"]).select("node", "old", F.col("further").alias("label")), "labels"
        )
        labels = jumped.select("node", "label")
        if not jumped.where("old <> label").head(1):
            return labels


def _stars(members: DataFrame) -> DataFrame:
    """(x, y): each bucket's most popular member and each other one, without repeats."""
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
    popular = members.join(sizes, "sig").groupBy("d1").agg(F.sum("size").alias("met"))
    leaders = members.join(popular, "d1").groupBy("sig").agg(F.max_by("d1", F.struct("met", "d1")).alias("x"))
    return members.join(leaders, "sig").where("d1 <> x").select("x", F.col("d1").alias("y")).distinct()


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, diff) of the ``pairs`` (x, y) of digests: the two sets, their sizes, and
    the elements that only one of them has."""
    left = small(pairs).join(sets, F.col("y") == F.col("d1")).select(
        "x", F.col("node").alias("b"), F.col("tokens").alias("b_tokens")
    )
    asked = sets.join(small(materialise(pairs.select(F.col("x").alias("d1")).distinct(), "leaders")), "d1", "left_semi")
    both = left.join(asked, F.col("x") == F.col("d1")).where("b <> node")
    diff = F.concat(F.array_except("tokens", "b_tokens"), F.array_except("b_tokens", "tokens"))
    return both.select(
        F.col("node").alias("a"), "b", F.size("tokens").alias("na"), F.size("b_tokens").alias("nb"), diff.alias("diff")
    )


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    n = F.col("na") + F.col("nb")
    common = (n - F.size("diff")) / 2
    return compared.where(common * 100 >= (n - common) * percent).select("a", "b")


def _within_clusters(compared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one leader of which not all are connected with it."""
    own = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"c_{c}"))
    named = compared.join(own("a"), "a", "left").join(own("b"), "b", "left").select(
        "a", "b", F.col("nb").alias("n"), "diff", F.coalesce("c_b", "b").alias("label"),
        (F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).alias("odd"),
    )
    named = materialise(named, "named")
    clusters = named.groupBy("a").agg(
        F.count(F.lit(1)).alias("members"), F.count_if("odd").alias("n_odd"),
        F.greatest(F.ceil(F.sum(F.size("diff") + 1) / BLOCK_TOKENS), F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS)).alias("blocks"),
    ).where("members > 1 AND n_odd > 0").select("a", "blocks")
    open_rows = named.join(clusters, "a")
    # A member of block i goes to every pair of blocks that has i.
    block = F.pmod(F.xxhash64("b"), F.col("blocks"))
    dealt = open_rows.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    dealt = dealt.select(
        "a", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
        "n", "odd", F.xxhash64("label").alias("label"), "diff", F.col("b.d1").alias("d1"), F.col("b.d2").alias("d2"),
    )
    sorted_rows = dealt.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j", "d1", "d2").select(
        F.xxhash64("a", "i", "j").alias("key"), (F.col("i") != F.col("j")).alias("across"), "block", "n", "odd", "label", "d1", "d2", "diff"
    )

    def links(n, odd, label, block, across, offsets, tokens):
        """Places (x, y) of linked members, x odd, that no earlier link of the block connects: fewer
        than it has labels."""
        found = []
        values, flat = np.unique(tokens, return_inverse=True)
        group = np.unique(label, return_inverse=True)[1]
        sizes = np.diff(offsets)
        filled = np.flatnonzero(sizes)
        mark = np.zeros(len(values), np.int64)
        for x in np.flatnonzero(odd):
            mine = flat[offsets[x] : offsets[x + 1]]
            mark[mine] = 1
            both = np.zeros(len(n), np.int64)
            both[filled] = np.add.reduceat(mark[flat], offsets[:-1][filled])
            mark[mine] = 0
            apart = sizes[x] + sizes - 2 * both
            common = (n[x] + n - apart) / 2
            good = (common * 100 >= (n[x] + n - common) * percent) & (group != group[x])
            if across:
                good &= block != block[x]
            places = np.flatnonzero(good)
            joined, first = np.unique(group[places], return_index=True)
            found += [(x, y) for y in places[first]]
            group[np.isin(group, joined)] = group[x]
        return found

    def run(batches):
        held, key = [], None

        def settle():
            table = pa.Table.from_batches(held).combine_chunks()
            columns = {c: table.column(c).combine_chunks() for c in table.column_names}
            n, odd, label, block, d1, d2 = (columns[c].to_numpy(zero_copy_only=False) for c in ("n", "odd", "label", "block", "d1", "d2"))
            diff = columns["diff"]
            offsets = diff.offsets.to_numpy().astype(np.int64)
            tokens = diff.values.to_numpy()[offsets[0] : offsets[-1]]
            found = links(n.astype(np.int64), odd, label, block, columns["across"][0].as_py(), offsets - offsets[0], tokens)
            if found:
                x, y = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (d1[x], d2[x], d1[y], d2[y])], names=["a1", "a2", "b1", "b2"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            borders = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for begin, end in zip(borders, borders[1:]):
                if begin == end:
                    continue
                if held and keys[begin] != key:
                    yield from settle()
                    held.clear()
                key = keys[begin]
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from settle()

    pairs = sorted_rows.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")
    node = lambda p: F.struct(F.col(f"{p}1").alias("d1"), F.col(f"{p}2").alias("d2"))
    return pairs.select(node("a").alias("a"), node("b").alias("b")).distinct()


def join_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, h, n_shingles, component_id, d1, d2, c1, c2.

    ``component_id`` is the component's smallest identifier; ``c1`` and ``c2`` are the digests of
    one of its sets and tell components apart where identifiers repeat or are null. ``k`` words a shingle; linked from ``percent`` / 100 on. The component of a document
    without words is itself.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = materialise(_documents(docs, id_col, text_col, k), "sets")
    node = F.struct("d1", "d2")
    nodes = materialise(
        table.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "nodes"
    )
    chosen = allotment(texts, "text", k, percent, nodes.count())
    members = _peeled(materialise(_buckets(_signature_rows(texts, "text", k, percent, chosen)), "buckets"))
    stars = materialise(_stars(members), "stars")

    # The sets of all that met another, from one document of each.
    met = members.select("d1").distinct()
    involved = materialise(nodes.join(met, "d1", "left_semi"), "involved")
    reps = small(materialise(involved.select(F.col("rep").alias("r")).distinct(), "reps"))
    sets = materialise(
        _tokens(texts.join(reps, F.col("doc_id").eqNullSafe(F.col("r")), "left_semi"), k)
        .join(small(involved.select("d1", "d2")), ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])
        .select("d1", node.alias("node"), "tokens"),
        "tokens",
    )
    compared = materialise(_compare(stars, sets), "compared")
    links = materialise(_linked(compared, percent), "links")
    labels = connected(links)
    more = materialise(_within_clusters(compared, labels, percent), "links")
    if more.head(1):
        labels = connected(links.unionByName(more))

    groups = nodes.select(node.alias("node"), "rep").join(labels, "node")
    smallest = groups.groupBy("label").agg(F.min("rep").alias("component"))
    named_nodes = groups.join(smallest, "label").select(
        "node.d1", "node.d2", "component", F.col("label.d1").alias("c1"), F.col("label.d2").alias("c2")
    )
    alone = nodes.select("d1", "d2", "rep").join(named_nodes, ["d1", "d2"], "left")
    components = alone.select(
        F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.coalesce("component", "rep").alias("component"),
        F.coalesce("c1", "d1").alias("c1"), F.coalesce("c2", "d2").alias("c2"),
    )
    same = (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") > 0)
    return table.join(materialise(components, "components"), same, "left").select(
        "doc_id", "h", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "d1", "d2", "c1", "c2",
    )


def _tokens(texts: DataFrame, k: int) -> DataFrame:
    """(d1, d2, tokens) of the documents."""

    def make():
        def step(batch):
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                sets = list(_sets(batch.column("content").slice(start, TEXTS_AT_ONCE), k))
                digests = [set_digest(s) for s in sets]
                yield {
                    "d1": [a for a, _ in digests], "d2": [b for _, b in digests],
                    "tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                }

        return step

    return map_batches(texts.select(text_of("text").alias("content")), "d1 long, d2 long, tokens array<bigint>", make)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest identifier.

    Documents without words all stay. Of a component's rows with the same identifier the first by
    digest of their set stays, of equal rows one. Components whose smallest identifiers are equal,
    or that have null identifiers only, keep one document each.
    """
    marks = join_sets(docs, id_col, text_col, k=k, percent=percent)
    first = marks.where("n_shingles > 0").groupBy("c1", "c2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d1", "d2", "h")).alias("first")
    ).select("first.doc_id", "first.h")
    ident, text_hash, one, nth = fresh(docs, "stay_id", "stay_hash", "stay", "nth")
    stays = materialise(
        marks.where("n_shingles = 0").select("doc_id", "h", F.lit(False).alias("one"))
        .unionByName(first.withColumn("one", F.lit(True))).distinct(), "stays",
    ).select(F.col("doc_id").alias(ident), F.col("h").alias(text_hash), F.col("one").alias(one))
    hashed = F.xxhash64(text_of(text_col))
    joined = docs.join(stays, F.col(id_col).eqNullSafe(F.col(ident)) & (hashed == F.col(text_hash)))
    order = W.partitionBy(ident, text_hash).orderBy(F.lit(1))
    return joined.withColumn(nth, F.row_number().over(order)).where(
        ~F.col(one) | (F.col(nth) == 1)
    ).select(*docs.columns)
