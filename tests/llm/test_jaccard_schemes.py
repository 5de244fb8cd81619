"""Every kind of scheme of the Jaccard join is complete, and costs pick among them."""

import random

import numpy as np
import pytest
from test_operators import components, near_copies

from shelfmark.llm import jaccard_join as jj


def forced(kind, percent):
    low, high = jj.bands(percent)
    return {b: jj.schemes(int(low[b]), int(high[b]), percent)[kind] for b in range(40) if jj.differences(int(high[b]), percent)}


@pytest.mark.parametrize("percent", [85, 80])
def test_schemes_cover_the_differences(percent):
    for kind in range(3):
        for b, scheme in forced(kind, percent).items():
            h = jj.differences(int(jj.bands(percent)[1][b]), percent)
            assert scheme.exact + 2 * scheme.deletion > h
            assert (scheme.exact > 0) == (kind < 2 and h > 0) and (scheme.deletion > 0) == (kind > 0)


@pytest.mark.parametrize("kind", [0, 1, 2])
@pytest.mark.parametrize("percent", [85, 80])
def test_linked_sets_share_what_they_need(kind, percent):
    rng, chosen = np.random.default_rng(kind), forced(kind, percent)
    sets = []
    for size in (*range(4, 61), 61, 150, 151, 400):
        for _ in range(6):
            x = rng.integers(0, 2**63, size, dtype=np.uint64)
            # As many elements gone, added or exchanged as a link may have.
            gone, new = rng.integers(0, size // 4 + 1), rng.integers(0, size // 4 + 1)
            y = np.concatenate((x[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)))
            sets += [np.sort(x), np.sort(y)]
    owner, sig, need = jj.signatures(sets, percent, chosen)
    of = [{} for _ in sets]
    for o, s, n in zip(owner, sig, need):
        of[o].setdefault(int(s) % 256, [set(), n])[0].add(int(s))
    linked = 0
    for i in range(0, len(sets), 2):
        both = len(np.intersect1d(sets[i], sets[i + 1]))
        union = len(sets[i]) + len(sets[i + 1]) - both
        if 100 * both < percent * union or both == union:
            continue
        linked += 1
        x, y = of[i], of[i + 1]
        # In the smaller one's band each has what it needs in common with the other.
        assert any(len(x[b][0] & y[b][0]) >= max(x[b][1], y[b][1]) for b in x.keys() & y.keys())
    assert linked > 40


@pytest.mark.parametrize("kind", [0, 1, 2])
@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_every_kind_finds_all_links(spark, kind, k, percent, monkeypatch):
    rnd = random.Random(kind)
    rows = [(i, " ".join(t.split()[:64])) for i, t in near_copies(rnd, 25)]
    monkeypatch.setattr(jj, "allotment", lambda *args, **options: forced(kind, percent))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.join_sets(df, k=k, percent=percent).collect()}
    assert got == components(rows, k, percent)


@pytest.mark.parametrize("k, percent", [(4, 85), (4, 80)])
def test_costs_pick_the_scheme(spark, k, percent):
    rnd = random.Random(6)
    low, high = jj.bands(percent)
    word = lambda: f"w{rnd.randrange(10**6)}"
    strangers = [" ".join(word() for _ in range(13)) for _ in range(600)]
    # One template: of ten shingles two are a text's own.
    templated = [" ".join([*(f"t{i}" for i in range(11)), word(), "end"]) for _ in range(600)]
    for texts, kinds in ((strangers, {0}), (templated, {1, 2})):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        chosen = jj.allotment(df, "text", k, percent, len(texts))
        assert chosen
        for b, scheme in chosen.items():
            if jj.differences(int(high[b]), percent) == 1:
                assert jj.schemes(int(low[b]), int(high[b]), percent).index(scheme) in kinds


def test_allotment_of_a_sample(spark):
    rnd = random.Random(1)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(10, 80))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts + texts[:1] * 1500], "text string")
    every = jj.allotment(df, "text", 4, 85, 3000)
    some = jj.allotment(df, "text", 4, 85, 3000, sample_sets=300)
    assert some.items() <= every.items() or len(some) < len(every)
    assert jj.allotment(df.limit(0), "text", 4, 85, 0) == {}


def test_one_leader_with_many_members_gives_few_links(spark):
    """Copies around one text that are linked in chains, not all with their leader: as brute force."""
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(250):
        text = list(base)
        for _ in range(rnd.randint(1, 3)):
            text[rnd.randrange(60)] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.join_sets(df, k=4, percent=85).collect()}
    assert got == components(rows, 4, 85)
