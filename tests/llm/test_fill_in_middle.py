"""Fill-in-middle outputs and their restoration against a plain version."""

import hashlib
import re
from collections import Counter

import pytest
from test_operators import empty, odd  # noqa: F401

from shelfmark.llm import fill_in_middle as fim
from shelfmark.llm import queries

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_version(doc_id, text):
    """(doc_id, n, form, prefix_chars, middle_chars, output, text) by the rule, unit by unit."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, digest = len(units), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not n or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), output, text


TEXTS = [
    "", "a", "ab cd ef", "é ü\n\n\tß 汉字 𝒳𝒴 end", "<P>", "has <S> inside", "ends with <", "<P <S <M < > P> S> M>",
    "x" * 50, "1234567890" * 7, "word, " * 400, "<" * 40, "S>" * 30, "\x00 nul \x00", "KKİ not letters",
]


@pytest.mark.parametrize("units, chars", [(8192, 32_768), (3, 5), (1, 1)])
def test_outputs_and_restoration(spark, units, chars, monkeypatch):
    monkeypatch.setattr(fim, "PIECE_UNITS", units)
    monkeypatch.setattr(fim, "PIECE_CHARS", chars)
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, t) for t in (*TEXTS, None)] + [(5, "twice " * 9)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(plain_version(*r) for r in rows)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    # Workers import the module anew, so pieces are cut here to bounds of the test.
    cut = [
        (i, k, 0, 0, place, *facts, piece)
        for k, (i, t) in enumerate(rows)
        for *facts, parts in [fim.cut(t or "", "" if i is None else str(i), 1, 10, 20)] for place, piece in enumerate(parts)
    ]
    assert units > 100 or max(len(c[-1]) for c in cut) <= 3 + chars
    pieces = spark.createDataFrame(cut, fim.output_pieces(docs).schema)
    for made in (pieces, fim.output_pieces(docs)):
        got = Counter(tuple(r) for r in fim.assembled(made).collect())
        assert got == Counter({w[:6]: c for w, c in want.items()})
        back = Counter(tuple(r) for r in fim.restored(made).collect())
        assert back == Counter({(*w[:5], sha(w[5]), w[6]): c for w, c in want.items()})
        digests = Counter(tuple(r) for r in fim.restored(made, fim.Digest).collect())
        assert digests == Counter({(*w[:5], sha(w[5]), sha(w[6])): c for w, c in want.items()})


def test_marks_across_borders_of_pieces():
    for output, order in (("<P>ab<<S>c>S<M>d", "0ab< 2c>S 1d"), ("<S><P><M>", ""), ("<S>x<P>y<M><", "2x 0y 1<")):
        for width in range(1, 7):
            found, sections = {}, fim.Sections("psm")
            stretches = [s for i in range(0, len(output), width) for s in sections.add(output[i : i + width])]
            for section, piece in [*stretches, *sections.add("", last=True)]:
                found[section] = found.get(section, "") + piece
            assert " ".join(f"{k}{v}" for k, v in found.items()) == order


def test_one_exchange(spark, odd):
    plan = fim.restored(fim.output_pieces(odd))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_awkward_rows(odd, empty):
    got = Counter(tuple(r) for r in fim.restored(fim.output_pieces(odd)).collect())
    want = Counter()
    for r in odd.collect():
        w = plain_version(r["doc_id"], r["text"])
        want[(*w[:5], sha(w[5]), w[6])] += 1
    assert got == want
    assert fim.restored(fim.output_pieces(empty)).count() == 0
    assert fim.assembled(fim.output_pieces(empty)).count() == 0


def test_very_long_text(spark):
    text = "Lorem ipsum 12, " * 200_000 + "q" * 100_000 + "<"
    docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    pieces = fim.output_pieces(docs)
    assert {r[0] for r in pieces.selectExpr("max(length(piece)) <= 32771").collect()} == {True}
    want = {plain_version(i, text)[:6] for i in range(4)}
    assert {tuple(r) for r in fim.assembled(pieces).collect()} == want
    assert {r["restored"] for r in fim.restored(pieces, fim.Digest).collect()} == {sha(text)}


def test_query_against_plain_version(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text").collect()
    want = [(*w[:5], sha(w[5]), sha(w[6])) for w in (plain_version(*r) for r in docs)]
    got = queries.REGISTRY["op11_fill_in_middle"](spark, small_tables)
    key = lambda r: r[0]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
