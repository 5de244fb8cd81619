"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, plus signs, scheme marks, digits and identifier cues. From
each anchor a small parser walks outwards, gives the one span the kind's grammar allows there,
and checks it. The parsers are deterministic: their spans are those of the kind's regular
expression, leftmost and without overlap.

Base kinds: email, ip, card, phone. The method adds url (a scheme and what follows), account
(IBANs with valid check digits) and ssn (three groups of digits after a cue). An IBAN ends at its
country's length; of a country without a known length, at the last blank or end that the check
digits confirm. Cues count in any case. Offsets count code points, ends are exclusive.

Cases: null and empty texts have no spans. Rows that repeat each get their result. Null
identifiers are kept. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "ssn", "secret", "handle")
SCHEMES = ("http://", "https://", "ftp://")
IBAN_CUES = ("iban",)
SSN_CUES = ("ssn", "social security")
# What names a credential, before a colon or equals sign and its value; and how issued keys begin.
SECRET_CUES = (
    "api key", "api_key", "api-key", "apikey", "access key", "access_key", "accesskey", "secret key", "secret_key", "secret",
    "token", "password", "passwd", "pwd", "private_key", "client_secret",
)
PASSWORD_CUES = ("password", "passwd", "pwd")
KEY_SHAPES = {"akia": r"AKIA[0-9A-Z]{16}", "ghp_": r"ghp_[A-Za-z0-9]{36}", "xoxb-": r"xoxb-[0-9A-Za-z-]{20,}"}
CUE_REACH = 24  # characters between a cue and what it announces

_DIGITS = frozenset("0123456789")
# Each parser anchors its pattern at one place, where the grammar leaves no choice.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*")
_IP_PART = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"(?:https?|ftp)://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>\"']*)?")
_IBAN_HEAD = re.compile(r"(?=([A-Z]{2})[0-9]{2})")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?")
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LENGTH_OF = {country: n for n, countries in IBAN_LENGTHS.items() for country in countries.split()}
_SSN = re.compile(r"(?<![0-9])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
# A value is quoted, or ends at white space or a mark that closes a clause.
_SECRET = re.compile(r"""["']?[ \t]{0,2}[:=][ \t]{0,2}(?:"([^"\s]+)"|'([^'\s]+)'|([^\s"',;]+))""")
_KEY_SHAPE = {cue: re.compile(rf"{shape}(?![0-9A-Za-z])") for cue, shape in KEY_SHAPES.items()}
_HANDLE = re.compile(r"[A-Za-z0-9_]{2,30}(?![A-Za-z0-9_@])")

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    anchors = {"@": "at", "+": "plus", **{d: "digit" for d in _DIGITS}}
    anchors |= {s: "scheme" for s in SCHEMES} | {c: "iban" for c in IBAN_CUES} | {c: "ssn" for c in SSN_CUES}
    anchors |= {c: "secret" for c in SECRET_CUES} | {c: "key" for c in KEY_SHAPES}
    automaton = ahocorasick.Automaton()
    for word, kind in anchors.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    twice = digits[-2::-2].translate(str.maketrans("0123456789", "0246813579"))
    return (sum(map(int, digits[-1::-2])) + sum(map(int, twice))) % 10 == 0


def valid_iban(text: str) -> bool:
    code = text.replace(" ", "")
    if not 15 <= len(code) <= 34:
        return False
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


@lru_cache(maxsize=64)
def _iban_of(length: int) -> re.Pattern:
    """IBANs of a length, in groups of four with single blanks between them or without."""
    groups, rest = divmod(length - 4, 4)
    return re.compile(f"[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{groups}}}" + f"(?: ?[0-9A-Z]{{{rest}}})" * (rest > 0) + "(?![0-9A-Z])")


def find_iban(text: str, start: int, last: int) -> tuple[int, int] | None:
    """The first valid IBAN that begins at a place from ``start`` to ``last``."""
    for head in _IBAN_HEAD.finditer(text, start, last + 4):
        at, length = head.start(), _LENGTH_OF.get(head.group(1))
        match = (_iban_of(length) if length else _IBAN).match(text, at)
        end = match.end() if match else at
        while end > at and not valid_iban(text[at:end]):
            end = at if length else max(at, text.rfind(" ", at, end))
        if end > at:
            return at, end
    return None


def lower_case(text: str) -> str:
    """``text`` in lower case, with every character at its place."""
    lower = text.lower()
    return lower if len(lower) == len(text) else text.translate(_LOWER)


def find_secret(text: str, cue: str, start: int, end: int) -> tuple[int, int] | None:
    """The value that a credential's name at ``start`` to ``end`` is given, if it looks like one: six
    characters that are not letters only for a password, else eight with letters and digits."""
    if start and text[start - 1].isalpha():
        return None
    match = _SECRET.match(text, end)
    if not match:
        return None
    begin, finish = next(match.span(i) for i in (1, 2, 3) if match.group(i))
    finish = begin + len(text[begin:finish].rstrip(".!?)"))
    value = text[begin:finish]
    letters, digits = any(c.isalpha() for c in value), any(c in _DIGITS for c in value)
    good = len(value) >= 6 and not value.isalpha() if cue in PASSWORD_CUES else len(value) >= 8 and letters and digits
    return (begin, finish) if good else None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind in the order of ``KINDS``, then start."""
    found: dict[str, list[tuple[int, int]]] = {}
    done = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    runs = 0  # end of the digit run that was looked at last
    dotted = 0

    def add(kind: str, start: int, end: int, good: bool) -> None:
        done[kind] = end
        if good:
            found.setdefault(kind, []).append((start, end))

    lower = lower_case(text)
    for last, (anchor, length) in _automaton().iter(lower):
        if anchor == "digit":
            if last >= runs:
                # A maximal run of digits with single blanks or hyphens between them.
                run = _CARD.match(text, last)
                runs = run.end()
                digits = re.sub("[ -]", "", run.group())
                if len(digits) > 1:
                    add("card", last, runs, 13 <= len(digits) <= 19 and luhn(digits))
            if last >= dotted:
                chain = _DOTTED.match(text, last)
                dotted = chain.end()
                at = last
                while part := _IP_PART.match(text, at, dotted):
                    add("ip", at, part.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in part.group().split(".")))
                    at = part.end() + 1
        elif anchor == "at":
            start = last
            while start > done["email"] and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < last and (domain := _DOMAIN.match(text, last + 1)):
                add("email", start, domain.end(), True)
            elif (not last or text[last - 1] not in _LOCAL_CHARS | {"@"}) and (name := _HANDLE.match(text, last + 1)):
                add("handle", last, name.end(), any(c.isalpha() for c in name.group()))
        elif anchor == "plus":
            if phone := _PHONE.match(text, last):
                n = sum(c in _DIGITS for c in phone.group())
                add("phone", last, phone.end(), 9 <= n <= 15)
        elif anchor == "scheme":
            start = last - length + 1
            if start >= done["url"] and (url := _URL.match(text, start)):
                end = start + len(url.group().rstrip(".,;:!?)"))
                add("url", start, end, end > start + length)
        elif anchor == "iban":
            if span := find_iban(text, max(last + 1, done["account"]), last + 1 + CUE_REACH):
                add("account", *span, True)
        elif anchor == "secret":
            start = last - length + 1
            if start >= done["secret"] and (span := find_secret(text, lower[start : last + 1], start, last + 1)):
                add("secret", *span, True)
        elif anchor == "key":
            start = last - length + 1
            shape = _KEY_SHAPE[lower[start : last + 1]].match(text, start)
            if shape and start >= done["secret"] and not (start and text[start - 1].isalnum()):
                add("secret", *shape.span(), True)
        else:
            near = _SSN.search(text, last + 1, last + 1 + CUE_REACH + 42)
            if near and near.start() <= last + 1 + CUE_REACH and near.start() >= done["ssn"]:
                add("ssn", *near.span(), True)
    return [(kind, *span) for kind in KINDS for span in sorted(found.get(kind, ()))]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end>>."""
    schema = "doc_id {}, spans array<struct<kind:string,start:int,end:int>>".format(docs.schema[id_col].dataType.simpleString())
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("content"))

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def step(batch) -> Iterator[dict]:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                spans = [
                    [dict(zip(("kind", "start", "end"), span)) for span in find_spans(text)]
                    for text in part.column("content").to_pylist()
                ]
                yield {"doc_id": part.column("doc_id"), "spans": pa.array(spans, kind)}

        return step

    return map_batches(rows, schema, make)


def span_digests(found: DataFrame) -> DataFrame:
    """The result of ``find_pii`` in digest form: counts, base_sha256, spans as text."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
