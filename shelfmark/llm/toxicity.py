"""Toxicity by a small convolutional text classifier, trained in numpy.

A text is a sequence of words hashed to buckets. A bucket seen in a few training texts or more has
an embedding, all others share the zero vector; filters of several widths run
over the sequence, each keeps its largest response (max pooling), and a logistic unit adds them
up. Because only maxima matter, the gradient of a text touches only the places where its
filters respond most.

For scoring, embeddings and filters are folded into one table per filter position, so a filter
of width three costs three look-ups and two sums a word. Whole texts are scored, and the score
depends on the text alone.

Training reads at most ``MAX_TEXTS`` labelled texts of each class and ``MAX_CHARS`` characters
of each, the first by a hash of the identifier (documented bounds of the sample). A fifth of the
sample is held back from fitting for the calibration, in which the classes weigh as they do among all labels:
the score 0.5 is put where errors are fewest, and per language the threshold is chosen on the scores of that language's calibration texts, and is 0.5
where a language has too few of them. The language only picks the threshold.

Cases: null and empty texts have no words and get the score the model gives to silence. Without
any positive or any negative labelled text all scores are 0. Labels of null are ignored, of
repeated label rows the largest counts. Null identifiers are kept and never labelled. An
empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from shelfmark.llm.common import fresh, map_batches, text_of

# Bounds of the training sample, for each of the two classes.
MAX_TEXTS = 6_000
MAX_CHARS = 20_000_000

BUCKETS = 1 << 20
LEAST_TEXTS = 3  # training texts that a bucket needs for an embedding of its own
RARITY = 20  # texts at which a word's odds count half
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, BATCH_TEXTS, RATE, DECAY = 8, 64, 0.01, 1e-5
CALIBRATION_FOLD = 5
LEAST_FOR_LANGUAGE = 40
PUNCTUATION = ".,;:!?\"'()[]{}"
# Words given to the filters at a time when scoring.
BATCH_WORDS = 100_000
_MEMO_LIMIT = 100_000


def word_buckets(rows: dict[int, int] | None = None) -> Callable[[str], list[int]]:
    """A function from a text to its word buckets, or to their ``rows`` in an embedding (0 for
    buckets without one), with a bounded memo of words."""
    memo: dict[str, int] = {}

    def bucket(word: str) -> int:
        found = zlib.crc32(word.lower().strip(PUNCTUATION).encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
        if rows is not None:
            found = rows.get(found, 0)
        if len(memo) < _MEMO_LIMIT:
            memo[word] = found
        return found

    def buckets(text: str) -> list[int]:
        get = memo.get
        return [b if (b := get(w)) is not None else bucket(w) for w in text.split()]

    return buckets


def _padded(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each followed by zero rows; where each begins, and where its windows
    stop beginning: after its last word, or after one zero row if it has none."""
    gap = max(WIDTHS)
    starts = np.zeros(len(lists), np.int64)
    np.cumsum([len(x) + gap for x in lists[:-1]], out=starts[1:])
    flat = np.zeros(sum(len(x) for x in lists) + gap * len(lists), np.int32)
    for start, x in zip(starts, lists):
        flat[start : start + len(x)] = x
    return flat, starts, starts + np.maximum([len(x) for x in lists], 1)


@dataclass
class Model:
    embedding: np.ndarray  # (rows, DIM); row 0 is zero, for words without an embedding
    filters: list[np.ndarray]  # per width (width, DIM, FILTERS)
    biases: list[np.ndarray]
    weights: np.ndarray  # (FILTERS * len(WIDTHS))
    bias: float
    shift: float = 0.0  # moves the logit so that 0.5 is the best threshold
    thresholds: dict[str, float] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)  # bucket: row of the embedding

    @classmethod
    def new(cls, odds: np.ndarray, seed: int = 7) -> Model:
        """Random but for the first coordinate of the embedding: there stand the ``odds`` of
        each word, so that max pooling looks at telling words from the first step on."""
        rng = np.random.default_rng(seed)
        embedding = rng.normal(0, 0.05, (len(odds), DIM)).astype(np.float32)
        embedding[:, 0] = odds
        embedding[0] = 0
        filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0] = np.abs(f[:, 0])
        return cls(
            embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))).astype(np.float32), -1.0,
        )

    def tables(self) -> list[list[np.ndarray]]:
        """Per width and position the responses of every word."""
        return [[self.embedding @ f[k] for k in range(w)] for w, f in zip(WIDTHS, self.filters)]

    def pooled(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables=None) -> tuple[np.ndarray, list[np.ndarray]]:
        """(texts, filters) largest responses before the ReLU, and the responses per width."""
        tables = tables or self.tables()
        tops, maps = [], []
        # From each start to its end; what lies between an end and the next start is left out.
        borders = np.column_stack((starts, ends)).ravel()
        for w, bias, parts in zip(WIDTHS, self.biases, tables):
            response = parts[0].take(flat, axis=0)
            for k in range(1, w):
                response[:-k] += parts[k].take(flat[k:], axis=0)
            response += bias
            tops.append(np.maximum.reduceat(response, borders, axis=0)[::2])
            maps.append(response)
        return np.hstack(tops), maps

    def logits(self, lists: list[list[int]], tables=None) -> np.ndarray:
        flat, starts, ends = _padded(lists)
        tops, _ = self.pooled(flat, starts, ends, tables)
        return np.maximum(tops, 0) @ self.weights + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows=None) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= self.rate * m[at] / (np.sqrt(v[at]) + 1e-6)


def log_odds(lists: list[np.ndarray], labels: np.ndarray, n_rows: int) -> np.ndarray:
    """How much oftener a row's words are in toxic texts than in others, near 0 for rare ones."""
    seen = np.zeros((2, n_rows))
    for words, label in zip(lists, labels):
        seen[label, np.unique(words)] += 1
    texts = np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None]
    rates = np.log((seen + 0.5) / (texts + 1))
    n = seen.sum(axis=0)
    return (rates[1] - rates[0]) * n / (n + RARITY)


def embedding_rows(buckets: list[np.ndarray]) -> dict[int, int]:
    """Rows for the buckets in ``LEAST_TEXTS`` texts or more, from 1."""
    texts = np.zeros(BUCKETS, np.int32)
    for x in buckets:
        texts[np.unique(x)] += 1
    return {int(b): i for i, b in enumerate(np.flatnonzero(texts >= LEAST_TEXTS), 1)}


def as_rows(buckets: list[np.ndarray], rows: dict[int, int]) -> list[np.ndarray]:
    table = np.zeros(BUCKETS, np.int32)
    table[list(rows)] = list(rows.values())
    return [table[x] for x in buckets]


def train(lists: list[list[int]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit to bucket lists by Adam on the logistic loss, toxic texts weighing up to three times."""
    rows = embedding_rows(lists)
    lists = as_rows(lists, rows)
    model, rng, adam = Model.new(log_odds(lists, labels, len(rows) + 1), seed), np.random.default_rng(seed), _Adam(RATE)
    positive = max(1, int(labels.sum()))
    lift = min(3.0, (len(labels) - positive) / positive)
    order = np.arange(len(lists))
    for epoch in range(epochs):
        rng.shuffle(order)
        adam.rate = RATE * (1 - epoch / epochs)
        for begin in range(0, len(order), BATCH_TEXTS):
            chosen = order[begin : begin + BATCH_TEXTS]
            flat, starts, ends = _padded([lists[i] for i in chosen])
            y = labels[chosen].astype(np.float32)
            # Only the words at hand have a response: fold the tables for those.
            used, local = np.unique(flat, return_inverse=True)
            words = model.embedding[used]
            parts = [[words @ f[k] for k in range(w)] for w, f in zip(WIDTHS, model.filters)]
            tops, maps = model.pooled(local, starts, ends, parts)
            active = np.maximum(tops, 0)
            error = (_sigmoid(active @ model.weights + model.bias) - y) * np.where(y > 0, lift, 1.0) / len(chosen)
            error = error.astype(np.float32)
            grad_tops = error[:, None] * model.weights * (tops > 0)
            grad_words = np.zeros_like(words)
            for j, w in enumerate(WIDTHS):
                block = slice(j * FILTERS, (j + 1) * FILTERS)
                # The first place at which a filter reaches its maximum in each text.
                best = np.empty((len(chosen), FILTERS), np.int64)
                for i, (a, b) in enumerate(zip(starts, ends)):
                    best[i] = a + maps[j][a:b].argmax(axis=0)
                g = grad_tops[:, block]
                grad_filter = np.empty_like(model.filters[j])
                for k in range(w):
                    at = local[np.minimum(best + k, len(local) - 1)]
                    grad_filter[k] = np.einsum("nfd,nf->df", words[at], g)
                    np.add.at(grad_words, at.ravel(), (g[:, :, None] * model.filters[j][k].T[None]).reshape(-1, DIM))
                adam.step(f"filter{j}", model.filters[j], grad_filter + DECAY * model.filters[j])
                adam.step(f"bias{j}", model.biases[j], g.sum(axis=0))
            adam.step("weights", model.weights, active.T @ error + DECAY * model.weights)
            model.bias -= adam.rate * float(error.sum())
            # Rows of the embedding move only where they have a gradient; row 0 stays zero.
            moved = np.flatnonzero(np.abs(grad_words).sum(axis=1) * (used > 0))
            adam.step("embedding", model.embedding, grad_words[moved], used[moved])
    model.rows = rows
    return model


def best_threshold(scores: np.ndarray, labels: np.ndarray, clean_weight: float = 1.0) -> float:
    """A threshold with the fewest errors, in the middle of the widest such gap.

    ``clean_weight`` is how much a clean text counts against a toxic one.
    """
    if not labels.any() or labels.all():
        return 0.5
    order = np.argsort(scores)
    s, y = scores[order], labels[order]
    below = np.concatenate(([0], np.cumsum(y)))  # positives that fall below the cut
    above = (len(y) - np.arange(len(y) + 1)) - (y.sum() - below)  # negatives above it
    edges = np.concatenate(([0.0], s, [1.0]))
    gaps = edges[1:] - edges[:-1]
    errors = below + above * clean_weight
    cut = np.lexsort((-gaps, errors))[0]
    return float((edges[cut] + edges[cut + 1]) / 2)


def calibrate(
    model: Model, lists: list[list[int]], labels: np.ndarray, langs: list[str | None], clean_weight: float = 1.0
) -> None:
    """Put 0.5 at the best threshold of all texts, then set a threshold per language."""
    if not len(labels):
        return
    cut = np.clip(best_threshold(_sigmoid(model.logits(lists)), labels, clean_weight), 1e-6, 1 - 1e-6)
    model.shift = float(-np.log(cut / (1 - cut)))
    scores = _sigmoid(model.logits(lists) + model.shift)
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if own.sum() >= LEAST_FOR_LANGUAGE and labels[own].any():
            found = best_threshold(scores[own], labels[own], clean_weight)
            weights = np.where(labels[own] > 0, 1.0, clean_weight)
            errors = lambda t: float((((scores[own] >= t) != (labels[own] > 0)) * weights).sum())
            # Where the general threshold makes as few errors, stay with it.
            model.thresholds[lang] = 0.5 if errors(0.5) <= errors(found) else found


def is_held_out(id_col: str | Column) -> Column:
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(ident.cast("string")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str | None = "lang", *, max_texts: int = MAX_TEXTS, max_chars: int = MAX_CHARS,
) -> Model | None:
    """The model for ``labels`` (doc_id, toxic); rows that ``is_held_out`` are never learnt from.

    None if one of the two classes is missing.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col))
        .groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    )
    known = known.select("id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64("id").alias("h"))
    n = dict(known.groupBy("toxic").count().collect())
    if len(n) < 2:
        return None
    # The sample by hash of the identifier; its identifiers are few enough to broadcast.
    first = lambda c: known.where(F.col("toxic") == c).orderBy("h", "id").limit(max_texts)
    chosen = first(0).unionByName(first(1))
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("content"), lang.alias("lang"))
    sizes = texts.select("id", F.length("content").alias("chars"), F.xxhash64("content").alias("c"))
    rows = sizes.join(F.broadcast(chosen), "id").orderBy("h", "id", "c").limit(2 * max_texts).collect()
    ids, total = {}, [0, 0]
    for row in rows:
        # A text that does not fit is left out; the next may fit.
        if not total[row["toxic"]] or total[row["toxic"]] + row["chars"] <= max_chars:
            total[row["toxic"]] += row["chars"]
            ids[row["id"], row["c"]] = row["toxic"]
    taken = [sum(v == c for v in ids.values()) for c in (0, 1)]
    if not all(taken):
        return None
    clean_weight = (n[0] / taken[0]) / (n[1] / taken[1])

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = spark.createDataFrame([(i, c) for i, c in ids], f"id {kind}, c long")
    sample = texts.withColumn("c", F.xxhash64("content")).join(F.broadcast(wanted), ["id", "c"])

    def make():
        buckets = word_buckets()

        def step(batch):
            lists = [buckets(t) for t in batch.column("content").to_pylist()]
            return {
                "id": batch.column("id"), "c": batch.column("c"), "lang": batch.column("lang"),
                "words": [np.array(x, np.int32).tobytes() for x in lists],
            }

        return step

    found = map_batches(sample.select("id", "c", "lang", "content"), f"id {kind}, c long, lang string, words binary", make)
    by_id = {(r["id"], r["c"]): r for r in found.toLocalIterator()}
    lists, y, langs, calibration = [], [], [], []
    for (ident, c), toxic in ids.items():
        if (r := by_id.get((ident, c))) is not None:
            lists.append(np.frombuffer(r["words"], np.int32))
            y.append(int(toxic > 0))
            langs.append(r["lang"])
            calibration.append(zlib.crc32(f"calibration {ident}".encode()) % CALIBRATION_FOLD == 0)
    y, calibration = np.array(y), np.array(calibration)
    part = lambda flag: [x for x, c in zip(lists, calibration) if c == flag]
    if len(set(y[~calibration])) < 2:
        calibration[:] = False
    model = train(part(False), y[~calibration])
    calibrate(model, as_rows(part(True), model.rows), y[calibration], [x for x, c in zip(langs, calibration) if c], clean_weight)
    return model


def score_texts(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` (``_score`` if there is one), from 0 to 1."""
    (out,) = fresh(docs, "score")
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    kept = docs.columns
    schema = StructType([*docs.schema.fields]).add(out, DoubleType())
    # A few megabytes, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        tables, buckets = own.tables(), word_buckets(own.rows)

        def scores(texts: list[str | None]) -> np.ndarray:
            out, held, n = [], [], 0
            for text in texts:
                words = buckets(text or "")
                # A text longer than a batch goes through in overlapping stretches.
                if len(words) > BATCH_WORDS:
                    out.append(_flush(held)); held, n = [], 0
                    out.append(_long(words))
                    continue
                held.append(words)
                n += len(words)
                if n > BATCH_WORDS:
                    out.append(_flush(held)); held, n = [], 0
            out.append(_flush(held))
            return np.concatenate(out)

        def _flush(lists):
            return _sigmoid(own.logits(lists, tables) + own.shift) if lists else np.empty(0)

        def _long(words):
            reach, tops = max(WIDTHS) - 1, []
            for a in range(0, len(words), BATCH_WORDS):
                # Windows of a stretch begin in it; only the text's last ones reach past its end.
                flat, starts, ends = _padded([words[a : a + BATCH_WORDS + reach]])
                tops.append(own.pooled(flat, starts, np.minimum(ends, BATCH_WORDS), tables)[0][0])
            best = np.maximum(np.max(tops, axis=0), 0)
            return _sigmoid(np.array([best @ own.weights + own.bias + own.shift]))

        def step(batch):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in kept}
            return columns | {out: pa.array(scores(texts), pa.float64())}

        return step

    return map_batches(docs, schema, make)


def threshold_of(model: Model | None, lang_col: str | Column) -> Column:
    """The calibrated threshold of a row's language, 0.5 for languages without one."""
    lang = F.col(lang_col) if isinstance(lang_col, str) else lang_col
    pairs = sorted((model.thresholds if model else {}).items())
    if not pairs:
        return F.lit(0.5)
    known = F.create_map(*[F.lit(v) for pair in pairs for v in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(lang, F.lit(""))), F.lit(0.5))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the texts whose score reaches their language's threshold."""
    model = fit(docs, labels, id_col, text_col, lang_col)
    scored = score_texts(docs, model, text_col)
    return scored.where(F.col(scored.columns[-1]) < threshold_of(model, lang_col)).select(*docs.columns)
