"""Conversations as training text with a loss mask over what the assistant says.

A conversation is rendered whole: every turn between control strings, with control strings
inside a text broken up reversibly. It is encoded once, with offsets. The character spans of
the assistant's texts and the offsets of the tokens are both sorted, so a binary search finds
the tokens of each span. Texts stand directly between control tokens, so no token lies across
the border of a text.

A conversation of very many turns is rendered in blocks of up to ``TURNS_PER_BLOCK`` turns. The
control tokens at the seams make this the same as rendering it in one piece. All rows are sorted
by conversation and turn over all tasks, and blocks are cut from the sorted stream: whatever the
turn numbers are, a task holds a few blocks, and a large conversation is spread over tasks.
``read_digests`` reads the blocks of a conversation as a stream, too; only ``read_back`` makes one
value of a conversation.

Cases: a null text is empty; a null role is the empty role. Rows go by turn, those without a
turn last, ties by role and text; rows that repeat are turns of their own. Rows without a
conv_id form one conversation. Empty assistant texts have no tokens. An empty table gives an
empty table. Other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches

TURNS_PER_BLOCK = 256
BATCH_CHARS = 2_000_000  # characters that are encoded at a time, about
BORDER_CHARS = 16

# The template: TURN role SAYS text DONE, for every turn.
TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
# What a text must not contain as it is; control strings of other templates are broken up too.
CONTROLS = (TURN, SAYS, DONE, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
# Escapes: a backslash is doubled, and a control string gets this behind its first character.
BREAK = "\\-"
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\([\\-])")
_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(DONE)}", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group()[0] + BREAK + m.group()[1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m.group(1) == "\\" else "", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) turns and the spans of the assistant's texts in it."""
    parts, spans, length = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role == "assistant":
            spans.append((length + len(head), length + len(head) + len(body)))
        parts += (head, body, DONE)
        length += len(head) + len(body) + len(DONE)
    return "".join(parts), spans


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    model = Tokenizer.from_file(path)
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    model.add_special_tokens([TURN, SAYS, DONE])
    return model


def mask_tokens(offsets, spans: list[tuple[int, int]]):
    """Ranges [first, after) of the tokens inside each span; ``offsets`` are (start, end) rows."""
    import numpy as np

    starts, ends = offsets[:, 0], offsets[:, 1]
    begin, stop = np.array(spans, np.int64).reshape(-1, 2).T
    first = np.searchsorted(ends, begin, side="right")
    after = np.searchsorted(starts, stop, side="left")
    return first, np.maximum(first, after)


def format_conversations(
    rows: DataFrame, tokenizer: str, *, turns_per_block: int = TURNS_PER_BLOCK
) -> DataFrame:
    """One row per conversation and block: conv_id, block, formatted, input_ids, offsets
    array<int> (start and end of each token in turn), loss_mask array<boolean>.

    ``rows`` has conv_id, turn, role and text. Blocks of a conversation follow each other by
    ``block``; the numbers have gaps.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = rows.select(
        "conv_id", F.col("turn").isNull().alias("late"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # Ranges by the beginnings of roles and texts, which sort as they do, so that the range borders stay
    # short. Behind a role that is cut, texts do not count.
    n_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = [
        F.substring("role", 1, BORDER_CHARS),
        F.when(F.length("role") < BORDER_CHARS, F.substring("text", 1, BORDER_CHARS)).otherwise(""),
    ]
    ordered = turns.repartitionByRange(n_tasks, "conv_id", "late", "turn", *short).sortWithinPartitions(
        "conv_id", "late", "turn", "role", "text"
    ).select(F.spark_partition_id().cast("long").alias("task"), "conv_id", "role", "text")

    def run(batches):
        import numpy as np

        model = _tokenizer(tokenizer)
        names = ["conv_id", "block", "formatted", "input_ids", "offsets", "loss_mask"]
        held, conv, turns, chars, n_blocks = [], None, [], 0, 0

        def close():
            # Tasks are in the order of the ranges.
            nonlocal n_blocks
            if turns:
                held.append((conv, (task << 32) + n_blocks, *render(turns)))
                n_blocks += 1
                turns.clear()

        def settle():
            convs, blocks, texts, spans = zip(*held)
            ids, places, masks = [], [], []
            for encoded, span in zip(model.encode_batch(list(texts), add_special_tokens=False), spans):
                offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
                mask = np.zeros(len(offsets) + 1, np.int64)
                first, after = mask_tokens(offsets, span)
                np.add.at(mask, first, 1)
                np.add.at(mask, after, -1)
                ids.append(encoded.ids)
                places.append(offsets.ravel())
                masks.append(np.cumsum(mask)[:-1] > 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(convs, conv_type), pa.array(blocks, pa.int64()), pa.array(texts, pa.string()),
                pa.array(ids, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())),
            ], names=names)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            conv_type, task = batch.schema.field("conv_id").type, batch.column(0)[0].as_py()
            for ident, role, text in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                if ident != conv or len(turns) >= turns_per_block:
                    close()
                    if len(held) >= 256 or chars > BATCH_CHARS:
                        yield from settle()
                        chars = 0
                conv = ident
                turns.append((role, text))
                chars += len(role) + len(text)
        close()
        if held:
            yield from settle()

    return ordered.mapInArrow(
        run,
        f"conv_id {kind}, block long, formatted string, input_ids array<int>, offsets array<int>, loss_mask array<boolean>",
    )


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def masked_text(formatted: str, offsets, mask) -> str:
    """The text under the loss mask: runs of masked tokens, each unescaped."""
    import numpy as np

    places = np.asarray(offsets, np.int64).reshape(-1, 2)
    flags = np.concatenate(([0], np.asarray(mask, np.int8), [0]))
    change = np.flatnonzero(np.diff(flags))
    return "".join(
        unescape(formatted[places[a, 0] : places[b - 1, 1]]) for a, b in zip(change[::2], change[1::2])
    )


def _read_blocks(formatted: DataFrame) -> DataFrame:
    """(conv_id, block, n_turns, turns, loss_text, chars) of each block."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def make():
        def step(batch):
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column("formatted").to_pylist()
                turns = [read_turns(t) for t in texts]
                yield {
                    "conv_id": part.column("conv_id"), "block": part.column("block"),
                    "n_turns": [len(t) for t in turns],
                    "turns": ["".join(f"{role}\n{text}\n" for role, text in t) for t in turns],
                    "loss_text": [
                        masked_text(t, o.values.to_numpy(), m.values.to_numpy(zero_copy_only=False))
                        for t, o, m in zip(texts, part.column("offsets"), part.column("loss_mask"))
                    ],
                    "chars": [len(t) for t in texts],
                }

        return step

    return map_batches(
        formatted.select("conv_id", "block", "formatted", "offsets", "loss_mask"),
        f"conv_id {kind}, block long, n_turns long, turns string, loss_text string, chars long", make,
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from the output of ``format_conversations``: conv_id,
    n_turns, turns (role, line end, text, line end for each), loss_text, formatted_chars.

    A conversation is one value here; ``read_digests`` takes conversations of any size.
    """
    ordered = F.array_sort(F.collect_list(F.struct("block", "turns", "loss_text")))
    return _read_blocks(formatted).groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), ordered.alias("blocks")
    ).select(
        "conv_id", "n_turns", F.array_join("blocks.turns", "").alias("turns"),
        F.array_join("blocks.loss_text", "").alias("loss_text"), "formatted_chars",
    )


def read_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, the digests of what ``read_back`` gives: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The blocks of a conversation are sorted next to each other and read as a stream.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        import hashlib

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        done, conv, state = [], None, None

        def close():
            if state:
                n, said, loss_chars, loss, chars = state
                done.append((conv, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def settle():
            convs, *columns = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(convs, conv_type), *map(pa.array, columns)], names=names)
            done.clear()

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for ident, n, turns, loss_text, chars in zip(*(
                batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "turns", "loss_text", "chars")
            )):
                if state is None or ident != conv:
                    close()
                    conv, state = ident, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    if len(done) >= 1000:
                        yield from settle()
                state[0] += n
                state[1].update(turns.encode())
                state[2] += len(loss_text)
                state[3].update(loss_text.encode())
                state[4] += chars
        close()
        if done:
            yield from settle()

    blocks = _read_blocks(formatted).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return blocks.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
