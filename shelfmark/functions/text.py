"""Text repair, hashing, word budgets, prompts and the segment rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators that go into hashes and prompts, budgets, fall-back messages.
HASH_SEPARATOR = "+"
SUMMARY_SEPARATOR = "###\n"
WORD_BUDGET = 5000
NO_DOCUMENT_SUMMARY = "There was an error retrieving a summary for this document"
NO_FOLDER_SUMMARY = "There was an error retrieving a summary for this folder"
DOCUMENT_OPENING = "This document "
FOLDER_OPENING = "This folder "

WORD_GAP = "[ \\t\\n\\r\\f]+"
# ``(?<=[.!?])[ \t\r\n]+|\n+``, but only looked into where a blank or a line end stands.
SENTENCE_GAP = "[ \\t\\r\\n](?:(?<=[.!?][ \\t\\r\\n])[ \\t\\r\\n]*|(?<=\\n)\\n*)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- lines -----------------------------------------------------------------------------


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def join_broken_lines(text: Column) -> Column:
    """Glue a line that starts with a lowercase letter to the line above it."""
    return F.regexp_replace(text, "\n(?=\\p{IsLowercase})", "")


def drop_repeat_lines(text: Column) -> Column:
    """Drop every line that equals the line just above it."""

    def unrepeated(lines: Column) -> Column:
        kept = F.filter(lines, lambda line, i: (i == 0) | (line != F.get(lines, i - 1)))
        return F.array_join(kept, "\n")

    return let(split_lines(text), unrepeated)


def repair_text(text: Column) -> Column:
    """Clean up text that came out of page layout: glue broken lines, then drop repeats."""
    return drop_repeat_lines(join_broken_lines(text))


def extracted_text(doc_type: Column, text: Column) -> Column:
    """The text a document is indexed by: page layout is repaired, paragraph and slide
    texts lose adjacent repeats, every other type is taken as it is."""
    return (
        F.when(doc_type == "pdf", repair_text(text))
        .when(doc_type.isin("docx", "pptx"), drop_repeat_lines(text))
        .otherwise(text)
    )


def break_to_html(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("<br/>"))


# --- identity --------------------------------------------------------------------------


def document_hash(path: Column, name: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(HASH_SEPARATOR, path, name, F.coalesce(text, F.lit(""))), 256)


def folder_hash(path: Column, text: Column) -> Column:
    return F.sha2(F.concat(path, F.lit(HASH_SEPARATOR), text), 256)


def document_id(content_hash: Column) -> Column:
    return F.sha2(F.concat(F.lit("document:"), content_hash), 256)


def folder_id(content_hash: Column) -> Column:
    return F.sha2(F.concat(F.lit("folder:"), content_hash), 256)


def segment_id(document: Column, ord_: Column) -> Column:
    return F.sha2(F.concat(F.lit("segment:"), document, F.lit(":"), ord_.cast("string")), 256)


# --- words -----------------------------------------------------------------------------


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda word: word != "")


def count_words(text: Column) -> Column:
    return F.size(words(text))


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` words with single blanks between them.

    The split stops after ``n + 1`` gaps, so a long text is not cut up whole.
    """
    head = F.filter(F.slice(F.split(text, WORD_GAP, n + 2), 1, n + 1), lambda word: word != "")
    return F.array_join(F.slice(head, 1, n), " ")


def truncate_words(text: Column, n: int = WORD_BUDGET) -> Column:
    """``struct(text, truncated)``: the text, or its first ``n`` words if it has more."""

    def cut(parts: Column) -> Column:
        over = F.size(parts) > n
        return F.struct(
            F.when(over, F.array_join(F.slice(parts, 1, n), " ")).otherwise(text).alias("text"),
            over.alias("truncated"),
        )

    return let(words(text), cut)


# --- prompts and summaries -------------------------------------------------------------

# What a model is asked. The opening phrases are fixed values: summaries begin with them.
DOCUMENT_INSTRUCTIONS = f"""\
Purpose: one entry of a search index over files.
Tell a searcher in plain sentences which subjects, names, places, dates and figures this %s file
covers and what it could be needed for. Use the terms of the text itself.
First words of your answer: {DOCUMENT_OPENING.strip()}"""
EXCERPT_NOTE = "What follows is an excerpt from the start of a longer text."
FOLDER_INSTRUCTIONS = f"""\
Purpose: one entry of a search index over folders, and input for the entry of the folder above.
You get the entries of what lies in one folder. Name the subjects they have in common and the
range they span, so that a searcher knows whether to look inside.
First words of your answer: {FOLDER_OPENING.strip()}"""
ANSWER_INSTRUCTIONS = """\
Purpose: an answer for somebody who searches the files that these passages come from.
Passages come nearest first. Rely on them alone; where they are silent, that is the answer."""


def _asked(*parts: Column | str) -> Column:
    """Parts with a blank line between them; those that are null are left out."""
    return F.concat_ws("\n\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def document_prompt(
    doc_type: Column, text: Column, truncated: Column, instructions: str = DOCUMENT_INSTRUCTIONS
) -> Column:
    """Instructions, with the type in place of ``%s``, and the text; null without a text."""
    note = F.when(truncated, F.lit(EXCERPT_NOTE))
    return F.when(text.isNotNull(), _asked(F.replace(F.lit(instructions), F.lit("%s"), doc_type), note, text))


def folder_prompt(text: Column, instructions: str = FOLDER_INSTRUCTIONS) -> Column:
    return F.when(text.isNotNull(), _asked(instructions, text))


def question_prompt(question: Column, context: Column, instructions: str = ANSWER_INSTRUCTIONS) -> Column:
    """What a model is asked to answer from the context; null without a context."""
    return F.when(context.isNotNull(), _asked(instructions, F.concat(F.lit("Question: "), question), context))


def lead_summary(text: Column, opening: str, n: int) -> Column:
    """``opening`` and the first ``n`` words; null where there is no word."""
    return let(first_words(text, n), lambda head: F.when(head != "", F.concat(F.lit(opening), head)))


def summary_or_default(summary: Column, message: str) -> Column:
    return F.coalesce(summary, F.lit(message))


def embedding_input(summary: Column, name: Column) -> Column:
    """What stands for a record in vector space: its summary, or its name if it has none."""
    return F.coalesce(F.nullif(summary, F.lit("")), name)


# --- segments --------------------------------------------------------------------------


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_GAP), lambda s: F.length(s) > 0)


def is_substantial(text: Column, min_words: int = 4, readable_share: float = 0.8) -> Column:
    """False for a bare link, for text with many marks among its letters and digits, and for
    a short line without a sentence end (header or footer); true for the rest and where
    nothing can be said."""
    readable = F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", ""))
    visible = F.length(F.regexp_replace(text, "[ \\t\\n\\r\\f.,;:]+", ""))
    bare_link = text.rlike("^[ \\t\\n\\r\\f]*(https?://|www\\.)[^ \\t\\n\\r\\f]+[ \\t\\n\\r\\f]*$")
    marks = readable < visible * readable_share
    heading = (F.size(F.split(F.trim(text), WORD_GAP, min_words)) < min_words) & ~text.rlike("[.!?]")
    return F.coalesce(~(bare_link | marks | heading), F.lit(True))


def json_flag(arguments: Column, key: str = "meaningful") -> Column:
    """A boolean out of a JSON object; true if it is missing or cannot be read."""
    found = F.get_json_object(arguments, f"$.{key}")
    return F.coalesce(found.try_cast("boolean"), F.lit(True))
