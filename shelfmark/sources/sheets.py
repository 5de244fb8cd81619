"""Spreadsheet grids as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import let

# Text of an empty cell, what follows each cell and each row.
EMPTY_CELL, CELL_END, ROW_END = "None", " ", "\n"


def _grid_text(cells: Column) -> Column:
    """Text of cells already in (row, col) order."""

    def cell(c: Column, i: Column, all_cells: Column) -> Column:
        following = F.get(all_cells, i + 1)
        last_in_row = following.isNull() | (following["row"] != c["row"])
        return F.concat(
            F.coalesce(c["value"], F.lit(EMPTY_CELL)),
            F.lit(CELL_END),
            F.when(last_in_row, F.lit(ROW_END)).otherwise(""),
        )

    return let(cells, lambda a: F.array_join(F.transform(a, lambda c, i: cell(c, i, a)), ""))


def render_cells(cells: DataFrame, block_rows: int = 1000) -> DataFrame:
    """(path, part, text): each sheet as text, in blocks of ``block_rows`` sheet rows.

    The parts of a sheet, in order, are its whole text. A block is what one task holds, so
    a huge sheet is spread over many of them. One shuffle.
    """
    part = F.floor(F.col("row") / block_rows).cast("long")
    grouped = cells.groupBy("path", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("row", "col", "value"))).alias("cells")
    )
    return grouped.select("path", "part", _grid_text(F.col("cells")).alias("text"))


def sheet_texts(cells: DataFrame) -> DataFrame:
    """(path, text): sheets as one value each, to be used as file texts."""
    parts = render_cells(cells).groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts")
    )
    return parts.select("path", F.array_join(F.col("parts.text"), "").alias("text"))
