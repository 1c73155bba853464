"""Markdown tables as native columns. A grid is an array of rows, a row an array of cells; rows may differ in length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_cell, let


def format_row(row: Column, width: Column, escape: Callable[[Column], Column] | None = None) -> Column:
    """Cells between bars, filled up or cut to the width."""
    cell = lambda i: F.coalesce(F.get(row, i), F.lit(""))
    cells = F.transform(F.sequence(F.lit(0), width - 1), lambda i: escape(cell(i)) if escape else cell(i))
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def separator_row(width: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))


def header_width(grid: Column) -> Column:
    return F.coalesce(F.size(F.get(grid, F.lit(0))), F.lit(0))


def greatest_width(grid: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(grid, lambda row: F.coalesce(F.size(row), F.lit(0)))), F.lit(0))


def render_table(grid: Column, width: Column | None = None, escape: Callable[[Column], Column] = escape_cell) -> Column:
    """The first row is the header. Without rows, or with a width of 0, the table is empty. Grid and width are made once,
    not again for each row, and each row is written once."""
    if width is None:
        return let(grid, lambda g: render_table(g, greatest_width(g), escape))

    def table(t: Column) -> Column:
        below = lambda i: F.when(i == 0, F.concat(F.lit("\n"), separator_row(t["width"]))).otherwise("")
        rows = F.transform(t["grid"], lambda row, i: F.concat(format_row(row, t["width"], escape), below(i)))
        return F.when((F.size(t["grid"]) < 1) | (t["width"] < 1), "").otherwise(F.array_join(rows, "\n"))

    return let(F.struct(grid.alias("grid"), width.alias("width")), table)


def drop_blank_rows(grid: Column) -> Column:
    """Without rows whose cells are all empty."""
    return F.filter(grid, lambda row: F.exists(row, lambda cell: F.coalesce(cell, F.lit("")) != ""))
