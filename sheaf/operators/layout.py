"""Tables in the text of a page, found by runs of lines with as many columns: array functions within each row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import format_row, separator_row
from ..functions.text import WS, escape_cell, trim_ws


def layout_lines(text: Column) -> Column:
    """array<struct<line, cells, n, long>>: trimmed lines, what two or more white spaces separate in them, the number of
    columns (0 for a blank line), and how many of the cells are longer than 48 bytes."""
    lines = F.split(F.regexp_replace(text, r"\r\n?|\f", "\n"), "\n", -1)

    def parsed(line: Column) -> Column:
        cells = F.filter(F.transform(F.split(line, rf"{WS}{{2,}}", -1), trim_ws), lambda c: c != "")
        return F.struct(line.alias("line"), cells.alias("cells"))

    def counted(row: Column) -> Column:
        n = F.when(row["line"] == "", 0).otherwise(F.greatest(F.size(row["cells"]), F.lit(1)))
        long = F.size(F.filter(row["cells"], lambda c: F.octet_length(c) > 48))
        return F.struct(row["line"].alias("line"), row["cells"].alias("cells"), n.alias("n"), long.alias("long"))

    return F.transform(F.transform(F.transform(lines, trim_ws), parsed), counted)


def render_lines(rows: Column, keep_unmatched: bool = False) -> Column:
    """The Markdown of layout_lines' rows. Runs are known by their borders, so each line is looked at a fixed number of
    times, however long a run is."""
    size = F.size(rows)
    n_at = lambda i: F.get(rows, i)["n"]
    borders = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (n_at(i) != n_at(i - 1)))
    runs = F.transform(borders, lambda low, j: F.struct(low.alias("low"), F.coalesce(F.get(borders, j + 1), size).alias("high")))

    def table_start(run: Column) -> Column:
        """The first line from which on two rows or more remain and under a third of the cells are long; null without."""
        n = n_at(run["low"])

        def step(state: Column, i: Column) -> Column:
            left = state["left"] + n - 3 * F.get(rows, i)["long"]
            fits = (left > 0) & (i <= run["high"] - 2)
            return F.struct(left.alias("left"), F.when(fits, i).otherwise(state["start"]).alias("start"))

        start = F.aggregate(F.sequence(run["high"] - 1, run["low"], F.lit(-1)), F.struct(F.lit(0).alias("left"), F.lit(None).cast("int").alias("start")), step)["start"]
        return F.when(n.between(2, 8), start)

    def block(run: Column) -> Column:
        n = n_at(run["low"])
        lines = lambda low, high: F.slice(rows, low + 1, high - low)
        plain = lambda low, high: F.array_join(F.transform(lines(low, high), lambda r: r["line"]), "\n")

        def table(start: Column) -> Column:
            shown = F.transform(lines(start, run["high"]), lambda r: format_row(r["cells"], n, lambda c: escape_cell(c, None)))
            head = F.concat(F.get(shown, F.lit(0)), F.lit("\n"), separator_row(n))
            return F.array_join(F.concat(F.array(head), F.slice(shown, 2, F.size(shown))), "\n")

        start = F.array(table_start(run))  # one element, so that what is found once is used by name
        found = F.get(F.transform(start, lambda s: F.when(s.isNotNull(), F.array(F.when(F.lit(keep_unmatched) & (s > run["low"]), plain(run["low"], s)), table(s))).when(F.lit(keep_unmatched), F.array(plain(run["low"], run["high"])))), F.lit(0))
        return F.when(n == 1, F.array(plain(run["low"], run["high"]))).when(n > 1, found)

    blocks = F.filter(F.flatten(F.filter(F.transform(runs, block), lambda b: b.isNotNull())), lambda b: b.isNotNull())
    return F.array_join(blocks, "\n\n")


def layout_markdown(texts: DataFrame, text_col: str, name: str = "markdown", keep_unmatched: bool = False) -> DataFrame:
    """texts with one more column, the tables and paragraphs of each text in order; rows stay as they are.

    Columns are what two or more white spaces separate. A table is the longest end of a run of neighbouring lines with
    as many columns that has two rows or more, two to eight columns, and under a third of its cells longer than 48
    bytes. Lines of one column are paragraphs; other lines are dropped unless keep_unmatched. Null texts give "".
    """
    rows = texts.withColumn("__lines", layout_lines(F.coalesce(F.col(text_col), F.lit(""))))
    return rows.withColumn(name, render_lines(F.col("__lines"), keep_unmatched)).drop("__lines")
