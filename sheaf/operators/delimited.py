"""Comma-separated text, strictly: every record has as many fields as the first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrow import arrow_function, slices
from ..functions.tables import greatest_width, header_width, render_table
from ..functions.text import let
from .dispatch import Source, result


class Malformed(ValueError):
    pass


def parse_csv(text: str, ragged: bool = False) -> list[list[str]]:
    """RFC 4180 records: blank lines are skipped, a quote may only open a field, and records of another length than the
    first are an error unless ragged ones are wanted."""
    rows: list[list[str]] = []
    text = text.replace("\r\n", "\n")
    at, n = 0, len(text)
    while at < n:
        if text[at] == "\n":
            at += 1
            continue
        row: list[str] = []
        while True:
            if at < n and text[at] == '"':
                parts, at = [], at + 1
                while True:
                    end = text.find('"', at)
                    if end < 0:
                        raise Malformed("a quoted field without an end")
                    parts.append(text[at:end])
                    if text[end + 1 : end + 2] == '"':
                        parts.append('"')
                        at = end + 2
                        continue
                    at = end + 1
                    break
                if at < n and text[at] not in ",\n":
                    raise Malformed("text behind a quoted field")
                row.append("".join(parts))
            else:
                line = text.find("\n", at)
                comma = text.find(",", at)
                end = min(x for x in (line, comma, n) if x >= 0)
                if '"' in text[at:end]:
                    raise Malformed("a quote in an unquoted field")
                row.append(text[at:end])
                at = end
            if at < n and text[at] == ",":
                at += 1
                continue
            at += 1
            break
        if rows and len(row) != len(rows[0]) and not ragged:
            raise Malformed("wrong number of fields")
        rows.append(row)
    return rows


@arrow_function("struct<grid:array<array<string>>,error:string>")
def _strict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in (x for whole in batches for x in slices(whole)):
        out = []
        for text in batch:
            if text is None:
                out.append((None, None))
                continue
            try:
                out.append((parse_csv(text), None))
            except Malformed as e:
                out.append((None, str(e)))
        yield pd.DataFrame(out, columns=["grid", "error"])


@arrow_function("struct<grid:array<array<string>>,error:string>")
def _ragged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in (x for whole in batches for x in slices(whole)):
        out = []
        for text in batch:
            if text is None:
                out.append((None, None))
                continue
            try:
                out.append((parse_csv(text, ragged=True), None))
            except Malformed as e:
                out.append((None, str(e)))
        yield pd.DataFrame(out, columns=["grid", "error"])


def csv(source: Source, ragged: str = "error") -> Column:
    """ragged: "error" fails on records of another length, "pad" fills them up to the longest."""
    parse, width = (_ragged, greatest_width) if ragged == "pad" else (_strict, header_width)
    return let(parse(source.text), lambda p: result(render_table(p["grid"], width(p["grid"])), None, p["error"]))
