"""Notebooks: JSON to VARIANT values, cells to Markdown, all natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, trim_ws
from .dispatch import Source, result


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def raw_text(value: Column) -> Column:
    """A string, or a list of strings put together; anything else is empty."""

    def by_kind(kind: Column) -> Column:
        parts = F.try_variant_get(value, "$", "array<string>")
        whole = F.when(kind.startswith("ARRAY<STRING"), F.when(F.forall(parts, lambda p: p.isNotNull()), F.array_join(parts, "")))
        return F.coalesce(F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(whole), F.lit(""))

    return let(F.schema_of_variant(value), by_kind)


def shown_outputs(cell: Column) -> Column:
    """What a cell's outputs print: their text, else their plain form; those without either are left out."""
    outputs = F.coalesce(F.try_variant_get(cell, "$.outputs", "array<variant>"), F.array().cast("array<variant>"))
    part = lambda o, path: trim_ws(raw_text(F.try_variant_get(o, path, "variant")))
    shown = lambda o: F.coalesce(F.nullif(part(o, "$.text"), F.lit("")), F.nullif(part(o, "$.data['text/plain']"), F.lit("")))
    return F.filter(F.transform(F.filter(outputs, is_object), shown), lambda s: s.isNotNull())


def render_cell(cell: Column, language: Column) -> Column:
    """Code cells are fenced with the language, even when empty, and what they print with `text`; other cells stay."""
    fence, feed = F.lit("```"), F.lit("\n")
    kind = raw_text(F.try_variant_get(cell, "$.cell_type", "variant"))
    source = trim_ws(raw_text(F.try_variant_get(cell, "$.source", "variant")))
    code = F.concat(fence, language, feed, source, feed, fence)
    output = let(F.array_join(shown_outputs(cell), "\n"), lambda shown: F.when(shown != "", F.concat(feed, feed, fence, F.lit("text"), feed, shown, feed, fence)).otherwise(""))
    return F.when(kind == "code", F.concat(code, output)).otherwise(source)


def render_notebook(book: Column) -> Column:
    """A notebook's cells in order, blank ones left out, from a VARIANT; null if it is no notebook: that has a version
    above zero and a list of cells, all of them objects."""
    cells = F.try_variant_get(book, "$.cells", "array<variant>")
    version = F.when(F.schema_of_variant(F.try_variant_get(book, "$.nbformat", "variant")) == "BIGINT", F.try_variant_get(book, "$.nbformat", "long"))
    language = raw_text(F.try_variant_get(book, "$.metadata.language_info.name", "variant"))
    written = let(language, lambda lang: F.array_join(F.filter(F.transform(cells, lambda c: render_cell(c, lang)), lambda x: x != ""), "\n\n"))
    return F.when((version > 0) & F.forall(cells, is_object), written)


def notebook(source: Source) -> Column:
    """Text that is no JSON, or JSON of a kind that VARIANT doesn't take (a name twice in one object, 1,000 levels), is
    malformed; other JSON that is no notebook is unsupported."""
    made = lambda b: F.struct(b.isNull().alias("malformed"), render_notebook(b).alias("markdown"))
    error = lambda r: F.when(r["malformed"], "malformed notebook").when(r["markdown"].isNull(), "unsupported")
    return let(let(F.try_parse_json(source.text), made), lambda r: result(r["markdown"], None, error(r)))
