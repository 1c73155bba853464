"""Which converters accept a source, and conversion with fall-through."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.charset import decode_text
from ..functions.text import let, normalize_markdown

ATTEMPTS = "array<struct<converter:string,error:string>>"

#: Extensions and MIME types that each converter takes.
ACCEPTED = {
    "ipynb": ((".ipynb",), ()),
    "docx": ((".docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)),
    "pptx": ((".pptx",), ("application/vnd.openxmlformats-officedocument.presentationml.presentation",)),
    "pdf": ((".pdf",), ("application/pdf", "application/x-pdf")),
    "xlsx": ((".xlsx",), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",)),
    "xls": ((".xls",), ("application/vnd.ms-excel", "application/msexcel", "application/xls", "application/x-excel")),
    "csv": ((".csv",), ("application/csv", "text/csv")),
    "epub": ((".epub",), ("application/epub", "application/epub+zip", "application/x-epub+zip")),
    "rss": ((".atom", ".rss"), ("application/atom", "application/atom+xml", "application/rss", "application/rss+xml")),
    "zip": ((".zip",), ("application/zip",)),
    "html": ((".htm", ".html"), ("application/xhtml+xml", "text/html")),
    "text": (
        (".csv", ".json", ".log", ".md", ".rst", ".txt", ".toml", ".xml", ".yaml", ".yml"),
        ("application/json", "application/xml", "application/x-yaml", "application/yaml", "text/csv", "text/markdown", "text/plain", "text/xml", "text/yaml", "application/javascript"),
    ),
}
#: The converters' priorities; lower ones are tried first.
PRIORITIES = {"ipynb": 10, "docx": 12, "pptx": 13, "pdf": 14, "xlsx": 15, "xls": 16, "csv": 20, "epub": 25, "rss": 30, "zip": 35, "html": 40, "text": 100}

#: Converters that read bytes and no text.
BINARY = ("docx", "pptx", "pdf", "xlsx", "xls", "epub", "zip")


def xml_root(content: Column) -> Column:
    """The local name of an XML text's first element, in lower case; null without one."""
    text = F.regexp_replace(content.cast("string"), r"(?s)\A(?:\x{FEFF}|\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>)*", "")
    return F.nullif(F.lower(F.regexp_extract(text, r"\A<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)[\s/>]", 1)), F.lit(""))


def text_like(content: Column) -> Column:
    """Whether the first 1024 bytes are valid UTF-8 without NUL."""
    head = F.substring(content, 1, 1024)
    return F.is_valid_utf8(head.cast("string")) & ~F.contains(head, F.lit(b"\x00"))


def notebook_like(content: Column) -> Column:
    parsed = F.try_parse_json(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")))
    version = F.try_variant_get(parsed, "$.nbformat", "int")
    return (version > 0) & F.try_variant_get(parsed, "$.cells[0]", "variant").isNotNull()


def accepts(name: str, ext: Column, mime: Column, content: Column) -> Column:
    """The converter's condition: hints first, the content only where they leave it open."""
    exts, mimes = ACCEPTED[name]
    ext, mime = F.coalesce(ext, F.lit("")), F.coalesce(mime, F.lit(""))
    hinted = ext.isin(*exts) | (mime.isin(*mimes) if mimes else F.lit(False))
    if name == "ipynb":
        return F.when(hinted, True).when(mime.isin("application/json", "application/x-ipynb+json"), F.coalesce(notebook_like(content), F.lit(False))).otherwise(False)
    if name == "rss":
        open_ = (ext == ".xml") | mime.isin("application/xml", "text/xml")
        return F.when(hinted, True).when(open_, F.coalesce(xml_root(content).isin("feed", "rss"), F.lit(False))).otherwise(False)
    if name == "text":
        return F.when(hinted | mime.startswith("text/"), True).otherwise(text_like(content))
    return hinted


@dataclass(frozen=True)
class Source:
    """What a converter reads: a row's bytes, and its text by its charset. Both are null in rows that aren't for it."""

    content: Column
    text: Column


def result(markdown: Column, title: Column | None = None, error: Column | None = None) -> Column:
    """What a converter returns: a null error is success, "unsupported" isn't noted as an attempt."""
    none = F.lit(None).cast("string")
    return F.struct(markdown.alias("markdown"), (F.lit("") if title is None else title).alias("title"), (none if error is None else error).alias("error"))


def converted(rows: DataFrame, convert: Callable[[Source], Column]) -> DataFrame:
    """(source_id, markdown, title, error) of all rows by one converter; rows: source_id, content, charset."""
    read = rows.select("source_id", "content", decode_text(F.col("content"), F.col("charset") if "charset" in rows.columns else F.lit(None).cast("string")).alias("text"))
    return read.select("source_id", convert(Source(F.col("content"), F.col("text"))).alias("r")).select("source_id", "r.markdown", "r.title", "r.error")


@dataclass
class Registry:
    """Converters by name: (priority, accept(ext, mime, content), convert(Source) -> result(...))."""

    entries: list[tuple[str, float, Callable, Callable]] = field(default_factory=list)

    def register(self, name: str, priority: float, accept: Callable[[Column, Column, Column], Column], convert: Callable[[Source], Column]) -> None:
        self.entries.append((name, float(priority), accept, convert))

    def ordered(self) -> list[tuple[str, float, Callable, Callable]]:
        """By priority; equal ones as they were registered."""
        return sorted(self.entries, key=lambda e: e[1])


def candidates(entries: list[tuple[str, float, Callable]], ext: Column, mime: Column, content: Column) -> Column:
    """The names of all converters that accept a row, first to be tried first."""
    tests = [F.when(accept(ext, mime, content), F.lit(name)) for name, _, accept in entries]
    return F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")


def default_entries() -> list[tuple[str, float, Callable]]:
    ordered = sorted(PRIORITIES.items(), key=lambda x: x[1])
    return [(name, priority, lambda e, m, c, name=name: accepts(name, e, m, c)) for name, priority in ordered]


TRIES = "array<struct<converter:string,markdown:string,title:string,error:string>>"


def offered(sources: DataFrame, registry: Registry) -> DataFrame:
    """sources with the names of the converters that accept each row."""
    entries = [(n, p, a) for n, p, a, _ in registry.ordered()]
    hints = F.struct(F.col("extension").alias("e"), F.col("mime_type").alias("m"))
    return sources.withColumn("candidates", let(hints, lambda h: candidates(entries, h["e"], h["m"], F.col("content"))))


def trying(registry: Registry) -> Callable[[DataFrame], DataFrame]:
    """A step that puts `tries` in place of the content of rows (with content, charset and candidates): what each of a
    row's candidates gives, first to be tried first, up to the first that succeeds.

    One pass over the rows, without a shuffle: every converter is a column, made in order of priority, that is null in
    rows that aren't for it or that an earlier one has settled. So a Python function only gets rows of its own format
    that are still open, and nothing is made that isn't looked at. A text that is null settles nothing: it is yet to
    come.
    """
    ordered = registry.ordered()
    readers = F.array(*(F.lit(n) for n, *_ in ordered if n not in BINARY)) if registry.entries else F.array().cast("array<string>")
    decoded = decode_text(F.when(F.arrays_overlap("candidates", readers), F.col("content")), F.col("charset"))
    own = F.array_contains

    def step(rows: DataFrame) -> DataFrame:
        made = rows.select("*", decoded.alias("__text"), F.lit(False).alias("__settled"))
        for i, (name, _, _, convert) in enumerate(ordered):
            mine = own("candidates", name) & ~F.col("__settled")
            r = convert(Source(F.when(mine, F.col("content")), F.when(mine, F.col("__text"))))
            flat = lambda r, name=name: F.struct(F.lit(name).alias("converter"), r["markdown"].alias("markdown"), r["title"].alias("title"), r["error"].alias("error"))
            # what isn't deterministic isn't put into the steps after it, where it would be made again for each use
            once = F.monotonically_increasing_id() >= 0
            made = made.select("*", F.when(mine & once, flat(r)).alias(f"__r{i}"))
            settled = F.coalesce(F.col(f"__r{i}.error").isNull() & F.col(f"__r{i}.markdown").isNotNull(), F.lit(False))
            made = made.withColumn("__settled", (F.col("__settled") | settled) & once)
        tries = F.filter(F.array(*(F.col(f"__r{i}") for i in range(len(ordered)))).cast(TRIES), lambda t: t.isNotNull())
        return made.select(*(c for c in rows.columns if c != "content"), tries.alias("tries"))

    return step


def outcome(tries: Column, keep_data_uris: bool = False) -> dict[str, Column]:
    """converter, status, markdown, title, error and attempts of a row: its first success, and the errors before it.
    A row without a success has the status "failed", or "unsupported" if no attempt was noted."""
    at = F.array_position(F.transform(tries, lambda t: t["error"].isNull()), True).cast("int")
    first = F.get(tries, F.when(at > 0, at - 1))
    before = let(at, lambda n: F.slice(tries, F.lit(1), F.when(n > 0, n - 1).otherwise(F.size(tries))))
    noted = F.transform(F.filter(before, lambda t: t["error"] != "unsupported"), lambda t: F.struct(t["converter"].alias("converter"), t["error"].alias("error")))
    message = F.array_join(F.transform(noted, lambda a: F.concat(a["converter"], F.lit(": "), a["error"])), "; ")
    some = F.size(noted) > 0
    return {
        "converter": first["converter"],
        "status": F.when(at > 0, "ok").when(some, "failed").otherwise("unsupported"),
        "markdown": F.when(at > 0, normalize_markdown(F.coalesce(first["markdown"], F.lit("")), keep_data_uris)),
        "title": first["title"],
        "error": F.when(at > 0, None).when(some, message).otherwise("unsupported format"),
        "attempts": noted.cast(ATTEMPTS),
    }


def convert_sources(sources: DataFrame, registry: Registry, keep_data_uris: bool = False) -> DataFrame:
    """(source_id, converter, status, markdown, title, error, attempts) of each source, row by row.

    sources: source_id, content, mime_type, extension, charset. The candidates of a row are tried in order of priority in
    one pass, up to the first that succeeds; so nothing is joined back, and no job runs before an action.
    """
    done = trying(registry)(offered(sources, registry))
    return done.select("source_id", *(c.alias(n) for n, c in outcome(F.col("tries"), keep_data_uris).items()))
