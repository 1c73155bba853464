"""The engine: sources in, Markdown and titles out, one row a source."""

from __future__ import annotations

import io
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import WS_CHARACTERS, base_name, extension, normalize_markdown
from .operators import archives, delimited, dispatch, feeds, html, legacy_xls, notebooks, office, pdf, stream_info, trees
from .sources import uris

SOURCE_COLUMNS = ("mime_type", "extension", "charset", "filename", "local_path", "url")


@dataclass(frozen=True)
class Options:
    keep_data_uris: bool = False
    enable_http: bool = False
    max_http_bytes: int = uris.HTTP_BYTES
    pdf_backend: str = "auto"
    csv_ragged: str = "error"
    pdf_keep_unmatched: bool = False


class UnsupportedFormat(ValueError):
    pass


class FailedAttempts(ValueError):
    pass


@dataclass
class Result:
    markdown: str
    title: str

    @property
    def text_content(self) -> str:
        return self.markdown


def text(source: dispatch.Source) -> Column:
    return dispatch.result(source.text)


def placeholder(source: dispatch.Source) -> Column:
    """An archive's result is made from its entries' results, when these are known."""
    return dispatch.result(F.lit(None).cast("string"))


class Engine:
    """Converters by priority; sources are DataFrames of bytes and hints."""

    def __init__(self, spark: SparkSession, options: Options | None = None, defaults: bool = True):
        self.spark, self.options = spark, options or Options()
        pdf.check_backend(self.options.pdf_backend)
        self.extra: list[tuple] = []
        self.defaults = defaults

    def register(self, name: str, priority: float, accept: Callable[[Column, Column, Column], Column], convert: Callable[[dispatch.Source], Column]) -> None:
        """A converter of one's own: accept makes a condition of extension, MIME type and content, convert makes
        dispatch.result(markdown, title, error) of a source's content and text."""
        self.extra.append((name, priority, accept, convert))

    def registry(self) -> dispatch.Registry:
        registry = dispatch.Registry()
        o = self.options
        converters = {
            "ipynb": notebooks.notebook,
            "docx": office.docx,
            "pptx": office.pptx,
            "pdf": lambda source: pdf.pdf(source, o.pdf_backend, o.pdf_keep_unmatched),
            "xlsx": office.xlsx,
            "xls": legacy_xls.xls,
            "csv": lambda source: delimited.csv(source, o.csv_ragged),
            "epub": office.epub,
            "rss": feeds.feed,
            "zip": placeholder,
            "html": html.html,
            "text": text,
        }
        for name, priority, accept in dispatch.default_entries() if self.defaults else ():
            registry.register(name, priority, accept, converters[name])
        for entry in self.extra:
            registry.register(*entry)
        return registry

    def formats(self) -> list[str]:
        return [f"{name}\t(priority {priority:.0f})" for name, priority, *_ in self.registry().ordered()]

    def convert(self, sources: DataFrame) -> DataFrame:
        """(source_id, converter, status, markdown, title, error, attempts), from source_id (unique), content and any
        of the hints mime_type, extension, charset, filename, local_path, url.

        One pass, row by row, without a shuffle: archives are taken apart to all levels where they are met, their
        entries go through the same converters, and an archive's texts are put together from the rows that follow it.
        No job runs before an action, and nothing is kept.
        """
        registry = self.registry()
        found, tried = self._offered(sources, registry), dispatch.trying(registry)
        if not self.defaults:
            return self._outcomes(tried(found).select("source_id", "tries"))
        given = found.withColumn("is_archive", F.coalesce(F.array_contains("candidates", "zip"), F.lit(False))).drop("candidates")
        rows = trees.opened(given, archives.ArchiveLimits())
        inner = F.col("path") != ""
        named = rows.withColumns({"extension": F.when(inner, F.lower(extension(F.col("name")))).otherwise(F.col("extension")), "filename": F.when(inner, base_name(F.col("name"))).otherwise(F.col("filename"))})
        label = archives.archive_label(F.col("url"), F.col("local_path"), F.col("filename"))
        done = tried(self._offered(named, registry, "path", "name", "archive_error", "is_archive").withColumn("label", label))
        neat = lambda t: F.struct(t["converter"].alias("converter"), normalize_markdown(t["markdown"], self.options.keep_data_uris).alias("markdown"), t["title"].alias("title"), t["error"].alias("error"))
        tries = F.when(inner, F.transform("tries", neat)).otherwise(F.col("tries"))  # a source's own text is normalized in the end
        return self._outcomes(trees.joined(done.select("source_id", "path", "name", "label", "archive_error", "is_archive", tries.alias("tries"))))

    @staticmethod
    def _offered(sources: DataFrame, registry: dispatch.Registry, *others: str) -> DataFrame:
        """Sources with all hints, what lacked filled in, and their candidates."""
        hints = {c: F.col(c) for c in SOURCE_COLUMNS if c in sources.columns}
        info = stream_info.enriched(hints, F.col("content"))
        known = sources.select("source_id", "content", info.alias("info"), *others)
        return dispatch.offered(known.select("source_id", "content", *(F.col(f"info.{c}").alias(c) for c in SOURCE_COLUMNS), *others), registry)

    def _outcomes(self, rows: DataFrame) -> DataFrame:
        return rows.select("source_id", *(c.alias(n) for n, c in dispatch.outcome(F.col("tries"), self.options.keep_data_uris).items()))

    # -- one document at a time

    def convert_one(self, source: bytes | str | io.IOBase | os.PathLike, **hints: str) -> Result:
        """A path, URI, bytes or readable object; errors are raised."""
        if isinstance(source, bytes | bytearray):
            content, base = bytes(source), {}
        elif hasattr(source, "read"):
            if getattr(source, "seekable", lambda: False)():
                source.seek(0)
            content, base = source.read(), {}
        elif isinstance(source, str | os.PathLike):
            content, base = self._resolve(os.fspath(source))
        else:
            raise uris.InvalidSource(f"not a source: {type(source).__name__}")
        info = {c: (hints.get(c) or base.get(c)) for c in SOURCE_COLUMNS}
        schema = "source_id long, content binary, " + ", ".join(f"{c} string" for c in SOURCE_COLUMNS)
        given = self.spark.createDataFrame([(0, bytearray(content), *info.values())], schema)
        registry = self.registry()
        found = self._offered(given, registry).persist()
        asked = found.head().candidates
        if "zip" in asked and self.defaults:
            row = self.convert(given).head()
        else:  # a plan of what this document asks for alone
            few = dispatch.Registry([e for e in registry.ordered() if e[0] in asked])
            row = self._outcomes(dispatch.trying(few)(found).select("source_id", "tries")).head()
        found.unpersist()
        if row.status == "ok":
            return Result(row.markdown, row.title or "")
        raise (FailedAttempts if row.attempts else UnsupportedFormat)(row.error)

    def _resolve(self, source: str) -> tuple[bytes, dict]:
        kind, path, data = self.spark.range(1).select(uris.uri_kind(F.lit(source)), uris.file_uri_path(F.lit(source)), uris.data_uri(F.lit(source))).head()
        if kind == "http":
            if not self.options.enable_http:
                raise uris.RemoteDisabled("remote sources are disabled")
            content, content_type = uris.fetch(source, self.options.max_http_bytes)
            name = source.split("?")[0].split("#")[0].rstrip("/").rpartition("/")[2]
            return content, {"mime_type": content_type, "url": source, "filename": name}
        if kind == "data":
            if data.error:
                raise uris.InvalidSource(data.error)
            return bytes(data.content), {"mime_type": data.mime_type, "charset": data.charset, "url": source}
        if kind == "file" and path is None:
            raise uris.InvalidSource(f"not a local file: {source}")
        local = path if kind == "file" else source
        with open(local, "rb") as f:
            return f.read(), {"local_path": local, "filename": os.path.basename(local), "extension": os.path.splitext(local)[1]} | ({"url": source} if kind == "file" else {})
