"""Sources named by a string: paths, file, data and http URIs, classified and resolved as columns."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, extension, percent_decode

#: Default limits of remote sources.
HTTP_BYTES, HTTP_SECONDS = 32 << 20, 30
ACCEPT = "text/markdown, text/html;q=0.9, text/plain;q=0.8, */*;q=0.1"


class RemoteDisabled(ValueError):
    """An http source without leave to fetch it."""


class RemoteTooLarge(ValueError):
    """A response over the limit."""


class InvalidSource(ValueError):
    """A source that names nothing."""


def uri_kind(uri: Column) -> Column:
    """file, data or http by their prefixes, in lower case alone; anything else is a path."""
    return F.when(uri.startswith("file:"), "file").when(uri.startswith("data:"), "data").when(uri.startswith("http://") | uri.startswith("https://"), "http").otherwise("path")


def file_uri_path(uri: Column) -> Column:
    """The local path of a file URI; null if it names another host or no path. A drive letter loses its slash."""
    host = F.regexp_extract(uri, r"\Afile://([^/?#]*)", 1)
    path = F.regexp_extract(uri, r"\Afile:(?://[^/?#]*)?(/[^?#]*)", 1)
    plain = percent_decode(path)
    local = F.when(plain.rlike(r"\A/[A-Za-z]:"), F.substr(plain, F.lit(2))).otherwise(plain)
    return F.when(host.isin("", "localhost") & (path != ""), local)


def data_uri(uri: Column) -> Column:
    """struct<mime_type, charset, content, error> of a data URI: a media type in front if it has a slash, attributes,
    base64 with full padding or percent encoding. There is no default media type."""
    rest = F.substr(uri, F.lit(6))
    comma = F.instr(rest, ",")
    head, body = F.substr(rest, F.lit(1), comma - 1), F.substr(rest, comma + 1)
    tokens = F.split(head, ";", -1)
    first = F.get(tokens, F.lit(0))
    kind = F.when(F.contains(first, F.lit("/")), F.lower(F.trim(first)))
    charset = F.get(F.transform(F.filter(tokens, lambda t: F.lower(F.trim(t)).startswith("charset=")), lambda t: F.lower(F.trim(F.substring_index(t, "=", -1)))), F.lit(0))
    coded = F.exists(tokens, lambda t: F.lower(F.trim(t)) == "base64")
    strict = (F.length(body) % 4 == 0) & body.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z")
    content = F.when(coded, F.when(strict, F.unbase64(body))).otherwise(F.encode(percent_decode(body), "utf-8"))
    error = F.when(comma < 1, "a data URI without a comma").when(content.isNull(), "a data URI that can't be decoded")
    return F.struct(F.when(comma > 0, kind).alias("mime_type"), F.when(comma > 0, charset).alias("charset"), F.when(error.isNull(), content).alias("content"), error.alias("error"))


def path_hints(path: Column) -> dict[str, Column]:
    return {"local_path": path, "filename": base_name(path), "extension": extension(base_name(path))}


def url_hints(url: Column) -> dict[str, Column]:
    """The path of an http URL without query and fragment, its last element and that one's extension."""
    path = F.regexp_extract(url, r"\Ahttps?://[^/?#]*(/[^?#]*)?", 1)
    return {"path": path, "filename": base_name(path), "extension": F.lower(extension(base_name(path)))}


def local_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, content and hints) of all files that a path or pattern names; the size and path filters that follow
    are pushed to the scan. source_id is a hash of the path."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace("path", r"\Afile:(?://)?(?=/)", "")
    none = F.lit(None).cast("string")
    return files.select(F.xxhash64("path").alias("source_id"), "content", none.alias("mime_type"), extension(base_name(name)).alias("extension"), none.alias("charset"), base_name(name).alias("filename"), name.alias("local_path"), none.alias("url"))


def fetch(url: str, most: int = HTTP_BYTES, seconds: int = HTTP_SECONDS, opener: Callable | None = None) -> tuple[bytes, str | None]:
    """A response's body and media type; statuses of 400 and more, and bodies over the limit, are errors."""
    request = urllib.request.Request(url, headers={"Accept": ACCEPT})
    with (opener or urllib.request.urlopen)(request, timeout=seconds) as response:
        if getattr(response, "status", 200) >= 400:
            raise ValueError(f"status {response.status}")
        declared = response.headers.get("Content-Length")
        if declared and declared.isdigit() and int(declared) > most:
            raise RemoteTooLarge(f"{declared} bytes, over the limit of {most}")
        body = response.read(most + 1)
        if len(body) > most:
            raise RemoteTooLarge(f"over the limit of {most} bytes")
        return body, response.headers.get("Content-Type")


def fetch_urls(urls: DataFrame, enable_http: bool = False, most: int = HTTP_BYTES, opener: Callable | None = None) -> DataFrame:
    """(url, content, content_type, error), fetched where the rows are; without leave, nothing is planned at all."""
    if not enable_http:
        raise RemoteDisabled("remote sources are disabled")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, *fetch(url, most, opener=opener), None))
                except Exception as e:  # noqa: BLE001  what went wrong is that row's result
                    rows.append((url, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["url", "content", "content_type", "error"])

    return urls.select("url").mapInPandas(run, "url string, content binary, content_type string, error string")
