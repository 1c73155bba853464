"""A data source of pages: `spark.read.format("web").option("urls", "https://...\\nhttps://...").load()`."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import uris


@dataclass
class Pages(InputPartition):
    """The addresses that one task fetches."""

    urls: list[str]


class WebReader(DataSourceReader):
    def __init__(self, urls: list[str], each: int, most: int, seconds: float):
        self.urls, self.each, self.most, self.seconds = urls, each, most, seconds

    def partitions(self) -> list[Pages]:
        return [Pages(self.urls[at : at + self.each]) for at in range(0, len(self.urls), self.each)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for url in partition.urls:
            try:
                yield (url, *uris.fetch(url, self.most, self.seconds), None)
            except Exception as e:  # noqa: BLE001  what went wrong is that row's result
                yield url, None, None, f"{type(e).__name__}: {e}"


class WebPages(DataSource):
    """Rows (url, content, content_type, error), one for each address of the option urls, in lines. Nothing is fetched
    unless the option enable_http is true. Options: max_bytes of a response, timeout in seconds, and how many addresses
    a task fetches (urls_per_task). Addresses in a table go through `uris.fetch_urls`."""

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return "url string, content binary, content_type string, error string"

    def reader(self, schema: StructType) -> WebReader:
        if str(self.options.get("enable_http", "false")).lower() != "true":
            raise uris.RemoteDisabled("remote sources are disabled")
        urls = [line.strip() for line in self.options.get("urls", "").splitlines() if line.strip()]
        bad = [u for u in urls if not u.lower().startswith(("http://", "https://"))]
        if bad:
            raise uris.InvalidSource(f"not a web address: {bad[0]}")
        return WebReader(urls, max(1, int(self.options.get("urls_per_task", 16))), int(self.options.get("max_bytes", uris.HTTP_BYTES)), float(self.options.get("timeout", uris.HTTP_SECONDS)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(WebPages)
