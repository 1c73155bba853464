"""WARC archives with revisit records: write, and read back."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base32 alphabet and the end of a WARC record.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the payload's SHA-1: five hex digits are 20 bits, so four characters."""
    digits = F.sha1(payload)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def resolve_revisits(pages: DataFrame, min_payload_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_to_url).

    Of the rows with equal payloads of min_payload_bytes or more, that with the largest page_id is the response and
    the others revisit it; smaller payloads are responses. A null payload counts as empty, a null page_id as smaller
    than any other. Rows that repeat the largest page_id with the same payload are responses too.

    Only headers are shuffled by digest: a row of each digest is made before the shuffle, so a payload that a third
    of all pages share is one row from each task. Only digests that occur more than once come back to the pages, by
    page_id, where keys are even.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    headers = base.where(F.col("payload_bytes") >= min_payload_bytes).select("page_id", "url", "payload_digest")
    first = headers.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n"))
    originals = first.where("n > 1").select("payload_digest", F.col("top.page_id").alias("original"), F.col("top.url").alias("original_url"))
    revisits = headers.join(originals, "payload_digest").where("page_id < original or page_id is null and original is not null").groupBy("page_id", "payload_digest").agg(F.max("original").alias("refers_to"), F.max("original_url").alias("refers_to_url"))
    joined = base.alias("b").join(revisits.alias("r"), F.col("b.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("b.payload_digest") == F.col("r.payload_digest")), "left")
    kind = F.when(F.col("r.refers_to").isNull(), "response").otherwise("revisit")
    return joined.select("b.*", kind.alias("record_type"), "r.refers_to", "r.refers_to_url")


def _header_value(value: Column) -> Column:
    """URLs go into a header line: percent-encode what would end it."""
    return F.regexp_replace(F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), "\\A[ \\t]+|[ \\t]+\\z", "")


def warc_records(resolved: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(value): the text of each record without its end. All headers are made anew; a revisit's block is its HTTP head."""
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(RECORD_END))
    block = F.concat(http, F.when(F.col("record_type") == "response", F.col("payload")).otherwise(""))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), number, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), _header_value(F.col("url"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To-Target-URI: "), _header_value(F.col("refers_to_url")))),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return resolved.select(F.concat(lines, F.lit(RECORD_END), block).alias("value"))


def write_warc(pages: DataFrame, path: str, min_payload_bytes: int = 0, records_per_file: int = 5000, **columns: str) -> None:
    """Writes gzip-compressed archives, one or more files from each task, by Spark's own writer and committer.

    A record is text (its payload is UTF-8), so the writer's line separator can be the end of a record.
    """
    records = warc_records(resolve_revisits(pages, min_payload_bytes, **columns))
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record, found by the lengths that the headers give; holds a record at a time."""
    held = bytearray()
    more = True

    def need(n: int) -> bool:
        nonlocal more
        while more and len(held) < n:
            piece = next(chunks, None)
            if piece is None:
                more = False
            else:
                held.extend(piece)
        return len(held) >= n

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not need(seen + 1):
                if held.strip():
                    raise ValueError("a WARC record without an end of its headers")
                return
        first, *lines = held[:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        length = int(headers["content-length"])
        if not need(end + 4 + length + 4) or held[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield headers, bytes(held[end + 4 : end + 4 + length])
        del held[: end + 8 + length]


def _inflate(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file of any number of members, a piece at a time."""
    while data:
        z = zlib.decompressobj(31)
        rest = data
        while rest and not z.eof:
            piece = z.decompress(rest, size)
            rest = z.unconsumed_tail
            if piece:
                yield piece
        data = z.unused_data


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, digest_ok [, payload]) of each record.

    payload is null for revisits, as the archive has it only once; digest_ok tells of responses whether the payload
    still has its digest and length.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "digest_ok"] + ["payload"] * keep_payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()] + [pa.string()] * keep_payload

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in _parse(_inflate(content.as_py())):
                    revisit = headers["warc-type"] == "revisit"
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
                    fine = None if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest and len(payload) == size
                    rows.append((number(headers["warc-record-id"]), headers.get("warc-target-uri"), "revisit" if revisit else "response", size, digest, number(headers.get("warc-refers-to")), fine, *[None if revisit else payload.decode()] * keep_payload))
                    if len(rows) >= 1000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, digest_ok boolean" + ", payload string" * keep_payload
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)
