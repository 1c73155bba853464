"""One query for each operator, over the shared tables, and SQL that gives the same rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.arrow import arrow_function, slices
from ..functions.charset import ENCODINGS, decode_text
from ..functions.scratch import scratch_path
from ..functions.spread import few_tasks, spread
from ..functions.tables import drop_blank_rows, render_table
from ..functions.text import inline_text, normalize_markdown, truncate_data_uris
from ..operators import archives, delimited, dispatch, feeds, html, layout, legacy_xls, notebooks, office, pdf, stream_info, trees
from ..sinks import files
from ..sources import uris
from ..streaming.files import convert_stream
from . import packages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Unicode white space and the normalization rules as DuckDB's SQL has them.
SQL_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '\A{SQL_WS}+|{SQL_WS}+\z', '', 'g')"


def sql_normalize(x: str) -> str:
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[ \t]+(\n|\z)', '\1', 'g')"
    x = rf"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_full_match(l, '{SQL_WS}*#[# ]*{SQL_WS}*')), chr(10))"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_trim(x)


def ordered(position: str | Column, value: str | Column, separator: str) -> Column:
    """Values put together in order of position."""
    pairs = F.collect_list(F.struct(F.col(position).alias("p") if isinstance(position, str) else position.alias("p"), (F.col(value) if isinstance(value, str) else value).alias("v")))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["v"]), separator)


def grid(position: str, *cells: Column) -> Column:
    """Rows of cells in order of position."""
    pairs = F.collect_list(F.struct(F.col(position).alias("p"), F.array(*cells).alias("v")))
    return F.transform(F.array_sort(pairs), lambda x: x["v"])


@query(f"SELECT doc_id, {sql_normalize("text || '  ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || '###' || chr(13) || chr(10) || 'x'")} AS markdown FROM documents")
def q01_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", normalize_markdown(F.concat("text", F.lit("  \r\n\r\n\r\n###\r\nx"))).alias("markdown"))


@query("""SELECT doc_id, '![i](data:image/png;base64,' || CASE WHEN doc_id % 120 + 22 > 96 THEN '...' ELSE repeat('A', (doc_id % 120)::INT) END || ')' AS markdown FROM documents""")
def q02_truncate_data_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    link = F.concat(F.lit("![i](data:image/png;base64,"), F.expr("repeat('A', int(doc_id % 120))"), F.lit(")"))
    return docs.select("doc_id", truncate_data_uris(link).alias("markdown"))


SQL_PATH = r"regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)?', 1)"
SQL_NAME = rf"regexp_extract({SQL_PATH}, '([^/]*)/*$', 1)"


@query(rf"""SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 'text/html' END AS mime_type,
 CASE WHEN page_id % 5 = 0 THEN '.html' WHEN page_id % 5 = 3 THEN '.pdf' ELSE nullif(lower(regexp_extract({SQL_NAME}, '(\.[^./]*)$', 1)), '') END AS extension,
 CASE page_id % 5 WHEN 1 THEN 'utf-8' WHEN 2 THEN 'latin1' END AS charset,
 CASE WHEN page_id % 5 = 3 THEN 'Report.' || page_id || '.PDF' ELSE nullif({SQL_NAME}, '') END AS filename FROM pages""")
def q03_stream_info_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    path = uris.url_hints(F.col("url"))["path"]
    which = F.col("page_id") % 5
    over = {"extension": F.when(which == 0, "HTML"), "mime_type": F.when(which == 1, 'Text/HTML; charset="UTF-8"'), "charset": F.when(which == 2, " Latin1 ").otherwise(""), "filename": F.when(which == 3, F.concat(F.lit("Report."), "page_id", F.lit(".PDF")))}
    info = stream_info.merged({"local_path": path, "url": F.col("url")}, over)
    return pages.select("page_id", *(info[c].alias(c) for c in ("mime_type", "extension", "charset", "filename")))


#: What contents begin with (bytes in hexadecimal digits), and their types; None leaves it to what follows.
FRONTS = [
    ("", None), ("255044462d312e3420", "application/pdf"), ("504b0304", "application/zip"), ("0a203c3f786d6c2076657273696f6e3d22312e30223f3e", "text/xml; charset=utf-8"), ("200d0a3c48744d6c3e", "text/html; charset=utf-8"), ("6100", "application/octet-stream"), ("474946383961", "image/gif"), ("3c212d2d2078", "text/html; charset=utf-8"),
    ("252150532d41646f62652d332e30", "application/postscript"), ("feff0041", "text/plain; charset=utf-16be"), ("fffe4100", "text/plain; charset=utf-16le"), ("efbbbf41", "text/plain; charset=utf-8"), ("00000100", "image/x-icon"), ("00000200", "image/x-icon"), ("424d", "image/bmp"), ("474946383761", "image/gif"),
    ("524946462400000057454250565038", "image/webp"), ("524946462400000057454250515150", "application/octet-stream"), ("89504e470d0a1a0a", "image/png"), ("ffd8ffe0", "image/jpeg"), ("464f524d0000001041494646", "audio/aiff"), ("49443303", "audio/mpeg"), ("4f67675300", "application/ogg"), ("4d54686400000006", "audio/midi"),
    ("524946462400000041564920", "video/avi"), ("524946462400000057415645", "audio/wave"), ("000000146674797069736f6d000002006d703432", "video/mp4"), ("000000106674797069736f6d6d703431", "application/octet-stream"), ("0000000f667479706d703432000000", "application/octet-stream"), ("1a45dfa3", "video/webm"), ("00" * 34 + "4c50", "application/vnd.ms-fontobject"),
    ("00010000", "font/ttf"), ("4f54544f", "font/otf"), ("74746366", "font/collection"), ("774f4646", "font/woff"), ("774f4632", "font/woff2"), ("1f8b08", "application/x-gzip"), ("526172211a0700", "application/x-rar-compressed"), ("526172211a070100", "application/x-rar-compressed"), ("0061736d", "application/wasm"),
    ("1b5b31", "text/plain; charset=utf-8"), ("20202020", None),
]
SQL_FRONTS = "".join(f" WHEN id % {len(FRONTS)} = {i} THEN '{kind}'" for i, (_, kind) in enumerate(FRONTS) if kind)


@query(rf"""WITH s AS (SELECT 'p' AS kind, page_id AS id, html AS t FROM pages UNION ALL SELECT 'd', doc_id, text FROM documents UNION ALL SELECT 'e', event_id, props FROM events)
SELECT kind, id, CASE{SQL_FRONTS} WHEN regexp_matches(t, '^[ \t\r\n\f]*(?i:<!doctype html|<html|<body|<p|<div|<a|<b)[ >]') THEN 'text/html; charset=utf-8' ELSE 'text/plain; charset=utf-8' END AS sniffed FROM s""")
def q04_sniff_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signature in turn before the whole texts of three tables."""
    parts = (("p", "pages", "page_id", "html"), ("d", "documents", "doc_id", "text"), ("e", "events", "event_id", "props"))
    rows = None
    for kind, name, key, text in parts:
        part = read(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(text).alias("t"))
        rows = part if rows is None else rows.unionByName(part)
    front = F.unhex(F.get(F.array(*(F.lit(digits) for digits, _ in FRONTS)), (F.col("id") % len(FRONTS)).cast("int")))
    return rows.select("kind", "id", stream_info.sniffed_type(F.concat(front, F.encode("t", "utf-8"))).alias("sniffed"))


@query(rf"""SELECT page_id, {SQL_PATH} AS path, {SQL_NAME} AS filename, lower(regexp_extract({SQL_NAME}, '(\.[^./]*)$', 1)) AS extension FROM pages""")
def q05_url_path_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = uris.url_hints(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", *(c.alias(n) for n, c in hints.items()))


@query("SELECT item_id, 'text/plain' AS mime_type, 'utf-8' AS charset, text AS body, sha256(text) AS digest FROM benchmark")
def q06_data_uri_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.encode("text", "utf-8")
    coded = F.concat(F.lit("data:Text/Plain;Charset=UTF-8;Base64,"), F.regexp_replace(F.base64(plain), r"\s", ""))
    percent = F.concat(F.lit("data:text/plain;charset=utf-8,"), F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20")))
    rows = read(spark, sf_dir, "benchmark").select("item_id", uris.data_uri(F.when(F.col("item_id") % 2 == 0, coded).otherwise(percent)).alias("d"))
    return rows.select("item_id", "d.mime_type", "d.charset", F.col("d.content").cast("string").alias("body"), F.sha2("d.content", 256).alias("digest"))


#: (extension, type) by doc_id % 14, and the converter that comes first with the number of those that accept.
HINTED = [(".ipynb", None, "ipynb", 2), (".docx", None, "docx", 2), (".pptx", None, "pptx", 2), (None, "application/pdf", "pdf", 2), (".xlsx", None, "xlsx", 2), (None, "application/vnd.ms-excel", "xls", 2), (".csv", None, "csv", 2), (None, "application/epub+zip", "epub", 2), (".rss", None, "rss", 2), (".zip", None, "zip", 2), (None, "text/html", "html", 2), (".md", None, "text", 1), (None, "application/json", "text", 1), (".xml", None, "text", 1)]


#: Whether the first 1024 bytes are whole characters: the next byte, if there is one, starts a character.
SQL_TEXT = "substr(hex(encode(text)), 2049, 1) NOT IN ('8', '9', 'A', 'B')"


@query("SELECT doc_id, CASE doc_id % 14 " + " ".join(f"WHEN {i} THEN '{x[2]}'" for i, x in enumerate(HINTED)) + f" END AS converter, CASE WHEN doc_id % 14 IN (6, 10) OR doc_id % 14 < 11 AND {SQL_TEXT} THEN 2 ELSE 1 END::BIGINT AS accepted FROM documents")
def q07_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    pick = lambda k: F.get(F.array(*(F.lit(x[k]) for x in HINTED)), (F.col("doc_id") % 14).cast("int"))
    names = dispatch.candidates(dispatch.default_entries(), pick(0), pick(1), F.encode("text", "utf-8"))
    return docs.select("doc_id", F.get(names, F.lit(0)).alias("converter"), F.size(names).cast("long").alias("accepted"))


SQL_EVEN = "list_count(list_distinct(list_transform(list_filter(string_split(t, chr(10)), lambda l: l <> ''), lambda l: length(l) - length(replace(l, ',', ''))))) <= 1"


def _plain_registry() -> dispatch.Registry:
    registry = dispatch.Registry()
    registry.register("csv", 20, lambda e, m, c: dispatch.accepts("csv", e, m, c), delimited.csv)
    return registry


def _text_sources(docs: DataFrame, key: str, text: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return docs.select(F.col(key).alias("source_id"), F.encode(text, "utf-8").alias("content"), none.alias("mime_type"), F.lit(".csv").alias("extension"), none.alias("charset"), none.alias("filename"), none.alias("local_path"), none.alias("url"))


@query(f"""WITH d AS (SELECT doc_id, replace(text, '"', '') AS t FROM documents) SELECT doc_id AS source_id, CASE WHEN {SQL_EVEN} THEN 'csv' ELSE 'text' END AS converter, 'ok' AS status FROM d""")
def q08_csv_fallthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _plain_registry()
    registry.register("text", 100, lambda e, m, c: dispatch.accepts("text", e, m, c), lambda source: dispatch.result(source.text))
    sources = _text_sources(read(spark, sf_dir, "documents"), "doc_id", F.replace("text", F.lit('"'), F.lit("")))
    return dispatch.convert_sources(sources, registry).select("source_id", "converter", "status")


@query(f"""WITH d AS (SELECT doc_id, replace(text, '"', '') AS t FROM documents) SELECT status, error, count(*) AS n FROM (SELECT CASE WHEN {SQL_EVEN} THEN 'ok' ELSE 'failed' END AS status, CASE WHEN NOT ({SQL_EVEN}) THEN 'csv: wrong number of fields' END AS error FROM d) GROUP BY ALL""")
def q09_attempts_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _text_sources(read(spark, sf_dir, "documents"), "doc_id", F.replace("text", F.lit('"'), F.lit("")))
    return dispatch.convert_sources(sources, _plain_registry()).groupBy("status", "error").agg(F.count("*").alias("n"))


def sql_table(key: str, rows: str, header: str, order: str, width: int, columns: str = "") -> str:
    return f"'| {header} |' || chr(10) || '| ' || array_to_string(list_transform(range({width}), lambda i: '---'), ' | ') || ' |' || chr(10) || string_agg({rows}, chr(10) ORDER BY {order})"


@query(f"""SELECT r_name, {sql_table('', "'| ' || n_nationkey || ' | ' || replace(n_name, 'A', chr(92) || '|') || ' |'", 'key | name', 'n_nationkey', 2)} AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def q10_csv_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    rows = joined.groupBy("r_name").agg(grid("n_nationkey", F.col("n_nationkey").cast("string"), F.replace("n_name", F.lit("A"), F.lit("|"))).alias("g"))
    return rows.select("r_name", render_table(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.col("g"))).alias("markdown"))


@query(f"""SELECT '## ' || r_name || chr(10) || chr(10) || {sql_table('', "'| ' || n_nationkey || ' | ' || n_name || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE '' END || ' |'", 'key | name | ', 'n_nationkey', 3)} AS markdown, r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def q11_workbook_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    cells = F.array(F.col("n_nationkey").cast("string"), "n_name")
    ragged = F.when(F.col("n_nationkey") % 2 == 0, F.concat(cells, F.array(F.lit("even")))).otherwise(cells)
    pairs = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("p"), ragged.alias("v"))))
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy("r_name").agg(F.transform(pairs, lambda x: x["v"]).alias("g"))
    table = render_table(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.col("g")))
    return rows.select(F.concat(F.lit("## "), "r_name", F.lit("\n\n"), table).alias("markdown"), "r_name")


@query("SELECT r_name, count(*) FILTER (n_nationkey % 3 <> 0) AS kept_rows, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey) FILTER (n_nationkey % 3 <> 0), '') AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def q12_blank_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    shown = lambda c: F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(c)
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy("r_name").agg(drop_blank_rows(grid("n_nationkey", shown(F.col("n_name")), shown(F.col("n_nationkey").cast("string")))).alias("g"))
    return rows.select("r_name", F.size("g").cast("long").alias("kept_rows"), F.array_join(F.transform("g", lambda r: r[0]), ",").alias("names"))


def _xml(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _feeds(docs: DataFrame, start: Column, *items: Column, end: str) -> DataFrame:
    """(doc_id, content): a feed of a document, as bytes."""
    return docs.select(F.col("doc_id").alias("source_id"), F.encode(F.concat(start, *items, F.lit(end)), "utf-8").alias("content"))


def _plain_body() -> Column:
    return _xml(F.replace(F.replace("text", F.lit("<"), F.lit("(")), F.lit(">"), F.lit(")")))


SQL_BODY = sql_trim("replace(replace(text, '<', '('), '>', ')')")
SQL_GAP = "chr(10) || chr(10)"


@query(f"""SELECT doc_id, '# ' || source || {SQL_GAP} || '## Item ' || doc_id || {SQL_GAP} || 'Published on: day ' || doc_id || CASE WHEN {SQL_BODY} = '' THEN '' ELSE {SQL_GAP} || {SQL_BODY} END || {SQL_GAP} || '## Size' || {SQL_GAP} || '**' || length(text) || '** characters' AS markdown FROM documents""")
def q13_rss_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit("<item><title> Item "), "doc_id", F.lit("</title><pubDate>day "), "doc_id", F.lit("</pubDate><description>"), _plain_body(), F.lit("</description></item>"))
    two = F.concat(F.lit("<item><title>Size</title><description>unused</description><content:encoded><![CDATA[<p><b>"), F.length("text"), F.lit("</b> characters</p>]]></content:encoded></item>"))
    start = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>'), _xml(F.col("source")), F.lit("</title>"))
    done = dispatch.converted(_feeds(read(spark, sf_dir, "documents"), start, one, two, end="</channel></rss>"), feeds.feed)
    return done.select(F.col("source_id").alias("doc_id"), "markdown")


@query(f"""SELECT doc_id, '# ' || lang || {SQL_GAP} || '## Entry ' || doc_id || {SQL_GAP} || 'Updated on: ' || doc_id || CASE WHEN {SQL_BODY} = '' THEN '' ELSE {SQL_GAP} || {SQL_BODY} END AS markdown FROM documents""")
def q14_atom_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<summary>unused</summary><content>"), _plain_body(), F.lit("</content>"))).otherwise(F.concat(F.lit("<summary>"), _plain_body(), F.lit("</summary>")))
    entry = F.concat(F.lit("<entry><title>Entry "), "doc_id", F.lit("</title><updated>"), "doc_id", F.lit("</updated>"), body, F.lit("</entry><entry/>"))
    start = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>'), _xml(F.col("lang")), F.lit("</title>"))
    done = dispatch.converted(_feeds(read(spark, sf_dir, "documents"), start, entry, end="</feed>"), feeds.feed)
    return done.select(F.col("source_id").alias("doc_id"), "markdown")


SQL_FENCE = "chr(96) || chr(96) || chr(96)"


@query(f"""SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN {SQL_FENCE} || 'python' || chr(10) || {sql_trim('text')} || chr(10) || {SQL_FENCE} || chr(10) || chr(10) || {SQL_FENCE} || 'text' || chr(10) || 'out ' || turn || chr(10) || {SQL_FENCE} ELSE {sql_trim('text')} END, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id""")
def q15_notebook_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    code = F.col("role") == "assistant"
    shown = F.when(code, F.array(F.struct(F.lit("stream").alias("output_type"), F.array(F.lit("out "), F.col("turn").cast("string")).alias("text"))))
    cell = F.struct(F.when(code, "code").otherwise("markdown").alias("cell_type"), F.array(F.substring("text", 1, 7), F.expr("substring(text, 8)")).alias("source"), shown.alias("outputs"))
    book = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cell.alias("cell")))).alias("c"))
    whole = F.to_json(F.struct(F.lit(4).alias("nbformat"), F.struct(F.struct(F.lit("python").alias("name")).alias("language_info")).alias("metadata"), F.transform("c", lambda x: x["cell"]).alias("cells")))
    none = F.lit(None).cast("string")
    done = dispatch.converted(book.select(F.col("conv_id").alias("source_id"), F.encode(whole, "utf-8").alias("content"), none.alias("charset")), notebooks.notebook)
    return done.select(F.col("source_id").alias("conv_id"), "markdown")


@query(f"""SELECT conv_id, 'Content from zip file ' || chr(96) || 'c' || conv_id || '.zip' || chr(96) || coalesce(string_agg(chr(10) || chr(10) || '## File: ' || turn || '.txt' || chr(10) || chr(10) || {sql_trim('text')}, '' ORDER BY turn) FILTER (role <> 'system' AND {sql_trim('text')} <> ''), '') AS markdown FROM conversations GROUP BY conv_id""")
def q16_archive_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumns({"name": F.concat(F.col("turn").cast("string"), F.lit(".txt")), "md": F.when(F.col("role") == "system", " \n ").otherwise(F.col("text"))})
    none = F.lit(None).cast("string")
    return archives.render_entries(turns, "conv_id", "turn", "name", "md", archives.archive_label(F.lit(""), none, F.concat(F.lit("c"), "conv_id", F.lit(".zip"))))


@query("""WITH e AS (SELECT o_custkey, o_orderkey, (o_totalprice * 20)::BIGINT AS size FROM orders), r AS (SELECT *, count(*) OVER w AS n, sum(size) OVER w AS total FROM e WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS entry, arg_min(CASE WHEN n > 12 THEN 'entry limit' WHEN size > 8388608 THEN 'entry size limit' ELSE 'total size limit' END, o_orderkey) AS violation FROM r WHERE n > 12 OR size > 8388608 OR total > 33554432 GROUP BY o_custkey""")
def q17_archive_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read(spark, sf_dir, "orders").withColumn("size", F.round(F.col("o_totalprice") * 20).cast("long"))
    return archives.first_violation(entries, "o_custkey", "o_orderkey", "size", archives.ArchiveLimits(entries=12))


@query("""SELECT s_suppkey, '**Title:** ' || s_name || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN '**Authors:** ' || n_name || ', ' || n_regionkey || chr(10) ELSE '' END || '**Language:** ' || lower(n_name) || CASE WHEN s_suppkey % 3 = 0 THEN chr(10) || '**Date:** ' || s_suppkey ELSE '' END || chr(10) || '**Identifier:** ' || s_suppkey AS markdown FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q18_book_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    key = F.col("s_suppkey").cast("string")
    creators = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.concat(F.lit(" "), "n_name"), F.lit(" "), F.col("n_regionkey").cast("string"))).otherwise(F.array(F.lit("  ")))
    lines = archives.book_metadata(F.col("s_name"), creators, F.lower("n_name"), F.lit(" "), F.when(F.col("s_suppkey") % 3 == 0, key), F.lit(None).cast("string"), key)
    return joined.select("s_suppkey", lines.alias("markdown"))


@query("""SELECT l_orderkey AS book, string_agg(p_name, chr(10) || chr(10) ORDER BY l_linenumber, p_name) AS markdown FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 GROUP BY l_orderkey""")
def q19_book_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    spine = lines.select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("idref"))
    own = spine.select("book", "idref").distinct()
    manifest = own.where("idref % 7 <> 0").select("book", F.col("idref").alias("id"), F.concat(F.lit("OPS/./x/../"), "idref", F.lit(".xhtml")).alias("href"))
    members = own.join(part, own.idref == part.p_partkey).where("p_partkey % 5 <> 0").select("book", F.concat(F.lit("OPS/"), "idref", F.lit(".xhtml")).alias("name"), "p_name")
    return archives.spine_entries(spine, manifest, members).groupBy("book").agg(ordered("seq", "p_name", "\n\n").alias("markdown"))


@query(f"""WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role, {sql_trim('text')} AS body FROM conversations)
SELECT conv_id, string_agg('## Slide ' || n || CASE WHEN role <> 'system' THEN ': ' || role ELSE '' END || CASE WHEN body <> '' THEN chr(10) || chr(10) || body ELSE '' END || CASE WHEN n % 3 = 0 THEN chr(10) || chr(10) || '### Notes' || chr(10) || chr(10) || 'note ' || turn ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS markdown FROM s GROUP BY conv_id""")
def q20_deck_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    slide = F.struct("turn", F.when(F.col("role") != "system", F.col("role")).alias("title"), F.array("text").alias("blocks"))
    decks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(slide)).alias("s"))
    noted = F.transform("s", lambda s, i: F.struct(s["title"].alias("title"), s["blocks"].alias("blocks"), F.when((i + 1) % 3 == 0, F.concat(F.lit("note "), s["turn"].cast("string"))).alias("notes")))
    return decks.select("conv_id", office.render_slides(noted).alias("markdown"))


SQL_LAYOUT = rf"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, ' | ', '   '), chr(10))) AS line, generate_subscripts(string_split(replace(text, ' | ', '   '), chr(10)), 1) AS pos FROM documents),
c AS (SELECT doc_id, pos, {sql_trim('line')} AS line FROM l), d AS (SELECT *, list_filter(list_transform(regexp_split_to_array(line, '{SQL_WS}{{2,}}'), lambda x: {sql_trim('x')}), lambda x: x <> '') AS cells FROM c),
e AS (SELECT *, CASE WHEN line = '' THEN 0 WHEN len(cells) < 2 THEN 1 ELSE len(cells) END AS n FROM d),
f AS (SELECT *, CASE WHEN n IS DISTINCT FROM lag(n) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f),
h AS (SELECT *, count(*) OVER w AS rest, sum(len(list_filter(cells, lambda x: strlen(x) > 48))) OVER w AS big, sum(len(cells)) OVER w AS total FROM g WINDOW w AS (PARTITION BY doc_id, run ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT *, min(CASE WHEN n BETWEEN 2 AND 8 AND rest >= 2 AND 3 * big < total THEN pos END) OVER (PARTITION BY doc_id, run) AS start FROM h),
j AS (SELECT doc_id, run, min(pos) AS pos, string_agg(CASE WHEN n = 1 THEN line ELSE '| ' || array_to_string(list_transform(cells, lambda x: replace(x, '|', chr(92) || '|')), ' | ') || ' |' || CASE WHEN pos = start THEN chr(10) || '| ' || array_to_string(list_transform(range(n), lambda k: '---'), ' | ') || ' |' ELSE '' END END, chr(10) ORDER BY pos) AS block FROM i WHERE n = 1 OR (n > 1 AND pos >= start) GROUP BY doc_id, run)
SELECT d.doc_id, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY pos), '') AS markdown FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id GROUP BY d.doc_id"""


@query(SQL_LAYOUT)
def q21_pdf_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("page", F.replace("text", F.lit(" | "), F.lit("   ")))
    return layout.layout_markdown(docs, "page").select("doc_id", "markdown")


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'https://example.com/' || c_nationkey WHEN 1 THEN 'ppt/media/' || c_nationkey || '.png' WHEN 2 THEN 'ppt/slides/a/' || n_name WHEN 3 THEN 'abs/' || c_nationkey ELSE '../x' END AS target FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q22_relationship_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    key, which = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 5
    target = F.when(which == 0, F.concat(F.lit("https://example.com/"), key)).when(which == 1, F.concat(F.lit("../media//./"), key, F.lit(".png"))).when(which == 2, F.concat(F.lit("./a/b/../"), "n_name")).when(which == 3, F.concat(F.lit("/abs/"), key)).otherwise("../../../x")
    return rows.select("c_custkey", archives.relationship_target(F.lit("ppt/slides"), target).alias("target"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '# ' WHEN 1 THEN repeat('#', (p_size % 6 + 1)::INT) || ' ' ELSE '' END || replace(p_name, ' ', ' ') || chr(10) || lower(p_type) AS markdown FROM part""")
def q23_docx_paragraph_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = F.col("p_partkey") % 4
    style = F.when(which == 0, "SubTitle").when(which == 1, F.concat(F.lit("Heading"), (F.col("p_size") % 6 + 1).cast("string"))).when(which == 2, "Heading 1").otherwise("Normal")
    text = inline_text(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("\u00a0 \t")), F.lit(" \n\t"), F.lower("p_type"), F.lit(" ")))
    return read(spark, sf_dir, "part").select("p_partkey", office.styled_paragraph(style, text).alias("markdown"))


SQL_TITLE = rf"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"


@query(f"""SELECT page_id, {sql_trim("replace(replace(replace(replace(replace(" + SQL_TITLE + ", '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')")} AS title FROM pages""")
def q24_html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html.title_of(F.col("html")).alias("title"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g') AS html FROM pages""")
def q25_html_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html.prune(F.col("html")).alias("html"))


SQL_NAV = r"""regexp_extract_all(regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1), '<li><a href="([^"]*)">(.*?)</a></li>'"""


@query(f"""SELECT page_id, array_to_string(list_transform(list_zip({SQL_NAV}, 2), {SQL_NAV}, 1)), lambda x: '- [' || x[1] || '](' || x[2] || ')'), chr(10)) AS links FROM pages WHERE html LIKE '%<nav>%'""")
def q26_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").where(F.contains("html", F.lit("<nav>")))
    nav = F.concat(F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1))
    return pages.select("page_id", html.render_html(nav)["markdown"].alias("links"))


def sql_escaped(x: str) -> str:
    """Text as Markdown: a backslash before what would mean something."""
    return rf"regexp_replace({x}, '([\\`*_\[\]])', '\\\1', 'g')"


@query(f"""SELECT p_partkey, p_name AS title, '## ' || {sql_escaped('p_name')} || {SQL_GAP} || 'A **' || {sql_escaped('p_brand')} || '** of *' || {sql_escaped('lower(p_type)')} || '*, see [size ' || p_size || '](/parts/' || p_partkey || ')' || {SQL_GAP} || '- first' || chr(10) || '- ' || {sql_escaped('p_brand')} || {SQL_GAP} || '1. one' || chr(10) || '2. two' || {SQL_GAP} || '> kept' || {SQL_GAP} || {SQL_FENCE} || chr(10) || p_type || chr(10) || {SQL_FENCE} AS markdown FROM part""")
def q27_html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spread(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    x = lambda c: _xml(F.col(c) if isinstance(c, str) else c)
    page = F.concat(
        F.lit("<html><head><title>"), x("p_name"), F.lit("</title><style>p {}</style></head><body><h2>"), x("p_name"), F.lit("</h2><script>var a;</script><p>A <b>"), x("p_brand"), F.lit("</b> of <em>"), x(F.lower("p_type")),
        F.lit("</em>, see <a href='/parts/"), "p_partkey", F.lit("'>size "), "p_size", F.lit("</a></p><ul><li>first<li>"), x("p_brand"), F.lit("</ul><ol><li>one</li><li>two</li></ol><blockquote>kept</blockquote><pre>"), x("p_type"), F.lit("</pre></body></html>"),
    )
    done = dispatch.converted(parts.select(F.col("p_partkey").alias("source_id"), F.encode(page, "utf-8").alias("content")), html.html)
    return done.select(F.col("source_id").alias("p_partkey"), "title", normalize_markdown(F.col("markdown")).alias("markdown"))


SQL_PAGE_REST = r"regexp_replace(html, '(?s)^.*?</nav>', '')"
SQL_PAGE_PARTS = rf"regexp_split_to_array({SQL_PAGE_REST}, '<!--.*?-->|</?(?:div|article|p|footer|body|html)[^>]*>|</h1>')"


def sql_page_text(x: str) -> str:
    """A stretch of a page without its tags, references read, in one line."""
    for reference, sign in (("&copy;", "'©'"), ("&middot;", "'·'"), ("&quot;", "chr(34)")):
        x = f"replace({x}, '{reference}', {sign})"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&amp;?', '&', 'g'), '[ \t\n\f\r]+', ' ', 'g'))"


@query(f"""WITH s AS (SELECT page_id, unnest({SQL_PAGE_PARTS}) AS s, generate_subscripts({SQL_PAGE_PARTS}, 1) AS i FROM pages),
t AS (SELECT page_id, i, contains(s, '<h1>') AS heading, bool_or(contains(s, '<b>')) OVER (PARTITION BY page_id ORDER BY i) AS bold, {sql_page_text("s")} AS text FROM s),
b AS (SELECT page_id, string_agg(CASE WHEN heading THEN '# ' || e WHEN bold THEN '**' || e || '**' ELSE e END, {SQL_GAP} ORDER BY i) AS body FROM (SELECT *, {sql_escaped("text")} AS e FROM t WHERE text <> '') GROUP BY page_id),
n AS (SELECT page_id, array_to_string(list_transform(list_zip({SQL_NAV}, 2), {SQL_NAV}, 1)), lambda x: '- [' || x[1] || '](' || x[2] || ')'), chr(10)) AS nav, {sql_trim(sql_page_text(SQL_TITLE))} AS title FROM pages)
SELECT page_id, title, {sql_normalize(f"nav || {SQL_GAP} || body")} AS markdown, NULL::VARCHAR AS error FROM n JOIN b USING (page_id)""")
def q40_pages_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The real pages, in which bold text is opened in paragraphs and never closed."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("source_id"), F.encode("html", "utf-8").alias("content"))
    done = dispatch.converted(pages, html.html)
    return done.select(F.col("source_id").alias("page_id"), "title", normalize_markdown(F.col("markdown")).alias("markdown"), "error")


#: Misnested, unclosed and misplaced tags around a part's name (N), brand (B) and type (T), and what they mean.
MISNESTED = [
    ("<p>N <b>see <i>B</b> or</i> T", "N **see *B*** *or* T"),
    ("<b>1 N<p>B</b> T</p>", "**1 N**|**B** T"),
    ("<table><b><tr><td>N</td></tr>B</table>T", "**B**|N|**T**"),
    ("<a href=/1>N<a href=/2>B</a>", "[N](/1)[B](/2)"),
    ("<ul><li>N<li>B<ol><li>T</ol></ul>", "- N/- B/  1. T"),
    ("<table>B<tr><td>N<td>T<tr><th>B</table>", "B|N T|B"),
    ("<h2>N<h3>B</h2>T", "## N|### B|T"),
    ("<p>N</p></p>B<textarea><p>hidden</textarea><div>T", "N|B|T"),
    ("<svg><g>N<p>B</svg>", "N|B"),
    ("<i>" * 300 + "N<p>B", "*N*|*B*"),
    ("<dl><dt>N<dd>B<dt>T</dl>", "N|B|T"),
    ("<script><!--<script></script>--></script>N<!--><p>B<!-- c --!>", "N|B"),
    ("<b><p>N<p>B</b>T", "**N**|**B**T"),
    ("<template><td>N</template><td>B</td>", "B"),
]


def _misnested_sql() -> str:
    def written(form: str) -> str:
        for sign, value in (("|", SQL_GAP), ("/", "chr(10)")):
            form = form.replace("](/", "](\0") if sign == "|" else form
            form = form.replace(sign, f"' || {value} || '")
        for letter, column in (("N", sql_escaped("p_name")), ("B", sql_escaped("p_brand")), ("T", sql_escaped("lower(p_type)"))):
            form = form.replace(letter, f"' || {{{letter}}} || '")
        for letter, column in (("N", sql_escaped("p_name")), ("B", sql_escaped("p_brand")), ("T", sql_escaped("lower(p_type)"))):
            form = form.replace(f"{{{letter}}}", column)
        return "'" + form.replace("\0", "/") + "'"

    return "SELECT p_partkey, CASE p_partkey % " + str(len(MISNESTED)) + "".join(f" WHEN {i} THEN {written(form)}" for i, (_, form) in enumerate(MISNESTED)) + " END AS markdown FROM part"


@query(_misnested_sql())
def q41_html_misnested(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.get(F.array(*(F.lit(form) for form, _ in MISNESTED)), (F.col("p_partkey") % len(MISNESTED)).cast("int"))
    for letter, column in (("N", F.col("p_name")), ("B", F.col("p_brand")), ("T", F.lower("p_type"))):
        # letters stand between marks that no name has, so that no name is taken for a letter
        forms = F.regexp_replace(forms, f"(?<![A-Za-z\x02]){letter}(?![A-Za-z\x03])", F.concat(F.lit("\x02"), F.regexp_replace(_xml(column), r"([\\$])", r"\\$1"), F.lit("\x03")))
    page = F.concat(F.lit("<!doctype html>"), F.translate(forms, "\x02\x03", ""))
    parts = spread(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"))
    done = dispatch.converted(parts.select(F.col("p_partkey").alias("source_id"), F.encode(page, "utf-8").alias("content")), html.html)
    return done.select(F.col("source_id").alias("p_partkey"), normalize_markdown(F.col("markdown")).alias("markdown"))


LISTED = [".ipynb", ".docx", ".pptx", ".pdf", ".xlsx", ".xls", ".csv", ".epub", ".rss", ".zip", ".html", ".txt", ".bin"]


@query("""SELECT position, name || chr(9) || '(priority ' || priority || ')' AS line, (SELECT count(*) FROM pages WHERE page_id % 13 = position OR (name = 'text' AND page_id % 13 = 6)) AS accepted FROM (VALUES (0::BIGINT, 'ipynb', 10), (1, 'docx', 12), (2, 'pptx', 13), (3, 'pdf', 14), (4, 'xlsx', 15), (5, 'xls', 16), (6, 'csv', 20), (7, 'epub', 25), (8, 'rss', 30), (9, 'zip', 35), (10, 'html', 40), (11, 'text', 100)) AS t(position, name, priority)""")
def q28_list_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The converters in order, and how many of the pages each would take by an extension that is dealt to them in turn."""
    none = F.lit(None).cast("string")
    ext = F.get(F.array(*map(F.lit, LISTED)), (F.col("page_id") % len(LISTED)).cast("int"))
    entries = sorted(dispatch.default_entries(), key=lambda e: (e[1], e[0]))
    pages = read(spark, sf_dir, "pages").select(ext.alias("ext"))
    counts = pages.agg(*(F.count(F.when(accept(F.col("ext"), none, F.lit(b"\x00")), 1)).alias(name) for name, _, accept in entries))
    lines = F.array(*(F.struct(F.lit(i).cast("long").alias("position"), F.lit(f"{name}\t(priority {priority:.0f})").alias("line"), F.col(name).alias("accepted")) for i, (name, priority, _) in enumerate(entries)))
    return counts.select(F.inline(lines))


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {SQL_TEXT} WHEN 3 THEN true ELSE false END AS accepted FROM documents")
def q29_text_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.encode("text", "utf-8")
    which = F.col("doc_id") % 4
    content = F.when(which == 0, plain).when(which == 1, F.concat(F.lit(b"a\x00"), plain)).when(which == 2, F.concat(F.encode(F.lit("x" * 1023), "utf-8"), F.encode(F.lit("é"), "utf-8"))).otherwise(F.lit(b""))
    none = F.lit(None).cast("string")
    return read(spark, sf_dir, "documents").select("doc_id", dispatch.accepts("text", none, none, content).alias("accepted"))


@query(r"SELECT doc_id, regexp_replace(text, '[^\x{20}-\x{7E}\x{A0}-\x{FF}]', '?', 'g') AS decoded FROM documents")
def q30_decode_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    latin = F.regexp_replace("text", r"[^\x{20}-\x{7E}\x{A0}-\x{FF}]", "?")
    label = F.get(F.array(*map(F.lit, ("windows-1252", "latin1", " ISO-8859-1 "))), (F.col("doc_id") % 3).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", decode_text(F.encode(latin, "ISO-8859-1"), label).alias("decoded"))


def _workbook(rows: pd.DataFrame) -> pd.DataFrame:
    """An .xlsx package of one region's nations."""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    lines = [("key", "name"), *((int(k), n) for k, n in sorted(zip(rows["n_nationkey"], rows["n_name"], strict=True)))]
    sheet = "".join("<row>" + "".join(map(cell, line)) + "</row>" for line in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{rows["r_name"].iloc[0]}" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{sheet}</sheetData></worksheet>")
    return pd.DataFrame({"source_id": [int(rows["r_regionkey"].iloc[0])], "content": [out.getvalue()]})


@query(f"""SELECT r_regionkey::BIGINT AS source_id, '## ' || r_name || chr(10) || chr(10) || {sql_table('', "'| ' || n_nationkey || ' | ' || n_name || ' |'", 'key | name', 'n_nationkey', 2)} AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def q31_binary_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    files = nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy("r_regionkey").applyInPandas(_workbook, "source_id long, content binary")
    return dispatch.converted(files, office.xlsx).select("source_id", "markdown")


def built(rows: DataFrame, key: str, build: Callable[..., bytes], *columns: str, tasks: int | None = None) -> DataFrame:
    """(source_id, content): a file of each row, made of the given columns."""

    @arrow_function("binary")
    def make(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            for rows_ in slices(zip(*batch, strict=True)):
                yield pd.Series([build(*values) for values in rows_], dtype=object)

    dealt = spread(rows.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(columns))), tasks)
    return dealt.select(F.col("__key").alias("source_id"), make(*(f"__{i}" for i in range(len(columns)))).alias("content"))


SQL_RULE = "chr(10) || '| --- | --- |' || chr(10)"


@query(f"""SELECT p_partkey AS source_id, p_name AS title, '## ' || p_name || {SQL_GAP} || 'Kind [' || p_type || '](https://parts.example/' || p_partkey || ')' || {SQL_GAP} || '| field | value |' || {SQL_RULE} || '| brand | ' || p_brand || ' |' || chr(10) || '| size | ' || p_size || ' |' AS markdown FROM part""")
def q32_binary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda key, name, brand, kind, size: packages.docx([("Heading2", [name]), (None, []), (None, ["Kind ", (kind, f"https://parts.example/{key}")]), [["field", "value"], ["brand", brand], ["size", str(size)]]])
    files = built(read(spark, sf_dir, "part"), "p_partkey", build, "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return dispatch.converted(files, office.docx).select("source_id", "title", "markdown")


@query(f"""SELECT s_suppkey AS source_id, s_name AS title, '## Slide 1: ' || s_name || {SQL_GAP} || 'nation ' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN {SQL_GAP} || '### Notes' || {SQL_GAP} || 'ask for ' || s_suppkey ELSE '' END || {SQL_GAP} || '## Slide 2' || {SQL_GAP} || '[more](https://suppliers.example/' || s_suppkey || ')' || {SQL_GAP} || '| what | which |' || {SQL_RULE} || '| key | ' || s_suppkey || ' |' AS markdown FROM supplier""")
def q33_binary_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda key, name, nation: packages.pptx([{"title": name, "texts": [f"nation {nation}"], "footer": "left out", "notes": None if key % 3 else f"ask for {key}"}, {"texts": [("more", f"https://suppliers.example/{key}")], "table": [["what", "which"], ["key", str(key)]]}])
    files = built(read(spark, sf_dir, "supplier"), "s_suppkey", build, "s_suppkey", "s_name", "s_nationkey")
    return dispatch.converted(files, office.pptx).select("source_id", "title", "markdown")


@query(f"""SELECT c_custkey AS source_id, '## Card' || {SQL_GAP} || '| name | segment |' || {SQL_RULE} || '| ' || c_name || ' | ' || c_mktsegment || ' |' || chr(10) || '| ' || c_custkey || '.5 | ' || strftime(DATE '2023-03-15' + (c_custkey % 100)::INT, '%Y-%m-%d') || ' |' || chr(10) || '| ' || c_nationkey || ' |  |' AS markdown FROM customer""")
def q34_legacy_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda key, name, nation, segment: packages.xls("Card", [["name", "segment"], [], [name, segment], [int(key) + 0.5, (45000.0 + key % 100, "date")], [int(nation)]])
    files = built(read(spark, sf_dir, "customer"), "c_custkey", build, "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return dispatch.converted(files, legacy_xls.xls).select("source_id", "markdown")


@query(f"""SELECT c_custkey AS source_id, '## Card' || {SQL_GAP} || '| day | share | worth | open |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| ' || strftime(DATE '2023-03-15' + (c_custkey % 100)::INT, '%Y-%m-%d') || ' | ' || printf('%.1f', (c_custkey % 8) * 12.5) || '% | ' || CASE WHEN c_custkey >= 1000 THEN (c_custkey // 1000) || ',' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END || '.25 | ' || CASE WHEN c_custkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END || ' |' AS markdown FROM customer""")
def q35_workbook_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda key, nation: packages.xlsx({"Card": [["day", "share", "worth", "open"], [(45000 + key % 100, "yyyy-mm-dd"), (key % 8 / 8, "0.0%"), (key + 0.25, "#,##0.00"), bool(key % 2 == 0)]]})
    files = built(read(spark, sf_dir, "customer"), "c_custkey", build, "c_custkey", "c_nationkey")
    return dispatch.converted(files, office.xlsx).select("source_id", "markdown")


@query(f"""SELECT p_partkey AS source_id, p_name || {SQL_GAP} || '| field | value |' || {SQL_RULE} || '| brand | ' || p_brand || ' |' || chr(10) || '| size | (' || p_size || ') |' AS markdown FROM part""")
def q36_binary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda key, name, brand, size: packages.pdf([name, "", "field   value", f"brand   {brand}", f"size   ({size})"], key % 2 == 0)
    files = built(read(spark, sf_dir, "part"), "p_partkey", build, "p_partkey", "p_name", "p_brand", "p_size")
    return dispatch.converted(files, pdf.pdf).select("source_id", "markdown")


@query(f"""SELECT s_suppkey AS source_id, s_name AS title, '**Title:** ' || s_name || chr(10) || '**Authors:** N' || s_nationkey || chr(10) || '**Language:** en' || {SQL_GAP} || '# Nation ' || s_nationkey || {SQL_GAP} || 'Key **' || s_suppkey || '**' || {SQL_GAP} || 'The end' AS markdown FROM supplier""")
def q37_binary_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda key, name, nation: packages.epub({"title": name, "creator": f"N{nation}", "language": "en"}, {"one.xhtml": f"<html><body><h1>Nation {nation}</h1><p>Key <b>{key}</b></p></body></html>", "two.xhtml": "<p>The end</p>"}, ("gone.xhtml",))
    files = built(read(spark, sf_dir, "supplier"), "s_suppkey", build, "s_suppkey", "s_name", "s_nationkey")
    return dispatch.converted(files, office.epub).select("source_id", "title", "markdown")


@query(f"""SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 5 = 4 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN s_suppkey % 5 = 4 THEN 'zip: archive limit: recursion depth limit of 4' END AS error, CASE WHEN s_suppkey % 5 < 4 THEN 'Content from zip file `s' || s_suppkey || '.zip`' || {SQL_GAP} || '## File: list.csv' || {SQL_GAP} || '| name | nation |' || {SQL_RULE} || '| ' || s_name || ' | ' || s_nationkey || ' |' || {SQL_GAP} || '## File: in/deep.zip' || {SQL_GAP} || 'Content from zip file `deep.zip`' || {SQL_GAP} || '## File: x.md' || {SQL_GAP} || '# inner ' || s_suppkey || {SQL_GAP} || '## File: note.txt' || {SQL_GAP} || 'n ' || s_suppkey END AS markdown FROM supplier""")
def q38_nested_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(key: int, name: str, nation: int) -> bytes:
        inner = packages.zipped({"x.md": f"# inner {key}"})
        for _ in range(4 * (key % 5 == 4)):
            inner = packages.zipped({"deeper.zip": inner})
        return packages.zipped({"list.csv": f"name,nation\n{name},{nation}", "in/deep.zip": inner, "raw.bin": b"\x00\x01", "note.txt": f" n {key} \n", "empty.txt": ""})

    suppliers = read(spark, sf_dir, "supplier")
    files = built(suppliers, "s_suppkey", build, "s_suppkey", "s_name", "s_nationkey", tasks=few_tasks(spark))
    named = files.withColumn("filename", F.concat(F.lit("s"), "source_id", F.lit(".zip")))
    return Engine(spark).convert(named).select("source_id", "status", "error", "markdown")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ipynb' WHEN 2 THEN 'rss' WHEN 3 THEN 'rss' ELSE 'text' END AS converter FROM part""")
def q39_content_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that leave it open: the content tells notebooks from other JSON and feeds from other XML."""
    which = F.col("p_partkey") % 6
    cells = F.concat(F.lit('{"nbformat": 4, "cells": [{"cell_type": "markdown", "source": "'), "p_name", F.lit('"}]}'))
    texts = F.array(cells, F.concat(F.lit('{"cells": ["'), "p_name", F.lit('"]}')), F.concat(F.lit("﻿<?xml version='1.0'?><!-- <x> --><rss><channel><title>"), "p_name", F.lit("</title></channel></rss>")), F.concat(F.lit('<!DOCTYPE feed><a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>'), "p_name", F.lit("</a:title></a:feed>")), F.concat(F.lit("<list><feed>"), "p_name", F.lit("</feed></list>")), F.col("p_name"))
    extension = F.when(which.between(2, 4), ".xml")
    mime = F.when(which < 2, "application/json").when(which == 5, "text/xml")
    names = dispatch.candidates(dispatch.default_entries(), extension, mime, F.encode(F.get(texts, which.cast("int")), "utf-8"))
    return read(spark, sf_dir, "part").select("p_partkey", F.get(names, F.lit(0)).alias("converter"))


SQL_DAY = "(DATE '2023-03-15' + (k % 5000)::INT)"
SQL_CLOCK = "(TIMESTAMP '2000-01-01 00:00:00' + to_seconds(1800 * (k % 48)))"
#: Format codes, a number for each key k, and SQL for what shows.
SHOWN: list[tuple[str, Callable[[int], float], str]] = [
    ("000000", lambda k: k, "lpad(k::VARCHAR, 6, '0')"),
    ("#,##0", lambda k: k * 1234, "format('{:,}', k * 1234)"),
    ("0.00", lambda k: k / 4, "printf('%.2f', k / 4)"),
    ("0.0", lambda k: k / 4, "printf('%.1f', floor(k * 2.5 + 0.5)::DOUBLE / 10)"),
    ("0%", lambda k: k % 8 / 8, "floor(k % 8 * 12.5 + 0.5)::INT || '%'"),
    ("0.000%", lambda k: k % 8 / 8, "printf('%.3f', (k % 8 * 12.5)::DOUBLE) || '%'"),
    ("#,##0,", lambda k: k * 1000 + 500, "format('{:,}', k + 1)"),
    ('0.0,,"M"', lambda k: k * 100_000, "printf('%.1f', k / 10) || 'M'"),
    ("[h]:mm", lambda k: k / 24, "k || ':00'"),
    ("[mm]:ss", lambda k: k / 1440, "CASE WHEN k < 10 THEN '0' ELSE '' END || k || ':00'"),
    ("[s]", lambda k: k / 86400, "k::VARCHAR"),
    ("yyyy-mm-dd", lambda k: 45000 + k % 5000, f"strftime({SQL_DAY}, '%Y-%m-%d')"),
    ("m/d/yy", lambda k: 45000 + k % 5000, f"month({SQL_DAY}) || '/' || day({SQL_DAY}) || strftime({SQL_DAY}, '/%y')"),
    ("d-mmm-yyyy", lambda k: 45000 + k % 5000, f"day({SQL_DAY}) || strftime({SQL_DAY}, '-%b-%Y')"),
    ("dddd, mmmm dd", lambda k: 45000 + k % 5000, f"strftime({SQL_DAY}, '%A, %B %d')"),
    ('ddd mmmmm yyyy"y"', lambda k: 45000 + k % 5000, f"strftime({SQL_DAY}, '%a ') || left(strftime({SQL_DAY}, '%B'), 1) || strftime({SQL_DAY}, ' %Yy')"),
    ("h:mm AM/PM", lambda k: k % 48 / 48, f"strftime({SQL_CLOCK}, '%-I:%M %p')"),
    ("hh:mm:ss", lambda k: k % 86400 / 86400, "strftime(TIMESTAMP '2000-01-01 00:00:00' + to_seconds(k % 86400), '%H:%M:%S')"),
    ("mm:ss.0", lambda k: k / 864_000, "lpad((k // 600 % 60)::VARCHAR, 2, '0') || ':' || lpad((k // 10 % 60)::VARCHAR, 2, '0') || '.' || k % 10"),
    ("yyyy-mm-dd hh:mm", lambda k: 45000 + k % 5000 + k % 48 / 48, f"strftime({SQL_DAY}, '%Y-%m-%d ') || strftime({SQL_CLOCK}, '%H:%M')"),
    ('0;(0);"none"', lambda k: k % 3 - 1, "CASE k % 3 WHEN 0 THEN '(1)' WHEN 1 THEN 'none' ELSE '1' END"),
    ("0;[Red](0)", lambda k: -k, "CASE WHEN k = 0 THEN '0' ELSE '(' || k || ')' END"),
    ('[<100]"low "0;[>=1000]"high "0;"mid "0', lambda k: k, "CASE WHEN k < 100 THEN 'low ' WHEN k >= 1000 THEN 'high ' ELSE 'mid ' END || k"),
    ("0.0;-0.0", lambda k: -k / 4, "CASE WHEN k = 0 THEN '' ELSE '-' END || printf('%.1f', floor(k * 2.5 + 0.5)::DOUBLE / 10)"),
    ('"<"# ?/?">"', lambda k: k / 2, "CASE WHEN k % 2 = 0 THEN '<' || k // 2 || '    >' ELSE '<' || CASE WHEN k > 1 THEN (k // 2)::VARCHAR ELSE '' END || ' 1/2>' END"),
    ('"<"?/?">"', lambda k: k % 4 + 0.5, "'<' || 2 * (k % 4) + 1 || '/2>'"),
    ('"<"# ??/16">"', lambda k: k % 16 / 16 + 1, "CASE WHEN k % 16 = 0 THEN '<1      >' ELSE '<1 ' || lpad((k % 16)::VARCHAR, 2, ' ') || '/16>' END"),
    ("0.000000E+00", lambda k: k * 1000.0, "CASE WHEN k = 0 THEN '0.000000E+00' ELSE printf('%.6E', (k * 1000)::DOUBLE) END"),
    ("##0.00000E+0", lambda k: k, "CASE WHEN k < 1000 THEN printf('%.5f', k::DOUBLE) || 'E+0' ELSE printf('%.5f', k / 1000) || 'E+3' END"),
    ("000-00-0000", lambda k: 100_000_000 + k, "'100-' || lpad((k // 10000)::VARCHAR, 2, '0') || '-' || lpad((k % 10000)::VARCHAR, 4, '0')"),
    ("(###) ###-####", lambda k: 5_550_000_000 + k, "'(555) ' || lpad((k // 10000)::VARCHAR, 3, '0') || '-' || lpad((k % 10000)::VARCHAR, 4, '0')"),
    ("[$€-407]#,##0.00", lambda k: k / 4, "'€' || format('{:,.2f}', k / 4)"),
    ("$#,##0.00;($#,##0.00)", lambda k: k / 4 - 10, "CASE WHEN k < 40 THEN '($' || format('{:,.2f}', 10 - k / 4) || ')' ELSE '$' || format('{:,.2f}', k / 4 - 10) END"),
    ('General" kg"', lambda k: k / 2, "k // 2 || CASE WHEN k % 2 = 1 THEN '.5' ELSE '' END || ' kg'"),
    ("#.##", lambda k: k / 4, "CASE WHEN k < 4 THEN '' ELSE (k // 4)::VARCHAR END || CASE k % 4 WHEN 0 THEN '.' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END"),
    ('"<"0.0?">"', lambda k: k / 4, "'<' || k // 4 || CASE k % 4 WHEN 0 THEN '.0 ' WHEN 1 THEN '.25' WHEN 2 THEN '.5 ' ELSE '.75' END || '>'"),
    ("\\x0\\y", lambda k: k, "'x' || k || 'y'"),
    ('*-0"kg"', lambda k: k, "k || 'kg'"),
    ("00000.000", lambda k: k / 8, "lpad(printf('%.3f', k / 8), 9, '0')"),
    ('[=1]"one";[=0]"nil";0', lambda k: k % 3, "CASE k % 3 WHEN 0 THEN 'nil' WHEN 1 THEN 'one' ELSE '2' END"),
]
SQL_SHOWN = " || ".join(f"chr(10) || '| f{i} | ' || {shown.replace('k / ', 'k::DOUBLE / ')} || ' |'" for i, (_, _, shown) in enumerate(SHOWN))


def _shown_rows(key: int) -> list[list]:
    return [["code", "shown"], *([f"f{i}", (value(int(key)), code)] for i, (code, value, _) in enumerate(SHOWN))]


@query(f"""WITH p AS (SELECT p_partkey AS k FROM part) SELECT k AS source_id, '## Card' || {SQL_GAP} || '| code | shown |' || chr(10) || '| --- | --- |' || {SQL_SHOWN} AS markdown FROM p""")
def q42_number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each part, with a number in each of the formats of SHOWN."""
    files = built(read(spark, sf_dir, "part"), "p_partkey", lambda key, _: packages.xlsx({"Card": _shown_rows(key)}), "p_partkey", "p_size")
    return dispatch.converted(files, office.xlsx).select("source_id", "markdown")


@query(f"""WITH p AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS source_id, '## Card' || {SQL_GAP} || '| code | shown |' || chr(10) || '| --- | --- |' || {SQL_SHOWN.replace("'€'", "'E'")} AS markdown FROM p""")
def q43_legacy_number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in legacy workbooks, one for each supplier."""
    rows = lambda key: [[(v[0], v[1].replace("€", "E")) if isinstance(v, tuple) else v for v in row] for row in _shown_rows(key)]
    files = built(read(spark, sf_dir, "supplier"), "s_suppkey", lambda key, _: packages.xls("Card", rows(key)), "s_suppkey", "s_nationkey")
    return dispatch.converted(files, legacy_xls.xls).select("source_id", "markdown")


#: Some bytes in each encoding (in hexadecimal digits) and what they say.
PROBES = {
    "utf-8": ("c3a9e282ac", "é€"), "ibm866": ("8fe0a8", "При"), "iso-8859-2": ("b3f3", "łó"), "iso-8859-3": ("a6b1", "Ĥħ"), "iso-8859-4": ("b6fe", "ļū"), "iso-8859-5": ("bfe0d8", "При"), "iso-8859-6": ("c8c7c8", "باب"), "iso-8859-7": ("a4c1", "€Α"),
    "iso-8859-8": ("e0e1a1", "אב�"), "iso-8859-8-i": ("f9fa", "שת"), "iso-8859-10": ("bdfe", "―þ"), "iso-8859-13": ("b4d0", "“Š"), "iso-8859-14": ("a1f0", "Ḃŵ"), "iso-8859-15": ("a4bd", "€œ"), "iso-8859-16": ("a4aa", "€Ș"),
    "koi8-r": ("f0d2c9", "При"), "koi8-u": ("a4aebe", "єўЎ"), "macintosh": ("dba5", "€•"), "windows-874": ("80a1dbff", "€ก��"), "windows-1250": ("9cb3", "śł"), "windows-1251": ("cff0e898", "При\x98"), "windows-1252": ("8081e9", "€\x81é"), "windows-1253": ("c1aae1", "Α�α"),
    "windows-1254": ("d0fd", "Ğı"), "windows-1255": ("e0cad9", "אֺ�"), "windows-1256": ("c8fd", "ب\u200e"), "windows-1257": ("e0a1", "ą�"), "windows-1258": ("d0fe", "Đ₫"), "x-mac-cyrillic": ("8ff0a2ff", "ПрҐ€"),
    "gbk": ("c4e380ff", "你€�"), "gb18030": ("a2e39439fc3680ff", "€😀€�"), "big5": ("a741ff", "你�"), "euc-jp": ("a4c68fb0a1", "て丂"), "iso-2022-jp": ("1b2442244624391b2842", "てす"), "shift_jis": ("82c4b1a0", "てｱ�"), "euc-kr": ("b0a1c8fe", "가힝"),
    "replacement": ("c3a9", ""), "utf-16be": ("20ac0041", "€A"), "utf-16le": ("ac204100", "€A"), "x-user-defined": ("80ff", "\uf780\uf7ff"),
}
CHARSETS = sorted(ENCODINGS.items())
_sql_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
SQL_ASCII = r"regexp_replace(text, '[^\x{0A}\x{20}-\x{7E}]', '?', 'g')"


@query(f"""SELECT doc_id, label, CASE encoding WHEN 'replacement' THEN chr(65533) ELSE {SQL_ASCII} || probe END AS decoded FROM (SELECT doc_id, text, {_sql_list([label for label, _ in CHARSETS])}[doc_id % {len(CHARSETS)} + 1] AS label, {_sql_list([name for _, name in CHARSETS])}[doc_id % {len(CHARSETS)} + 1] AS encoding, {_sql_list([PROBES[name][1] for _, name in CHARSETS])}[doc_id % {len(CHARSETS)} + 1] AS probe FROM documents)""")
def q44_charset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ASCII text and some bytes of the encoding, by one of the standard's labels in turn."""
    at = (F.col("doc_id") % len(CHARSETS)).cast("int")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), at)
    plain = F.regexp_replace("text", r"[^\x0A\x20-\x7E]", "?")
    encoding = pick([name for _, name in CHARSETS])
    begin = F.when(encoding == "utf-16le", F.encode(plain, "UTF-16LE")).when(encoding == "utf-16be", F.encode(plain, "UTF-16BE")).otherwise(F.encode(plain, "UTF-8"))
    label = pick([label for label, _ in CHARSETS])
    given = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.upper(label), F.lit("\n"))).otherwise(label)
    decoded = decode_text(F.concat(begin, F.unhex(pick([PROBES[name][0] for _, name in CHARSETS]))), given)
    return read(spark, sf_dir, "documents").select("doc_id", label.alias("label"), decoded.alias("decoded"))


@query("""WITH e AS (SELECT s_suppkey, unnest([{'path': '0', 'name': 'name.txt', 'said': s_name, 'error': NULL}, {'path': '1', 'name': 'in/deep.zip', 'said': NULL, 'error': NULL}, {'path': '1/0', 'name': 'nation.txt', 'said': 'nation ' || s_nationkey, 'error': NULL},
 CASE s_suppkey % 3 WHEN 0 THEN {'path': '1/1', 'name': 'empty.txt', 'said': '', 'error': NULL} WHEN 1 THEN {'path': '1/1', 'name': 'bad.zip', 'said': 'no archive', 'error': NULL} ELSE {'path': '1', 'name': NULL, 'said': NULL, 'error': 'archive limit: entry size limit'} END,
 CASE WHEN s_suppkey % 3 = 1 THEN {'path': '1/1', 'name': NULL, 'said': NULL, 'error': 'BadZipFile: File is not a zip file'} END]) AS e FROM supplier)
SELECT s_suppkey, e.path AS path, e.name AS name, e.said AS said, e.error AS error FROM e WHERE e IS NOT NULL""")
def q45_archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives' entries on all levels by a table function in SQL."""

    def build(key: int, name: str, nation: int) -> bytes:
        third = {0: {"empty.txt": ""}, 1: {"bad.zip": "no archive"}, 2: {"large.bin": b"0" * 5000}}[key % 3]
        return packages.zipped({"name.txt": name, "in/deep.zip": packages.zipped({"nation.txt": f"nation {nation}", **third})})

    trees.register_entries(spark, "archive_entries", archives.ArchiveLimits(entry_bytes=2000))
    built(read(spark, sf_dir, "supplier"), "s_suppkey", build, "s_suppkey", "s_name", "s_nationkey").createOrReplaceTempView("supplier_archives")
    return spark.sql("SELECT a.source_id AS s_suppkey, e.path, e.name, CASE WHEN e.name LIKE '%.txt' OR e.name = 'bad.zip' THEN string(e.content) END AS said, e.error FROM supplier_archives AS a, LATERAL archive_entries(a.content) AS e")


@query("""SELECT s_suppkey || '.md' AS name, '# ' || s_name || chr(10) || chr(10) || 'From nation *' || s_nationkey || '*' AS markdown FROM supplier""")
def q46_file_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown file for each source, written by tasks that commit, and read back."""
    files.register(spark)
    page = F.concat(F.lit("<h1>"), _xml(F.col("s_name")), F.lit("</h1><p>From nation <i>"), "s_nationkey")
    sources = spread(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")).select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".md")).alias("source_id"), F.encode(page, "utf-8").alias("content"))
    folder = scratch_path(spark, "markdown")
    dispatch.converted(sources, html.html).select(F.col("source_id").alias("name"), normalize_markdown(F.col("markdown")).alias("content")).write.format("document_files").mode("append").save(folder)
    back = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return back.select(F.substring_index("path", "/", -1).alias("name"), F.col("content").cast("string").alias("markdown"))


@query(f"""SELECT s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.html' ELSE '.bin' END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'html' END AS converter, CASE WHEN s_suppkey % 3 < 2 THEN 'ok' ELSE 'unsupported' END AS status,
 CASE s_suppkey % 3 WHEN 0 THEN '| name | nation |' || {SQL_RULE} || '| ' || s_name || ' | ' || s_nationkey || ' |' WHEN 1 THEN '# ' || s_name END AS markdown FROM supplier""")
def q47_stream_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over a folder of files that come from a table, up to all that there are."""
    files.register(spark)
    kind = F.col("s_suppkey") % 3
    content = F.when(kind == 0, F.encode(F.concat(F.lit("name,nation\n"), "s_name", F.lit(","), "s_nationkey"), "utf-8")).when(kind == 1, F.encode(F.concat(F.lit("<h1>"), _xml(F.col("s_name"))), "utf-8")).otherwise(F.lit(b"\x00\xff"))
    name = F.concat(F.col("s_suppkey").cast("string"), F.when(kind == 0, ".csv").when(kind == 1, ".html").otherwise(".bin"))
    folder, output, checkpoint = (scratch_path(spark, label) for label in ("incoming", "converted", "progress"))
    spread(read(spark, sf_dir, "supplier").select(name.alias("name"), content.alias("content"))).write.format("document_files").mode("append").save(folder)
    convert_stream(Engine(spark), folder, output, checkpoint, "*.*").awaitTermination()
    return spark.read.parquet(output).select(F.substring_index("path", "/", -1).alias("name"), "converter", "status", "markdown")
