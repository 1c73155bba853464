"""Every format end to end, dispatch with fall-through, archives and the streaming and single-document ways in."""

import io
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf.engine import Engine, FailedAttempts, Options, UnsupportedFormat
from sheaf.operators import archives, dispatch, pdf, trees
from sheaf.sinks import files
from sheaf.sources import uris
from sheaf.streaming.files import convert_stream

from . import fixtures


def nested(levels: int) -> bytes:
    out = fixtures.package({"keel.txt": "mud"})
    for _ in range(levels - 1):
        out = fixtures.package({"inner.zip": out})
    return out


RSS = b"""<?xml version="1.0" encoding="utf-8"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Port notices</title><description><![CDATA[<p>For masters</p>]]></description><item><title>Dredging</title><pubDate>day 9</pubDate><description>brief</description><content:encoded><![CDATA[<p>Keep <b>clear</b></p>]]></content:encoded></item><item/></channel></rss>"""
ATOM = b'<feed xmlns="http://www.w3.org/2005/Atom"><title>Buoys</title><entry><title>Red one</title><updated>at noon</updated><summary>adrift</summary></entry></feed>'

CASES = {
    "doc.docx": (fixtures.docx(), None, "docx", ["# Harbour rules", "See the [pilot book](https://harbour.example/pilot)", "tide-table", "| Berth | Depth |\n| --- | --- |\n| North\\|quay | 7 |"]),
    "deck.pptx": (fixtures.pptx(), None, "pptx", ["## Slide 1: Spring tides", "[chart room](https://harbour.example/charts)", "| moon | metres |", "### Notes\n\nmention the ebb", "## Slide 2\n\nnothing but text"]),
    "book.xlsx": (fixtures.xlsx(), None, "xlsx", ["## Boats", "| boat | crew |  |", "| Petrel | 4 | 2023-03-15 | 12.50% | 9,876,543.22 | FALSE |", "## Spare"]),
    "old.xls": (fixtures.xls(), None, "xls", ["## Log\n\n| Hour | Wind |\n| --- | --- |\n| dawn | south |\n| 12.25 | 2023-03-15 |\n| 9 |  |"]),
    "novel.epub": (fixtures.epub(), None, "epub", ["**Title:** The Lock Keeper\n**Authors:** N. Weir\n**Language:** en", "# High water", "The gate **held**"]),
    "page.pdf": (fixtures.pdf(), None, "pdf", ["Crane log (east)", "| load | tons |\n| --- | --- |\n| coal | 12 |\n| iron | 30 |"]),
    "nb.ipynb": (fixtures.notebook(), None, "ipynb", ["# Soundings\nby hand", "```python\ndepth(3)\n```", "```text\n3.5\nfathoms\n```", "```python\n\n```"]),
    "data.json": (fixtures.notebook(), "application/json", "ipynb", ["depth(3)"]),
    "feed.xml": (RSS, None, "rss", ["# Port notices", "For masters", "## Dredging\n\nPublished on: day 9\n\nKeep **clear**"]),
    "feed.atom": (ATOM, None, "rss", ["# Buoys\n\n## Red one\n\nUpdated on: at noon\n\nadrift"]),
    "plain.xml": (b"<log><x>1</x></log>", None, "text", ["<log><x>1</x></log>"]),
    "table.csv": (b'ship,port\n"Gull, old",Hull\n\nTern,Cork\n', None, "csv", ["| ship | port |\n| --- | --- |\n| Gull, old | Hull |\n| Tern | Cork |"]),
    "ragged.csv": (b"a,b\n1\n", None, "text", ["a,b\n1"]),
    "page.html": (b"<html><head><title> Ferry </title><style>x</style></head><body><h1>Times</h1><script>track()</script><p>the <a href='/map'>map</a><ul><li>early<li>late</ul></body></html>", None, "html", ["# Times", "the [map](/map)", "- early\n- late"]),
    "latin.txt": (b"caf\xe9", None, "text", ["caf\u00e9"]),
    "bad.pdf": (b"%PDF-1.4\nno objects in here\n%%EOF", None, "text", ["no objects"]),
    "bundle.zip": (fixtures.package({"crew.csv": "who,job\nIda,mate", "todo.txt": " paint \n", "junk.bin": b"\x00\x01", "void.txt": "", "hold/in.zip": fixtures.package({"x.md": "# in"})}), None, "zip", ["Content from zip file `bundle.zip`\n\n## File: crew.csv\n\n| who | job |", "## File: todo.txt\n\npaint", "## File: hold/in.zip\n\nContent from zip file `in.zip`\n\n## File: x.md\n\n# in"]),
}
BROKEN = {
    "cut.xls": (fixtures.xls()[:700], "failed", "xls: "),
    "cut.zip": (fixtures.package({"log.txt": "ebb " * 50})[:-30], "failed", "zip: "),
    "many.zip": (fixtures.package({f"{i}.txt": "x" for i in range(300)}), "failed", "entry limit"),
    "deep.zip": (nested(6), "failed", "recursion depth"),
    "hollow.docx": (fixtures.package({"word/styles.xml": "<styles/>"}), "unsupported", "unsupported"),
    "hollow.pptx": (fixtures.package({"ppt/media/gull.txt": "kee"}), "unsupported", "unsupported"),
    "lost.epub": (fixtures.package({"text/one.xhtml": "<p>no book says where</p>"}), "unsupported", "unsupported"),
    "blob": (b"\x00\x01\x02", "unsupported", "unsupported"),
}


@pytest.fixture(scope="module")
def results(spark):
    engine = Engine(spark)
    rows, names = [], {}
    for i, (name, case) in enumerate({**CASES, **BROKEN}.items()):
        mime = case[1] if name in CASES else None
        rows.append((i, bytearray(case[0]), mime, name, "windows-1252" if name == "latin.txt" else None))
        names[i] = name
    sources = spark.createDataFrame(rows, "source_id long, content binary, mime_type string, filename string, charset string")
    return {names[r.source_id]: r for r in engine.convert(sources).collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_format(results, name):
    _, _, converter, parts = CASES[name]
    row = results[name]
    assert (row.status, row.converter) == ("ok", converter), row
    for part in parts:
        assert part in row.markdown
    assert not any(x in row.markdown for x in ("track()", "page furniture", "struck"))


@pytest.mark.parametrize("name", list(BROKEN))
def test_failure(results, name):
    _, status, message = BROKEN[name]
    assert results[name].status == status and message in results[name].error


def test_titles(results):
    titles = {"page.html": "Ferry", "doc.docx": "Harbour rules", "novel.epub": "The Lock Keeper", "deck.pptx": "Spring tides", "feed.xml": "Port notices"}
    assert {name: results[name].title for name in titles} == titles


def test_single_documents(spark, tmp_path):
    engine = Engine(spark)
    path = tmp_path / "note.txt"
    path.write_text("slack water\n")
    for source in (str(path), path, f"file://{path}", b"slack water", io.BytesIO(b"slack water"), "data:text/plain;charset=utf-8;base64,c2xhY2sgd2F0ZXI="):
        assert engine.convert_one(source).markdown == "slack water"
    with pytest.raises(uris.RemoteDisabled):
        engine.convert_one("http://example.com/x")
    with pytest.raises(uris.InvalidSource):
        engine.convert_one(7)
    with pytest.raises(uris.InvalidSource):
        engine.convert_one("data:text/plain")
    with pytest.raises(FileNotFoundError):
        engine.convert_one("ftp://x/y")
    with pytest.raises(UnsupportedFormat):
        engine.convert_one(b"\x00")
    with pytest.raises(FailedAttempts):
        engine.convert_one(b"x\x00", extension=".zip")
    with pytest.raises(ValueError, match="unknown PDF extractor"):
        Engine(spark, Options(pdf_backend="pdftotext"))


def test_own_converters_come_by_priority(spark):
    engine = Engine(spark, defaults=False)
    made = lambda text: lambda source: dispatch.result(F.lit(text))
    engine.register("late", 50, lambda e, m, c: F.lit(True), made("late"))
    engine.register("first", 10, lambda e, m, c: F.lit(True), made("first"))
    engine.register("second", 10, lambda e, m, c: F.lit(True), made("second"))
    assert engine.convert_one(b"x").markdown == "first"
    assert engine.formats() == ["first\t(priority 10)", "second\t(priority 10)", "late\t(priority 50)"]
    with pytest.raises(UnsupportedFormat):
        Engine(spark, defaults=False).convert_one(b"x")


def test_later_converters_are_not_called_after_a_success(spark):
    calls = {name: spark.sparkContext.accumulator(0) for name in ("first", "second", "third")}
    registry = dispatch.Registry()

    def converter(name: str, fails: bool):
        counter = calls[name]

        @F.pandas_udf("string")
        def call(content: pd.Series) -> pd.Series:
            counter.add(int(content.notna().sum()))
            return content.map(lambda x: None if x is None else name)

        def convert(source):
            made = call(source.content)
            return dispatch.result(made, None, F.when((source.content == F.lit(b"bad")) & F.lit(fails), "broken"))

        return convert

    for priority, name in enumerate(calls):
        registry.register(name, priority, lambda e, m, c, name=name: F.lit(True) if name != "second" else c != F.lit(b"skip"), converter(name, name != "third"))
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([b"good", b"bad", b"skip", b"good"])], "source_id long, content binary").selectExpr("*", "string(null) AS mime_type", "string(null) AS extension", "string(null) AS charset")
    got = {r.source_id: (r.converter, len(r.attempts)) for r in dispatch.convert_sources(rows, registry).collect()}
    assert got == {0: ("first", 0), 1: ("third", 2), 2: ("first", 0), 3: ("first", 0)}
    assert {name: c.value for name, c in calls.items()} == {"first": 4, "second": 1, "third": 1}


def bomb(levels: int, breadth: int, size: int) -> bytes:
    inner = {f"{i}.txt": b"0" * size for i in range(4)}
    for _ in range(levels):
        inner = {f"{i}.zip": fixtures.package(inner) for i in range(breadth)}
    return fixtures.package(inner)


def test_nested_bombs_end_in_a_limit():
    data = bomb(2, 60, 7 << 20)  # 100 GB in all, each archive within its own limits
    tracemalloc.start()
    *_, last = trees.tree_entries(data, archives.ArchiveLimits())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert last[3] == f"archive limit: {128 << 20} bytes of all levels" and peak < 256 << 20
    few = list(trees.tree_entries(data, archives.ArchiveLimits(tree_bytes=1 << 20)))
    assert few[-1][3] == f"archive limit: {1 << 20} bytes of all levels"
    lying = bytearray(fixtures.package({"x.txt": b"0" * 100_000}))
    at = lying.rindex((100_000).to_bytes(4, "little"))
    lying[at : at + 4] = (10).to_bytes(4, "little")
    assert [r[3] is not None for r in trees.tree_entries(bytes(lying), archives.ArchiveLimits(entry_bytes=50))] == [True]


def test_trees_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        files = [fixtures.package({f"{i}-{j}.txt": f"t{j}" for j in range(i)}) for i in range(6)]
        rows = [(2 * i + k, bytearray(files[i] if k else b"plain"), ".zip" if k else ".txt") for i in range(6) for k in range(2)]
        got = {r.source_id: r for r in Engine(spark).convert(spark.createDataFrame(rows, "source_id long, content binary, extension string").coalesce(1)).collect()}
        for i in range(6):
            assert got[2 * i].markdown == "plain"
            assert got[2 * i + 1].markdown == "\n\n".join(["Content from zip file `archive.zip`", *(f"## File: {i}-{j}.txt\n\nt{j}" for j in range(i))])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_formats(spark):
    assert [f.split("\t")[0] for f in Engine(spark).formats()] == ["ipynb", "docx", "pptx", "pdf", "xlsx", "xls", "csv", "epub", "rss", "zip", "html", "text"]


def test_stream_and_a_batch_that_is_done_again(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    (folder / "b.csv").write_text("x,y\n1,2")

    def run():
        convert_stream(Engine(spark), f"file://{folder}", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
        return sorted((r.path.rpartition("/")[2], r.converter, r.batch) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    first = [("a.txt", "text", 0), ("b.csv", "csv", 0)]
    assert run() == first
    for name in ("0", ".0.crc"):  # as if the driver had been lost before it could note the batch
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    assert run() == first
    (folder / "c.md").write_text("# three")
    assert run() == [*first, ("c.md", "text", 1)]


def test_file_sink(spark, tmp_path):
    files.register(spark)
    made = spark.range(20).selectExpr("concat(id, '.md') AS name", "concat('# ', id) AS content", "id")
    write = lambda df, mode="append": df.repartition(3).write.format("document_files").mode(mode).save(str(tmp_path / "out"))
    write(made)
    names = lambda: sorted(p.name for p in (tmp_path / "out").iterdir() if p.name != "_SUCCESS")
    assert names() == sorted(f"{i}.md" for i in range(20)) and (tmp_path / "out" / "7.md").read_text() == "# 7"
    for bad in ("CASE WHEN id = 11 THEN raise_error('lost') ELSE concat('n', id) END", "'same'", "CASE WHEN id = 3 THEN '../up' ELSE concat('n', id) END"):
        with pytest.raises(Exception):  # noqa: B017
            write(spark.range(20).selectExpr(f"{bad} AS name", "'x' AS content"))
        assert len(names()) == 20
    write(spark.range(2).selectExpr("concat(id, '.txt') AS name", "encode('é', 'utf-8') AS content"), "overwrite")
    assert names() == ["0.txt", "1.txt"] and (tmp_path / "out" / "0.txt").read_text() == "é"
    with pytest.raises(Exception, match="columns are missing"):
        write(spark.range(1).selectExpr("'a' AS name"))


def test_local_files(spark, tmp_path):
    (tmp_path / "a b.TXT").write_text("x")
    row = uris.local_files(spark, f"file://{tmp_path}").head()
    assert (row.filename, row.extension) == ("a b.TXT", ".TXT")


def test_http(spark):
    class Response(io.BytesIO):
        status, headers = 200, {"Content-Type": "text/plain; charset=utf-8"}

    assert uris.fetch("http://x", 64, opener=lambda r, timeout: Response(b"hello")) == (b"hello", "text/plain; charset=utf-8")
    with pytest.raises(uris.RemoteTooLarge):
        uris.fetch("http://x", 8, opener=lambda r, timeout: Response(b"123456789"))
    with pytest.raises(uris.RemoteDisabled):
        uris.fetch_urls(spark.range(1).selectExpr("'http://x' AS url"))


def test_pdf_without_compression():
    assert "Crane log (east)" in pdf.parse_pdf(fixtures.pdf(compressed=False))
