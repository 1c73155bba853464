"""How work is dealt out and bounded where tables are large."""

from sheaf.functions.spread import spread
from sheaf.operators import legacy_xls, office, pdf
from sheaf.plans import packages, queries

SF = "/root/testdata/sf0.001"


def test_files_of_a_small_table_are_made_by_all_cores(spark):
    """The table is one file, and so one task, whatever its rows take."""
    parts = queries.read(spark, SF, "part")
    assert parts.rdd.getNumPartitions() == 1
    files = queries.built(parts, "p_partkey", lambda key, name: f"{key} {name}".encode(), "p_partkey", "p_name")
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    dealt = spread(parts).rdd.glom().map(len).collect()
    assert sum(dealt) == parts.count() and max(dealt) <= 2 * parts.count() / len(dealt) + 2
    assert {(r.source_id, bytes(r.content)) for r in files.collect()} == {(r.p_partkey, f"{r.p_partkey} {r.p_name}".encode()) for r in parts.collect()}


def test_workbooks_with_the_same_styles_have_them_read_once():
    book = lambda key: packages.xlsx({"Card": [["n", "shown"], [key, (key / 4, "0.000")]]})
    before = office.cell_formats.kept.cache_info().misses
    shown = [office.parse_xlsx(book(key))[0]["grid"][1] for key in range(20)]
    assert shown == [[str(key), f"{key / 4:.3f}"] for key in range(20)]
    assert office.cell_formats.kept.cache_info().misses <= before + 1


def test_a_tables_width_is_found_once(spark):
    """Eight times the rows take about eight times as long, not 64 times."""
    import time

    from pyspark.sql import functions as F

    from sheaf.functions.tables import greatest_width, render_table

    def seconds(rows: int) -> float:
        grids = spark.range(0, 20, 1, 1).select(F.expr(f"transform(sequence(1, {rows}), i -> array(string(i), string(i * id)))").alias("g"))
        began = time.time()
        grids.select(render_table(F.col("g"), greatest_width(F.col("g")))).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(100)
    assert seconds(4000) < 30 * max(0.2, min(seconds(500) for _ in range(2)))
    table = spark.sql("SELECT array(array('a'), array('b', 'c|d')) AS g, array() AS none").select(render_table(F.col("g")), render_table(F.col("none").cast("array<array<string>>"))).head()
    assert tuple(table) == ("| a |  |\n| --- | --- |\n| b | c\\|d |", "")


def test_functions_hand_on_what_they_make_in_short_runs():
    """A batch of 10,000 rows was held whole, read and made."""
    import pandas as pd

    from sheaf.functions.arrow import SLICE_BYTES, SLICE_ROWS, slices
    from sheaf.operators import delimited, feeds, html

    for function, text in ((html.render_html, "<p>a"), (feeds.read_feed, "<feed><title>a</title></feed>"), (delimited._strict, "a,b")):
        made = list(function.__wrapped__(iter([pd.Series([text, None] * 500), pd.Series([], dtype=object)])))
        assert sum(map(len, made)) == 1000 and max(map(len, made)) <= SLICE_ROWS
    long = ["x" * (SLICE_BYTES // 2 + 1)] * 5
    assert [len(run) for run in slices(long)] == [2, 2, 1] and list(slices([])) == [[]]


def test_a_stream_of_small_files_takes_few_batches(spark, tmp_path):
    """Each 1,000 files were a batch of their own, and each 32 a task."""
    from sheaf.engine import Engine
    from sheaf.streaming.files import convert_stream

    (tmp_path / "in").mkdir()
    for i in range(1001):
        (tmp_path / "in" / f"{i}.txt").write_text(f"n {i}")
    convert_stream(Engine(spark), f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/progress").awaitTermination()
    rows = spark.read.parquet(f"file://{tmp_path}/out").select("markdown", "batch").collect()
    assert sorted(r.markdown for r in rows) == sorted(f"n {i}" for i in range(1001)) and {r.batch for r in rows} == {0}


def test_runs_of_a_document_are_not_looked_at_without_need(monkeypatch):
    """Each run was searched for its way with space, for all its elements, even where nothing follows it."""
    asked = []
    attribute = office.attribute
    monkeypatch.setattr(office, "attribute", lambda node, *names: asked.append(node) or attribute(node, *names))
    runs = lambda n: "<w:r><w:t>a</w:t></w:r>" * n
    body = f'<w:p>{runs(500)}</w:p><w:p><w:r><w:t xml:space="preserve">b </w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve">c</w:t></w:r>{runs(1)}</w:p>'
    made = packages.zipped({"word/document.xml": f'<w:document xmlns:w="{packages.WORD}"><w:body>{body}</w:body></w:document>'})
    assert [b["text"] for b in office.parse_docx(made)[0]] == ["a" * 500, "b", "c a"]
    assert len(asked) <= 2


def test_words_of_pages_are_read_once_for_all_files():
    """Each name, number and operator was taken apart again for each file and each place."""
    made = [packages.pdf([f"crane {key}", "", "field   value", f"size   ({key})"], key % 2 == 0) for key in range(50)]
    assert pdf.parse_pdf(made[0]) == "crane 0\n\nfield   value\nsize   (0)\n"
    before = pdf.short_word.cache_info().misses
    assert [pdf.parse_pdf(data) for data in made] == [f"crane {key}\n\nfield   value\nsize   ({key})\n" for key in range(50)]
    assert pdf.short_word.cache_info().misses <= before + 50  # lengths of streams
    assert list(pdf.values(b"/A#42 (a\\(b(c)\\)\\101\\\n) 1.5 7 R (" + b"x" * 99 + b")"))[:2] == [("AB", 5), (b"a(b(c))A", 23)]


def test_legacy_workbooks_with_the_same_strings_have_them_read_once():
    book = lambda key: packages.xls("Card", [["n", "shown"], [f"f{i}" for i in range(30)], [key, (key / 4, "0.000")]])
    made = [book(key) for key in range(20)]
    before = legacy_xls.small_strings.cache_info().misses
    grids = [legacy_xls.parse_xls(data)[0]["grid"] for data in made]
    assert grids == [[["n", "shown"], [f"f{i}" for i in range(30)], [str(key), f"{key / 4:.3f}"]] for key in range(20)]
    assert legacy_xls.small_strings.cache_info().misses <= before + 1


def test_strings_of_one_record_are_taken_at_once(monkeypatch):
    """A string took two steps through the records, or more; those that run across records still do."""
    import struct

    taken = []
    take = legacy_xls.Strings.take
    monkeypatch.setattr(legacy_xls.Strings, "take", lambda self, n: taken.append(n) or take(self, n))
    want = ["tide", "", "é" * 300, "Žluť"]
    body = b"".join(struct.pack("<HB", len(t), wide) + t.encode("utf-16-le" if wide else "latin1") for t in want for wide in [t[:1] == "Ž"])
    read = lambda *parts: [s.string() for s in [legacy_xls.Strings(list(parts))] for _ in want]
    assert read(body) == want and not taken
    assert read(body[:5], b"\0" + body[5:]) == want  # cut in the first string, whose flag is repeated
    assert read(body[:7], body[7:]) == want and read(body[:2], body[2:]) == want
    rich = struct.pack("<HBHI", 2, 12, 1, 3) + b"ab" + bytes(4 + 3)
    assert legacy_xls.Strings([rich + body]).string() == "ab"
