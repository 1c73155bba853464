"""Each query against its SQL on the smallest tables, and rules that the tables don't reach."""

import json
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions import charset, text
from sheaf.operators import delimited, dispatch, html, layout, notebooks
from sheaf.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables aren't here")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    got = sorted(repr(tuple(r[c] for c in sorted(frame.columns))) for r in frame.collect())
    if name in queries.ORACLE_SQL:
        want = duck.sql(queries.ORACLE_SQL[name])
        order = sorted(want.columns)
        assert order == sorted(frame.columns)
        assert got == sorted(repr(tuple(r[want.columns.index(c)] for c in order)) for r in want.fetchall())
    else:
        assert got


def test_normalization(spark):
    cases = {"ebb  \r\n\r\n\r\n###   \r\nflood\r\n": "ebb\n\nflood", "a\rb": "a\nb", "# #\n#######\nx": "x", "  \t x \n": "x", "": "", "![x](data:image/gif;base64," + "Q" * 120 + ") y": "![x](data:image/gif;base64,...) y"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").select("want", text.normalize_markdown(F.col("t")).alias("got")).collect()
    assert all(r.got == r.want for r in rows)


def test_clean_path(spark):
    import posixpath

    paths = ["a/b/../c", "./x//y/.", "../a/../../b", "/a/../../b", "", "a/..", "ppt/slides/../media/i.png"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", text.clean_path(F.col("p")).alias("got")).collect()
    assert {r.p: r.got for r in rows} == {p: posixpath.normpath(p) if p else "." for p in paths}


def test_charsets():
    decode = charset.decode_bytes
    assert len(charset.ENCODINGS) == 228 and set(charset.ENCODINGS.values()) == set(queries.PROBES)
    assert decode(b"caf\xe9", "windows-1252") == "café" and decode(b"\x80", " Latin1\n") == "€"
    assert decode(b"a\xff\xfe\xffb", None) == "a�b" and decode(b"\xef\xbb\xbfx", "utf-8") == "﻿x"
    # labels that only Python has, or nobody, mean UTF-8
    for label in ("rot13", "hex", "base64", "zip", "bz2", "punycode", "unicode_escape", "cp037", "utf-7", "no-such", ""):
        assert decode(b"x-1", label) == "x-1" and decode(b"\xe9", label) == "�"
    errors = [(b"\x81\x20a", "gbk", "� a"), (b"\x80\xff", "x-gbk", "€�"), (b"\x81\xffq", "big5", "��q"), (b"\xfd\xa0\x80", "x-sjis", "��\x80"), (b"\x81", "euc-kr", "�"), (b"\x81\xffz", "ks_c_5601-1987", "��z"), (b"a\x00\xff", "utf-16", "a�"), (b"\x00\xd8a\x00", "utf-16le", "�a"), (b"", "iso-2022-kr", ""), (b"abc", "iso-2022-kr", "�")]
    for data, label, want in errors:
        assert decode(data, label) == want


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.sampled_from(sorted(charset.ENCODINGS)))
def test_no_bytes_fail_under_any_label(data, label):
    assert isinstance(charset.decode_bytes(data, label), str)


def test_notebooks_of_odd_kinds(spark):
    book = lambda *cells, **more: json.dumps({"nbformat": 4, "cells": list(cells)} | more)
    code = {"cell_type": "code", "source": ["a", "b\n"]}
    fence = "```"
    cases = [
        (book(code), f"{fence}\nab\n{fence}", None),
        (book(code, metadata={"language_info": {"name": "r"}}), f"{fence}r\nab\n{fence}", None),
        (book(code, metadata={"language_info": {"name": 5}}), f"{fence}\nab\n{fence}", None),
        (book({"cell_type": "markdown", "source": " # é\u00a0 "}, {"source": None}, {}), "# é", None),
        (book({"cell_type": "raw", "source": ["x", None]}, {"cell_type": 7, "source": ["y", 1]}, {"cell_type": "raw", "source": []}), "", None),
        (book(code | {"outputs": [{"text": ["1\n", "2"]}, 5, {"data": {"text/plain": "p"}}, {"text": " ", "data": {"text/plain": ["q"]}}, {"data": []}]}), f"{fence}\nab\n{fence}\n\n{fence}text\n1\n2\np\nq\n{fence}", None),
        (book(code | {"outputs": None}), f"{fence}\nab\n{fence}", None),
        (book(), "", None),
        (book(code, 5), None, "unsupported"),
        (book(code, nbformat=0), None, "unsupported"),
        (book(code, nbformat="4"), None, "unsupported"),
        (book(cells={"a": 1}), None, "unsupported"),
        ("[1]", None, "unsupported"),
        ("{", None, "malformed notebook"),
        ("[" * 5000, None, "malformed notebook"),
        ("", None, "malformed notebook"),
    ]
    rows = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(cases)], "source_id long, text string").selectExpr("source_id", "encode(text, 'utf-8') AS content")
    got = {r.source_id: (r.markdown, r.error) for r in dispatch.converted(rows, notebooks.notebook).collect()}
    for i, (_, markdown, error) in enumerate(cases):
        assert got[i] == (markdown, error), cases[i]


def test_csv_rules():
    assert delimited.parse_csv('a,"b ""x"", y"\n\n1,2\r\n') == [["a", 'b "x", y'], ["1", "2"]]
    assert delimited.parse_csv("a,b\n1\n", ragged=True) == [["a", "b"], ["1"]]
    for bad in ("a,b\n1\n", 'a"b\n', '"a\n', '"a"b\n'):
        with pytest.raises(delimited.Malformed):
            delimited.parse_csv(bad)


def test_layout(spark):
    page = "Title\n\nname   age   town   x\nAda   30   Rome   1\nBob   31   Oslo   2\n\nText that\nwraps here\nodd   one\n"
    (row,) = layout.layout_markdown(spark.createDataFrame([(1, page)], "id long, page string"), "page").collect()
    assert row.markdown == "Title\n\n| name | age | town | x |\n| --- | --- | --- | --- |\n| Ada | 30 | Rome | 1 |\n| Bob | 31 | Oslo | 2 |\n\nText that\nwraps here"


def test_html_goldens():
    cases = {
        "<h2>A <em>b</em></h2><p>x<br>y</p><hr>": "## A *b*\n\nx  \ny\n\n* * *",
        "<ol><li>one</li><li>two<ul><li>in</li></ul></li></ol>": "1. one\n2. two\n   - in",
        "<blockquote><p>q</p></blockquote><pre><code class='language-py'>a\n b</code></pre>": "> q\n\n```py\na\n b\n```",
        "<p>1 * 2 [x] <code>a`b</code></p>": "1 \\* 2 \\[x\\] ``a`b``",
        "<p><b>open<p>next</b> on": "**open**\n\n**next** on",
        "<a href='/u' title='t'>n</a> <img src='i.png' alt='p'>": '[n](/u "t") ![p](i.png)',
    }
    for source, want in cases.items():
        assert html.html_to_markdown(source)[0] == want


def test_feeds_of_odd_documents(spark, tmp_path):
    rows = [(i, f"text <{i}> & more" if i % 10 != 5 else " ", "en", "one & only", 5) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.markdown for r in queries.QUERIES["q13_rss_to_markdown"](spark, str(tmp_path)).collect()}
    for i, body, *_ in rows:
        plain = body.replace("<", "(").replace(">", ")").strip()
        assert got[i] == f"# one & only\n\n## Item {i}\n\nPublished on: day {i}" + (f"\n\n{plain}" if plain else "") + f"\n\n## Size\n\n**{len(body)}** characters"
