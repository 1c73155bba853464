"""The pipeline on planted documents: each stage's decisions, odd rows, and all stages together."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    good = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(i, good(rng.randint(20, 80)) if i % 3 else good(rng.randint(20, 80)).upper().replace(" ", "!! ")) for i in range(200)]
    base = good(120)
    passage = good(60)
    rows += [(300, base), (301, base), (302, base + " tail."), (310, passage + " " + good(40)), (311, good(40) + " " + passage), (320, good(30) + " password=abcdef123456 and more."), (330, ""), (331, None), (None, good(30))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    docs.coalesce(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        seen.append({r.doc_id: r for r in docs.collect()})
    after_quality, after_near, after_repeats, after_secrets, packed = seen
    assert not [i for i in after_quality if i is not None and i < 200 and i % 3 == 0]
    assert len([i for i in after_quality if i is not None and i < 200]) >= 130
    assert {300, 301, 302} <= set(after_quality) and {300, 301, 302} & set(after_near) == {300}
    assert set(after_near) == set(after_repeats) == set(after_secrets) == set(packed) and None in after_near
    first, second = after_repeats[310], after_repeats[311]
    assert first.text == after_near[310].text and len(second.text) < len(after_near[311].text) - 150 and second.n_chars == len(second.text)
    assert "password" not in after_secrets[320].text and corpus_pipeline.REDACTED in after_secrets[320].text
    assert after_secrets[5].text == after_near[5].text


def test_run_is_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_near_duplicates_are_judged_by_row(spark):
    """A kept id that repeats with another text keeps both; identical rows are one; clashing columns and long texts pass."""
    base, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"z{i}" for i in range(70_000))
    rows = [(5, base), (9, base + " tail"), (5, other), (5, other), (5, base), (7, ""), (7, ""), (8, None), (None, base), (None, base)]
    docs = spark.createDataFrame([(i, t, "x", "s", 1, 2, 3) for i, t in rows], SCHEMA + ", n long, kept int")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(5, base), (5, other), (7, ""), (7, ""), (8, None), (None, base), (None, base)], key=repr)


def test_redaction_with_clashing_columns_repeats_and_long_texts(spark):
    secret, long = "so password=abcdef123456 it is", "quiet water " * 40_000 + "token: abcdef123456"
    rows = [(1, secret), (1, secret), (2, None), (None, ""), (3, long)]
    docs = spark.createDataFrame([(i, t, "x", "s", 1, "mine", 2) for i, t in rows], SCHEMA + ", redacted string, secret_spans int")
    out = corpus_pipeline.redact_secrets(spark, docs, "")
    assert out.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text, r.redacted, r.secret_spans) for r in out.collect()), key=repr)
    clean = f"so {corpus_pipeline.REDACTED} it is"
    assert got == sorted([(i, {secret: clean, long: "quiet water " * 40_000 + corpus_pipeline.REDACTED}.get(t, t), "mine", 2) for i, t in rows], key=repr)
