"""The corpus pipeline: STAGES in order, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm import neardup, packing, quality, secrets, suffix
from sheaf.llm.common import release, scratch_path, table

#: What stands in a text for each secret.
REDACTED = "[SECRET]"
#: Documents with a lower quality score go.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is LEAST_QUALITY or more, as they are. Each row is judged by its own text; null texts count
    as empty ones. Without labels of both classes all documents stay."""
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, docs.columns, score_col="__score")
    return scored.where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group, by shingles of five words and a similarity of 0.8. Documents
    without an id, or without words, stay. Rows that repeat an id are judged each by its own text; of rows that repeat
    both one stays."""
    groups = neardup.near_duplicates(docs, neardup.NearDupConfig(words=5, percent=80))
    gone = groups.where(~F.col("kept")).select("doc_id", F.col("text_hash").alias("__hash")).distinct()
    own = Window.partitionBy("doc_id", "__hash").orderBy("__hash")
    named = docs.where("doc_id is not null")  # rows without an id are compared with nothing, and stay where they are
    rest = named.withColumn("__hash", F.xxhash64(F.col("text").cast("string"))).join(gone, ["doc_id", "__hash"], "left_anti")
    copies = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = rest.withColumn("__nth", F.row_number().over(own)).where((F.col("__nth") == 1) | ~copies)
    return once.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 50 bytes or more that documents with smaller ids have. n_chars follows."""
    clean = suffix.without_repeats(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with REDACTED in place of each secret. n_chars follows."""
    scanned = secrets.scan_secrets(docs, secrets.train_scanner(docs), docs.columns, replacement=REDACTED, spans_col="__spans", redacted_col="__redacted")
    clean = scanned.withColumn("text", F.col("__redacted").cast(docs.schema["text"].dataType)).select(*docs.columns)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens. Null and empty texts are the end id alone; rows
    that repeat are packed as often as they occur."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array", drop_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can express none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
