"""A stream of files to a table of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.spread import few_tasks
from ..functions.text import base_name, extension


def convert_stream(engine: Engine, folder: str, output: str, checkpoint: str, pattern: str = "*", files_per_trigger: int | None = None, bytes_per_trigger: int = 1 << 30):
    """Starts a query that converts each new file of a folder into rows (path, converter, status, markdown, title,
    error, batch) of Parquet. It ends when what is there has been converted; started again, it goes on from there.

    A batch is written into a folder of its own number, in place of what is there: one that is done again after a
    failure leaves its rows once. A batch takes files up to so many bytes, or up to a number of files if that is given:
    its cost is mostly by task, so small files go to few tasks (see `few_tasks`).
    """
    spark = engine.spark
    schema = spark.read.format("binaryFile").load(folder).schema
    bound = ("maxBytesPerTrigger", bytes_per_trigger) if files_per_trigger is None else ("maxFilesPerTrigger", files_per_trigger)
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option(*bound).load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        name = base_name(F.col("path"))
        sources = rows.coalesce(few_tasks(spark)).select(F.col("path").alias("source_id"), "content", extension(name).alias("extension"), name.alias("filename"), F.col("path").alias("url"))
        done = engine.convert(sources).withColumnRenamed("source_id", "path")
        done.select("path", "converter", "status", "markdown", "title", "error").write.mode("overwrite").parquet(f"{output}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
