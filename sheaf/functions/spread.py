"""Rows dealt out to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Up to here the number of shuffle partitions counts; a step of many Python functions takes a second or more a task.
MOST_BY_CONF = 48


def few_tasks(spark: SparkSession) -> int:
    """A task for every other core: the engine's plan has a Python process for each format in each task, some 60 MB each."""
    return max(1, spark.sparkContext.defaultParallelism // 2)


def spread(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows in even parts, several for each core. A small table lies in one part or a few, by its bytes, and so would all
    the work that its rows make, however much that is."""
    if tasks:
        return rows.repartition(tasks)
    session = rows.sparkSession
    shuffled = int(session.conf.get("spark.sql.shuffle.partitions"))  # as cores may have yet to come
    return rows.repartition(max(min(shuffled, MOST_BY_CONF), 3 * session.sparkContext.defaultParallelism))
