"""What the operators share: reading tables, shared scratch folders, sizing of shuffles and a bounded memo."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark runs in
    one process. Anywhere else a folder of this machine would be no use to the others."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(context, "_sheaf_scratch", None):
        context._sheaf_scratch = tempfile.mkdtemp(prefix="sheaf-")
    return context._sheaf_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read again: it cuts the lineage, survives a lost executor and
    lets later steps read only the columns they need."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df; for a file scan the bytes of its files. It reads no data."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Shuffle partitions so that each has about bytes_each of df's estimated size, the session's number at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    estimate = plan_bytes(df)
    return max(least, min(200_000, -(-estimate // bytes_each)) if estimate < 1 << 60 else least)


def sampled(df: DataFrame, key: Column, rows: int, of: int) -> DataFrame:
    """At most `rows` rows of df, those with the smallest hashes; of: about how many rows there are. A threshold on the
    hash comes first, so that all tasks together send about twice the sample, however many tasks there are."""
    share = min(1.0, (2 * rows + 100) / max(of, 1))
    return df.where(F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.pmod(key, F.lit(1 << 30)), *df.columns).limit(rows)


class Memo:
    """A dictionary of at most 2 x size entries: when full, the young half becomes the old one, which is then let go."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps: it does so when the driver has collected its
    garbage, which a driver with little to do may put off for long."""
    for _ in range(2):  # what the first round lets go may hold more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
