"""Searches of a stated query set against all vectors, block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim): one row of each id that has a vector of finite components alone.

    Rows without an id take no part. Of several rows with one id, the greatest vector counts, so repeated rows count once.
    """
    limit = F.lit(float("inf"))
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    return rows.groupBy("id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v"))


def matrix(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the vectors of a block, by id."""
    ids = table.column("id").to_numpy()
    flat = table.column("v").combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray | pa.LargeListArray) else pa.concat_arrays([x.flatten() for x in flat.chunks])
    rows = flat.to_numpy(zero_copy_only=False).reshape(len(ids), dim)
    order = np.argsort(ids, kind="stable")
    return ids[order], rows[order]


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k highest scores, ties to the smaller id, query by query."""
    order = np.lexsort((ids, -score, query))
    sorted_query = query[order]
    first = np.flatnonzero(np.r_[True, sorted_query[1:] != sorted_query[:-1]]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def search_blocks(vectors: DataFrame, is_query: Column, k: int, compare: Callable, score_type: str, query_block: int = 4096, vector_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other vectors of as many components.

    Both sides are hashed into blocks of about the given sizes, and each pair of a query block and a vector block is
    one task's group: compare(query ids, queries, ids, vectors, k) returns positions (query, vector) and scores. So a
    group is bounded whatever the data, and only k rows a query leave it. Vectors are sent once for every query_block
    queries, queries once for every vector_block vectors. The counts that set the block numbers are the only action.
    """
    counts = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).head()
    n_blocks, q_blocks = max(1, -(-counts[0] // vector_block)), max(1, -(-counts[1] // query_block))
    spread = F.xxhash64("id", F.lit(17))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = vectors.withColumn("vb", F.pmod(spread, F.lit(n_blocks)).cast("int")).select("*", every(q_blocks).alias("qb"))
    left = vectors.where(is_query).withColumn("qb", F.pmod(spread, F.lit(q_blocks)).cast("int")).select("*", every(n_blocks).alias("vb"))

    arrow_score = pa.int64() if score_type == "long" else pa.float64()

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        none = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], arrow_score)]
        if queries.num_rows and block.num_rows:
            dim = queries.column("dim")[0].as_py()
            q_ids, q = matrix(queries, dim)
            ids, x = matrix(block, dim)
            at_q, at_x, score = compare(q_ids, q, ids, x, k)
            keep = best(at_q, score, ids[at_x], k)
            none = [pa.array(q_ids[at_q[keep]]), pa.array(ids[at_x[keep]]), pa.array(score[keep], arrow_score)]
        return pa.Table.from_arrays(none, ["query_id", "vec_id", "score"])

    keys = ["dim", "qb", "vb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
