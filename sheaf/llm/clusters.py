"""Exact k-means on whole numbers, filtered by ball trees that each partition builds for its own vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Components beyond this count as it: then a squared distance of 64 components always fits a long.
LARGEST = 1 << 27
#: Below this all products of 64 components are whole in doubles.
EXACT_IN_DOUBLES = 1 << 20


@dataclass(frozen=True)
class ClusterConfig:
    """k centroids of dim components, floor(scale * x), replaced `rounds` times. A tree holds tree_rows vectors at most
    and has leaves of leaf_rows at most; both change no result."""

    k: int = 40
    dim: int = 64
    scale: int = 256
    rounds: int = 5
    seed: int = 2
    tree_rows: int = 2048
    leaf_rows: int = 32


class BallTree:
    """Balls over the rows of x, which are put in the tree's order. Ball i holds rows start[i] to stop[i]: their number,
    their exact sum, a centre and a radius that reaches all of them; its halves are left[i] and left[i] + 1, -1 for a leaf."""

    FIELDS = {"ids": pa.int64(), "x": pa.int32(), "start": pa.int32(), "stop": pa.int32(), "left": pa.int32(), "centre": pa.float64(), "radius": pa.float64(), "total": pa.int64()}
    SCHEMA = ", ".join(f"{name} array<{ {pa.int64(): 'long', pa.int32(): 'int', pa.float64(): 'double'}[kind] }>" for name, kind in FIELDS.items())

    def __init__(self, **fields: np.ndarray):
        self.__dict__.update(fields)

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, leaf_rows: int) -> BallTree:
        order, start, stop, left = np.arange(len(x)), [0], [len(x)], [-1]
        at = 0
        while at < len(start):
            a, b = start[at], stop[at]
            if b - a > leaf_rows:
                rows = x[order[a:b]]
                widest = int(np.argmax(rows.max(0) - rows.min(0)))
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, widest], half)]
                left[at] = len(start)
                start += [a, a + half]
                stop += [a + half, b]
                left += [-1, -1]
            at += 1
        x = x[order]
        spans = list(zip(start, stop, strict=True))
        total = np.array([x[a:b].sum(0) for a, b in spans], np.int64)
        centre = total / np.diff(spans)
        radius = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(spans, centre, strict=True)])
        return cls(ids=ids[order], x=x, start=np.array(start), stop=np.array(stop), left=np.array(left), centre=centre, radius=radius, total=total)

    def row(self) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array([0, flat.size], pa.int32()), pa.array(flat.ravel(), kind, mask=self.no_id if name == "ids" else None)) for name, kind in self.FIELDS.items() for flat in [self.__dict__[name]]]

    #: Rows without an id.
    no_id: np.ndarray | None = None

    @classmethod
    def read(cls, batch: pa.RecordBatch, at: int, dim: int) -> BallTree:
        fields = {name: batch.column(name)[at].values for name in cls.FIELDS}
        ids = fields.pop("ids")
        tree = cls(**{name: values.to_numpy(zero_copy_only=False) for name, values in fields.items()})
        tree.x, tree.centre, tree.total = tree.x.astype(np.int64).reshape(-1, dim), tree.centre.reshape(-1, dim), tree.total.reshape(-1, dim)
        tree.ids = ids
        return tree

    def filter(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Balls taken whole and their centroids; rows of leaves that were not and theirs.

        By the triangle inequality every row of a ball is nearer to the centroid nearest to the ball's centre than to any
        that is farther from the centre by over twice the radius: such a centroid is left out for the ball and all in
        it. What rounding may add is allowed for, and ties are never left out. One centroid left takes the ball whole;
        otherwise its halves are looked at, and at a leaf each row's exact distances to what is left decide, ties to the
        smaller number."""
        balls, whole, rows, near = np.zeros(1, np.int64), [], [], []
        alive = np.ones((1, len(centroids)), bool)
        while len(balls):
            away = np.sqrt(((self.centre[balls][:, None] - centroids[None]) ** 2).sum(2))
            away[~alive] = np.inf
            limit = away.min(1) + 2 * self.radius[balls]
            alive &= away <= (limit * (1 + 1e-9) + 1e-6)[:, None]
            one, leaf = alive.sum(1) == 1, self.left[balls] < 0
            whole.append((balls[one], alive[one].argmax(1)))
            for ball, left in zip(balls[leaf & ~one], alive[leaf & ~one], strict=True):
                own, candidates = np.arange(self.start[ball], self.stop[ball]), np.flatnonzero(left)
                rows.append(own)
                near.append(candidates[squared_distances(self.x[own], centroids[candidates]).argmin(1)])
            inner = ~one & ~leaf
            halves = self.left[balls[inner]]
            balls, alive = np.r_[halves, halves + 1], np.concatenate([alive[inner], alive[inner]])
        taken = [np.concatenate(c) for c in zip(*whole, strict=True)]
        return *taken, *(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (rows, near))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows; by one product in doubles where they hold every term."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT_IN_DOUBLES and x.shape[1] <= 1024:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def whole_vectors(df: DataFrame, config: ClusterConfig, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of vectors with dim components, none null or non-finite; v is floor(scale * x), held to LARGEST."""
    limit = F.lit(float("inf"))
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    held = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x * config.scale))))).cast("int")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") == config.dim) & fine).withColumn("v", F.transform("v", held))


def first_centroids(vectors: DataFrame, config: ClusterConfig) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids; rows without an id are hashed as if it were empty."""
    digest = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("v", digest.alias("digest")).orderBy("digest", "v").limit(config.k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, config.dim)


def build_trees(config: ClusterConfig):
    """Trees over each run of tree_rows vectors of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tree() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows.column("vec_id").combine_chunks()
            x = np.concatenate([chunk.flatten().to_numpy() for chunk in rows.column("v").chunks]).astype(np.int64).reshape(-1, config.dim)
            made = BallTree.build(np.arange(len(x)), x, config.leaf_rows)
            made.no_id = ids.is_null().to_numpy(zero_copy_only=False)[made.ids]
            made.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)[made.ids]
            return pa.RecordBatch.from_arrays(made.row(), list(BallTree.FIELDS))

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, config.tree_rows - sum(b.num_rows for b in held))
                held.append(part)
                batch = batch.slice(part.num_rows)
                if sum(b.num_rows for b in held) == config.tree_rows:
                    yield tree()
                    held = []
        if held:
            yield tree()

    return run


def cluster_sums(centroids: np.ndarray):
    """For each centroid how many of a task's vectors are nearest to it, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                tree = BallTree.read(batch, at, centroids.shape[1])
                balls, of_balls, rows, of_rows = tree.filter(centroids)
                np.add.at(count, of_balls, tree.stop[balls] - tree.start[balls])
                np.add.at(total, of_balls, tree.total[balls])
                np.add.at(count, of_rows, 1)
                np.add.at(total, of_rows, tree.x[rows])
        met = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * centroids.shape[1], pa.int32()), pa.array(total[met].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(count[met]), sums], ["cluster", "n", "total"])

    return run


def nearest(centroids: np.ndarray):
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                tree = BallTree.read(batch, at, centroids.shape[1])
                balls, of_balls, rows, of_rows = tree.filter(centroids)
                cluster = np.zeros(len(tree.x), np.int64)
                cluster[rows] = of_rows
                for ball, centroid in zip(balls, of_balls, strict=True):
                    cluster[tree.start[ball] : tree.stop[ball]] = centroid
                distance = ((tree.x - centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([tree.ids, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def next_centroids(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids replaced by the floor of their vectors' mean; those without vectors stay. k sums reach the driver, as
    decimals, which no number of vectors leaves the range of."""
    parts = trees.mapInArrow(cluster_sums(centroids), "cluster int, n long, total array<long>")
    sums = [F.sum(F.col("total")[i].cast("decimal(19,0)")).alias(f"t{i}") for i in range(centroids.shape[1])]
    moved = centroids.copy()
    for cluster, n, *total in parts.groupBy("cluster").agg(F.sum("n"), *sums).collect():
        moved[cluster] = [int(t) // n for t in total]
    return moved


def cluster_vectors(vectors: DataFrame, config: ClusterConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    Vectors are turned into whole numbers, floor(scale * x), those beyond +-LARGEST counting as +-LARGEST. Vectors null,
    of another number of components, or with null or non-finite ones take no part. Rows that repeat, or have no id, take
    part each by itself. With fewer than k vectors each is a centroid; an empty table gives no rows. Equal distances go
    to the smaller number. Trees are built once, without a shuffle, and written; a round sends k centroids to the tasks
    and each task's k sums back.
    """
    config = config or ClusterConfig()
    usable = whole_vectors(vectors, config, id_col, vector_col)
    centroids = first_centroids(usable, config)
    if not len(centroids):
        return usable.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    trees = stored(usable.mapInArrow(build_trees(config), BallTree.SCHEMA), "balls")
    for _ in range(config.rounds):
        centroids = next_centroids(trees, centroids)
    return trees.mapInArrow(nearest(centroids), "vec_id long, cluster int, distance long"), centroids


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256; assigned is written first, as it is read twice."""
    spark = assigned.sparkSession
    rows = stored(assigned, "assigned")
    sums = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = [(i, sums.get(i, 0), sum(sums.values()), digest) for i, digest in enumerate(digests)]
    per_cluster = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
