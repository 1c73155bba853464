"""Exact top-k by inner product, pruned by segment statistics from coarse to fine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from .blocks import best, search_blocks, usable_vectors
from .common import stored


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row, sqrt(length) times the mean and the deviation of each segment; segments may differ by one in length.

    By Cauchy-Schwarz a segment's inner product is at most length * (mean * mean' + deviation * deviation'), and its
    squared distance at least length * ((mean - mean')^2 + (deviation - deviation')^2). So the inner product of two
    rows of statistics bounds that of the vectors from above, and their distance the vectors' from below.
    """
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    length = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / length
    # deviations from the mean are squared, not squares taken from each other: those would cancel
    deviation = np.sqrt(np.add.reduceat((x - np.repeat(mean, length, axis=1)) ** 2, edges[:-1], axis=1) / length)
    return np.concatenate([mean, deviation], 1) * np.sqrt(np.r_[length, length])


def rounding(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What rounding may take from a bound, at most: a part of the product of the lengths that grows with the number of
    components, and is much greater than any sum of so many roundings."""
    lengths = [np.sqrt((rows * rows).sum(1)) for rows in (q, x)]
    return 0.5 + (x.shape[1] + 16) * 2.0**-46 * np.outer(*lengths)


def large_rows(x: np.ndarray) -> np.ndarray:
    """Rows so large that doubles may not hold their inner products exactly: any two others' products are exact."""
    return np.abs(x).max(1, initial=0) > np.sqrt(2.0**53 / max(1, x.shape[1]))


def whole_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products by Python's integers, held to a long's range."""
    whole = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.clip(whole, 1 - 2**63, 2**63 - 1).astype(np.int64)


def compare_by_segments(levels: tuple[int, ...], tile: int = 256, head: int = 256):
    """A comparison for search_blocks, by rising numbers of segments. The `head` longest vectors are compared first: they
    set the floor that others' bounds have to reach. Rows that doubles can't multiply exactly are compared apart, so a
    few of them don't slow the others down."""

    def pruned(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(-(x * x).sum(1), kind="stable")
        ids, x = ids[order], x[order]
        statistics = [(segment_statistics(q, n), segment_statistics(x[head:], n)) for n in levels if n < x.shape[1]]
        for at in range(0, len(q), tile):
            rows = slice(at, at + tile)
            other = q_ids[rows, None] != ids[None, :]
            scores, alive = q[rows] @ x[:head].T, other[:, :head].copy()
            floor = np.full(len(other), -np.inf)
            if scores.shape[1] > k:
                # the k-th best of some is a floor for the k-th best of all; what ties with it is kept
                floor = -np.partition(np.where(alive, -scores, np.inf), k - 1, axis=1)[:, k - 1]
                alive &= scores >= floor[:, None]
            at_q, at_x = np.nonzero(alive)
            kept = [(at_q, at_x, scores[at_q, at_x])]
            if head < len(x):
                alive = other[:, head:].copy()
                for sq, sx in statistics:
                    columns = np.flatnonzero(alive.any(0))
                    alive[:, columns] &= sq[rows] @ sx[columns].T + rounding(q[rows], x[head + columns]) >= floor[:, None]
                columns = np.flatnonzero(alive.any(0))
                scores = q[rows] @ x[head + columns].T
                at_q, at_x = np.nonzero(alive[:, columns] & (scores >= floor[:, None]))
                kept.append((at_q, head + columns[at_x], scores[at_q, at_x]))
            at_q, at_x, score = (np.concatenate(c) for c in zip(*kept, strict=True))
            score = score.astype(np.int64)
            keep = best(at_q, score, ids[at_x], k)
            yield at_q[keep] + at, order[at_x[keep]], score[keep]

    def whole(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        for at in range(0, len(q), tile):
            scores = whole_products(q[at : at + tile], x)
            at_q, at_x = np.nonzero(q_ids[at : at + tile, None] != ids[None, :])
            score = scores[at_q, at_x]
            keep = best(at_q, score, ids[at_x], k)
            yield at_q[keep] + at, at_x[keep], score[keep]

    def compare(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        found = [(np.zeros(0, np.int64),) * 3]
        large_q, large_x = large_rows(q), large_rows(x)
        for which, own, theirs in ((pruned, ~large_q, ~large_x), (whole, ~large_q, large_x), (whole, large_q, np.ones(len(x), bool))):
            if own.any() and theirs.any():
                own, theirs = np.flatnonzero(own), np.flatnonzero(theirs)
                found += [(own[at_q], theirs[at_x], score) for at_q, at_x, score in which(q_ids[own], q[own], ids[theirs], x[theirs], k)]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    return compare


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, levels: tuple[int, ...] = (1, 4, 16), id_col: str = "vec_id", vector_col: str = "embedding", **blocks: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of floor(scale * x), exactly.

    is_query is a condition on the column `id`. Ties go to the smaller vec_id. Vectors null or with null or non-finite
    components take no part, nor do rows without an id; vectors are compared with those of as many components. Of
    several rows with one id the greatest vector counts. Components that scaling takes out of a double's range count as
    its greatest, and scores out of a long's range as the nearest long.
    """
    rows = stored(usable_vectors(vectors, id_col, vector_col), "vectors")
    return search_blocks(rows, is_query, k, _floored(compare_by_segments(levels), scale), "long", **blocks)


def _floored(compare, scale: int):
    def floored(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.floor(np.clip(x * scale, -np.finfo(float).max, np.finfo(float).max))

    return lambda q_ids, q, ids, x, k: compare(q_ids, floored(q), ids, floored(x), k)
