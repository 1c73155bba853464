"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, search_blocks, usable_vectors
from .common import sampled, stored


#: A code's first word is indexed in substrings of so many bits.
WORD, PART = 64, 16
PARTS = WORD // PART


@dataclass(frozen=True)
class Codes:
    """rotations: a learned rotation for each word of a code, up to 64 bits a word. The first word is indexed: codes
    whose first words differ in `near` bits at most are retrieved. Of these, codes that differ in `radius` bits at most
    in all words are compared as vectors."""

    rotations: np.ndarray
    near: int
    radius: int

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """The words of each code, as unsigned 64-bit integers: (rows, words)."""
        out = np.empty((len(unit), len(self.rotations)), np.uint64)
        for i, rotation in enumerate(self.rotations):
            bits = np.packbits(unit @ rotation > 0, axis=1)
            padded = np.zeros((len(unit), 8), np.uint8)
            padded[:, : bits.shape[1]] = bits
            out[:, i] = padded.view(np.uint64)[:, 0]
        return out


def part_radii(near: int) -> list[int]:
    """How far each substring is probed. Of two words that differ in `near` bits at most, one substring at least differs
    in no more than its radius: if all differed in one more, that would make near + 1 bits."""
    whole, more = divmod(near, PARTS)
    return [whole if i <= more else whole - 1 for i in range(PARTS)]


def unit_rows(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(1, keepdims=True)
    x = x / largest  # keeps the squares of very small and very large components in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def learn_codes(sample: np.ndarray, words: int = 4, rounds: int = 25, k: int = 5, near_recall: float = 0.95, recall: float = 0.98, seed: int = 0) -> Codes:
    """Rotations by iterative quantization from different starts, and the radii that hold the given shares of the
    sample's true k nearest neighbours. Neighbours are farther apart in a sample than among all vectors, so the radii
    err to the safe side."""
    rng, x = np.random.default_rng(seed), unit_rows(sample)
    dim = x.shape[1]
    axes = np.linalg.eigh(x.T @ x)[1].T
    rotations = []
    for _ in range(words):
        turn = np.linalg.qr(rng.normal(size=(dim, min(dim, WORD))))[0]
        turn = axes.T @ turn
        for _ in range(rounds):
            left, _, right = np.linalg.svd(x.T @ np.where(x @ turn > 0, 1.0, -1.0), full_matrices=False)
            turn = left @ right
        rotations.append(turn)
    codes = Codes(np.array(rotations), 0, 0)
    packed, first, every = codes.encode(x), [], []
    for at in range(0, min(len(x), 1024), 256):
        similar = x[at : at + 256] @ x.T
        similar[np.arange(len(similar)), at + np.arange(len(similar))] = -np.inf
        top = np.argsort(-similar, axis=1)[:, : min(k, len(x) - 1)]
        distance = np.bitwise_count(packed[at : at + 256, None, :] ^ packed[top])
        first.append(distance[:, :, 0].ravel().astype(int))
        every.append(distance.sum(2, dtype=int).ravel())
    held = lambda found, share: int(np.ceil(np.quantile(np.concatenate(found), share))) if found and np.concatenate(found).size else 0
    return Codes(codes.rotations, held(first, near_recall), held(every, recall))


@cache
def flips(radius: int) -> np.ndarray:
    """All substrings with `radius` set bits at most: what a probe of that radius flips."""
    every = np.arange(1 << PART, dtype=np.uint16)
    return every[np.bitwise_count(every) <= radius] if radius >= 0 else every[:0]


class SubstringTables:
    """A table for each substring of the first word: the codes in order of their substring, and where each value begins."""

    def __init__(self, words: np.ndarray):
        self.parts = words.view(np.uint16).reshape(-1, PARTS)
        self.order = [np.argsort(self.parts[:, i], kind="stable") for i in range(PARTS)]
        self.begin = [np.concatenate([[0], np.cumsum(np.bincount(self.parts[:, i], minlength=1 << PART))]) for i in range(PARTS)]

    def probe(self, word: np.ndarray, radii: list[int]) -> np.ndarray:
        """Which codes lie in a bucket that is probed for this word: every bucket of each table within its radius."""
        seen = np.zeros(len(self.parts), bool)
        for i, own in enumerate(word.reshape(1).view(np.uint16)):
            bucket = flips(radii[i]) ^ own
            low, high = self.begin[i][bucket], self.begin[i][bucket.astype(np.int64) + 1]
            some = np.flatnonzero(high > low)
            low, count = low[some], high[some] - low[some]
            place = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            seen[self.order[i][place]] = True
        return np.flatnonzero(seen)


def compare_by_codes(codes: dict[int, Codes]):
    """A comparison for search_blocks: each block of vectors has its own substring tables."""

    def compare(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        coder = codes.get(x.shape[1])
        q, x = unit_rows(q), unit_rows(x)
        if coder is None:  # a number of components that the sample doesn't have: all codes are equal
            coder = Codes(np.zeros((1, x.shape[1], 0)), 0, 0)
        qc, xc = coder.encode(q), coder.encode(x)
        tables, radii = SubstringTables(np.ascontiguousarray(xc[:, 0])), part_radii(coder.near)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(len(q)):
            at = tables.probe(qc[i, :1], radii)
            at = at[ids[at] != q_ids[i]]
            at = at[np.bitwise_count(xc[at, 0] ^ qc[i, 0]) <= coder.near]
            at = at[np.bitwise_count(xc[at] ^ qc[i]).sum(1, dtype=np.int64) <= coder.radius]
            if len(at) < k:  # too few: as far as the k-th nearest code
                distance = np.bitwise_count(xc ^ qc[i]).sum(1, dtype=np.int64)
                distance[ids == q_ids[i]] = np.iinfo(np.int64).max
                kth = np.partition(distance, min(k, len(distance)) - 1)[min(k, len(distance)) - 1]
                at = np.flatnonzero((distance <= kth) & (ids != q_ids[i]))
            score = np.einsum("d,id->i", q[i], x[at])
            top = best(np.zeros(len(at), int), score, ids[at], k)
            found.append((np.full(len(top), i), at[top], score[top]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    return compare


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, sample_rows: int = 4096, near_recall: float = 0.95, recall: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 4096, vector_block: int = 1 << 16) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by cosine, scored on the original vectors.

    Vectors go to blocks; in each block a query probes the four substring tables of the first word, which by the
    pigeonhole principle retrieves every code within the learned radius, and what all words leave is compared as vectors.
    How much that saves depends on the data: on vectors without any structure, whose nearest neighbours are nearly as
    far as any other, the radius is large and most buckets are probed.

    The rotations are learned from at most sample_rows vectors, chosen by a hash of their ids; every vector is indexed.
    is_query is a condition on the column `id`. Ties go to the smaller vec_id. Vectors null, zero or with null or
    non-finite components take no part, nor do rows without an id; of several rows with one id the greatest vector
    counts. A query gets all other vectors if there are k or fewer.
    """
    rows = stored(usable_vectors(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0)), "vectors")
    sample: dict[int, list] = {}
    for r in sampled(rows.select("id", "v"), F.xxhash64("id", F.lit(5)), sample_rows, rows.count()).collect():
        sample.setdefault(len(r.v), []).append(r.v)
    codes = {dim: learn_codes(np.array(v), k=k, near_recall=near_recall, recall=recall) for dim, v in sample.items() if len(v) > 1}
    return search_blocks(rows, is_query, k, compare_by_codes(codes), "double", query_block, vector_block)
