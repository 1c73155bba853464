"""op4 and op8 against brute force, with odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 24)).astype(np.float32)
    x[100:140] = x[3]
    x[140:150] = -x[3]
    made = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    made += [(700, None, 1), (720, [nan] + [0.0] * 23, 1), (740, [None] + [1.0] * 23, 1), (760, [inf] + [1.0] * 23, 1), (None, [1.0] * 24, 1), (800, [0.0] * 24, 2), (820, [1.0, 2.0], 1), (821, [2.0, -1.0], 1), (840, [], 1), (5, made[5][1], 1)]
    return made


def good(rows):
    out = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            out[i] = v
    return out


def test_top_k_is_exact(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as v", "3 as score")
    have = {i: [math.floor(64 * c) for c in v] for i, v in good(rows).items()}
    want = set()
    for q in (i for i in have if i % 20 == 0):
        near = sorted((-sum(a * b for a, b in zip(have[q], v, strict=True)), i) for i, v in have.items() if i != q and len(v) == len(have[q]))[:20]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(near)}
    for blocks in ({}, {"query_block": 9, "vector_block": 64}):
        got = topk.exact_top_k(frame, F.col("id") % 20 == 0, **blocks)
        assert {tuple(r) for r in got.collect()} == want
    assert topk.exact_top_k(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_top_k_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    x = np.floor(64 * (rng.normal(size=(5000, 1)) + 0.1 * rng.normal(size=(5000, 64))))
    ids = rng.permutation(5000)
    at_q, at_x, score = topk.compare_by_segments((1, 4, 16))(ids[:50], x[:50], ids, x, 20)
    whole = (x[:50] @ x.T).astype(np.int64)
    for q in range(50):
        want = sorted((-whole[q, j], ids[j]) for j in range(5000) if j != q)[:20]
        assert [(-s, i) for s, i in want] == list(zip(score[at_q == q], ids[at_x[at_q == q]], strict=True))


def test_top_k_of_huge_components(spark):
    frame = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1e300, -1e300])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.exact_top_k(frame, F.col("id") >= 0).collect()}
    assert got[0, 1] == (64 * 10**9) ** 2 - 0 + 64 * 128 if (64 * 10**9) ** 2 < 2**63 else got[0, 1] == 2**63 - 1


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(40, 30)), rng.normal(size=(60, 30))
    for n in (1, 2, 7, 30):
        a, b = topk.segment_statistics(q, n), topk.segment_statistics(x, n)
        assert (a @ b.T + 1e-9 >= q @ x.T).all()
        assert ((a[:, None] - b[None]) ** 2).sum(2).max() <= ((q[:, None] - x[None]) ** 2).sum(2).max() + 1e-9
        assert (((a[:, None] - b[None]) ** 2).sum(2) <= ((q[:, None] - x[None]) ** 2).sum(2) + 1e-9).all()


def test_neighbours_recall(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as v")
    have = {i: np.array(v) / np.linalg.norm(v) for i, v in good(rows).items() if any(v)}
    found = {}
    for r in ann.nearest_neighbours(frame, F.col("id") % 20 == 0, vector_block=200).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {i for i in have if i % 20 == 0}
    hits = total = 0
    for q, near in found.items():
        every = sorted((-float(have[q] @ v), i) for i, v in have.items() if i != q and len(v) == len(have[q]))
        assert len(near) == min(5, len(every))
        assert [(-s, i) for i, s in near] == sorted((-s, i) for i, s in near)
        for i, s in near:
            assert abs(s - float(have[q] @ have[i])) < 1e-12
        hits += sum(s >= -every[len(near) - 1][0] - 1e-12 for _, s in near)
        total += len(near)
    assert hits >= 0.9 * total
    assert ann.nearest_neighbours(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = words[:10].copy()
    for i in range(10):  # codes at known distances from the first ten
        for bit in rng.choice(64, i, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(bit)
    words = np.concatenate([words, near])
    tables = ann.SubstringTables(words)
    for radius in (0, 3, 9, 22, 26):
        radii = ann.part_radii(radius)
        assert sum(r + 1 for r in radii) == radius + 1
        for q in words[:10]:
            within = np.flatnonzero(np.bitwise_count(words ^ q) <= radius)
            assert set(within) <= set(tables.probe(np.array([q]), radii))


def test_probes_read_few_buckets_of_clustered_vectors(spark):
    """Where neighbours are near, most codes aren't looked at; over several blocks all true neighbours are found."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 64))
    x = np.repeat(centres, 8, axis=0) + 0.05 * rng.normal(size=(2400, 64))
    codes = ann.learn_codes(x)
    packed = codes.encode(ann.unit_rows(x))
    tables = ann.SubstringTables(np.ascontiguousarray(packed[:, 0]))
    probed = np.mean([len(tables.probe(packed[i, :1], ann.part_radii(codes.near))) for i in range(0, 2400, 50)])
    assert probed < 0.1 * len(x)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA.split(", ")[0] + ", embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(frame, F.col("id") % 50 == 0, vector_block=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = ann.unit_rows(x)
    hits = sum(len(got[q] & set(np.argsort(-np.where(np.arange(len(x)) == q, -9, unit @ unit[q]))[:5].tolist())) for q in got)
    assert hits >= 0.95 * 5 * len(got) and len(got) == 48


def test_ties_and_equal_directions(spark):
    """Vectors that are equal, also up to scale by a power of two, tie; the smaller ids come first."""
    rows = [(i, [float(2 ** (i % 3)), 0.0]) for i in range(20)] + [(100 + i, [0.0, 1.0]) for i in range(5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(frame, F.col("id") == 7, k=5, vector_block=8).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {7: [(i, 1.0) for i in range(5)]}
    top = [r.vec_id for r in topk.exact_top_k(frame.union(frame), F.col("id") == 101, k=20, vector_block=8).orderBy("rank").collect()]
    assert top == [100, 102, 103, 104, *range(16)]


def test_top_k_with_outliers_and_many_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 24)) * np.linspace(0.1, 3, 1500)[:, None]
    x[7], x[60], x[80] = 1e12, -1e307, 1.7e308
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    clipped = np.floor(np.clip(x * 64, -np.finfo(float).max, np.finfo(float).max))
    whole = [[int(v) for v in r] for r in clipped]
    got = {}
    for r in topk.exact_top_k(frame, F.col("id") % 20 == 0, query_block=30, vector_block=400).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 1500, 20):
        scores = [(-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in enumerate(whole) if i != q]
        assert got[q] == [(i, -s) for s, i in sorted(scores)[:20]]


def test_bounds_of_large_and_nearly_equal_components():
    """Segments whose variance is far below the square of their mean: differences of squares would lose it."""
    rng = np.random.default_rng(12)
    for made in range(60):
        x = np.full((60, 100), 6_700_698.0 + made)
        x[np.arange(20, 50), rng.integers(2, 100, 30)] -= 1 + made % 3
        x[0, 0] += 1  # the longest, with a small product
        q = rng.integers(1000, 8000, (4, 100)).astype(float) * rng.choice([-1, 1], (4, 100))
        q[:, 0] = 10
        q[:, 1] -= q.sum(1)
        assert not topk.large_rows(x).any()
        ids, q_ids, k = np.arange(60), np.arange(100, 104), 1 + made % 4
        at_q, at_x, score = topk.compare_by_segments((1, 4, 16), head=8)(q_ids, q, ids, x, k)
        want = topk.whole_products(q, x)
        for i in range(4):
            best = sorted((-s, j) for j, s in enumerate(want[i].tolist()))[:k]
            got = sorted((-s, j) for a, j, s in zip(at_q.tolist(), at_x.tolist(), score.tolist(), strict=True) if a == i)[:k]
            assert got == best
