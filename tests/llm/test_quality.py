"""op6: gradients against differences, pooling against brute force, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest

from sheaf.llm import quality

SMALL = quality.QualityConfig(epochs=6, filters=12, hidden=6)


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["stone", "river", "and", "the", "light", "over", "small", "was", "a", "garden"]
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        text = " ".join(rng.choice(words, rng.integers(8, 120))).replace(" and", ", and").capitalize() + "."
        rows.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text, int(not bad)))
    return rows


def test_slopes_are_those_of_the_loss():
    model = quality.ByteConvolution(SMALL)
    model.weights = {k: v.astype(float) for k, v in model.weights.items()}
    texts, y = [t.encode() for _, t, _ in corpus(5)], np.array([0, 1, 1, 0, 1.0])

    def loss():
        z = model.logits(texts)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    slopes = model.slopes(texts, y)
    rng = np.random.default_rng(1)
    for name, w in model.weights.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if name == "E" and at[0] == quality.PAD:
                continue
            w[at] += 1e-5
            up = loss()
            w[at] -= 2e-5
            down = loss()
            w[at] += 1e-5
            assert abs((up - down) / 2e-5 - slopes[name][at]) < 1e-4


def test_pooling_covers_the_whole_text():
    model, c = quality.ByteConvolution(SMALL), SMALL
    text = np.random.default_rng(3).integers(32, 127, 3000, dtype=np.uint8).tobytes()
    row, blocks = model.laid_out([text])
    got = model.block_maxima(row)
    for b in range(int(blocks[0])):
        z = [model.weights["E"][row[p : p + c.width]].ravel() @ model.weights["W"] + model.weights["c"] for p in range(b * c.block, (b + 1) * c.block, c.stride)]
        assert np.allclose(np.maximum(np.max(z, 0), 0), got[b], atol=1e-4)
    assert blocks[0] * c.block >= len(text)
    one, many = model.scores([text])[0], model.scores([b"x" * 700, text, b""])[1]
    assert abs(one - many) < 1e-6


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, ""), (1001, None), (None, "stone"), (1002, "river " * 30000), (3, rows[3][1])], "doc_id long, text string").selectExpr("*", "1 as y", "2 as id", "0.5D as quality")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, None), (5, None, None)], "doc_id long, quality int, text string")
    model = quality.train_quality(docs, labels, SMALL)
    scored = quality.score_quality(docs, model, ["doc_id"]).withColumn("held", quality.held_out(__import__("pyspark").sql.functions.col("doc_id"))).collect()
    assert len(scored) == 605 and all(0 <= r.score <= 1 for r in scored)
    truth = {i: y for i, _, y in rows}
    held = [r for r in scored if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held for r in held) and len(held) > 60
    assert np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in held]) > 0.97


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for rows in ([], [(1, 1)]):
        model = quality.train_quality(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert model is None
        assert quality.score_quality(docs, model, ["doc_id"]).head().score == 0.5
    assert quality.score_quality(docs.limit(0), None, ["doc_id"]).count() == 0


def test_held_out_labels_change_nothing(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    tiny = quality.QualityConfig(epochs=1, least_steps=1, filters=4, hidden=2)
    a = quality.train_quality(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"), tiny)
    b = quality.train_quality(docs, spark.createDataFrame(flip, "doc_id long, quality int"), tiny)
    assert a.scores([b"some text"])[0] == pytest.approx(b.scores([b"some text"])[0])
