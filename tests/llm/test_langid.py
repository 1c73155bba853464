"""op12: code lengths against a plain PPM coder, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import langid

CONFIG = langid.LanguageConfig(order=3, contexts=300, least_seen=2, stretch=64)
SYLLABLES = {"aa": "lo mi ra né tu".split(), "bb": "sch ung er ün lo".split(), "cc": "ció que los ñe mi".split()}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


def plain_length(texts, text, config, nodes):
    """Bits of text by a coder that keeps counts in a dictionary; nodes: the contexts that the tree has."""
    follow = defaultdict(Counter)
    pad = langid.START * config.order
    for t in texts:
        for i in range(len(t)):
            before = pad + t[:i]
            for n in range(config.order + 1):
                context = before[len(before) - n :]
                if context not in nodes:
                    break
                follow[context][t[i]] += 1

    def probability(context, byte):
        seen = follow[context]
        shorter = probability(context[1:], byte) if context else 1 / 256
        if not seen:
            return shorter
        below = sum(seen.values()) + len(seen)
        return seen[byte] / below if seen[byte] else len(seen) / below * shorter

    bits = 0.0
    for i in range(len(text)):
        before = pad + text[:i]
        n = next(n for n in range(config.order, -1, -1) if all(before[len(before) - m :] in nodes for m in range(n + 1)))
        bits -= math.log2(probability(before[len(before) - n :], text[i]))
    return bits


def contexts_of(tree):
    names = {1: b""}
    for node in range(2, len(tree.parent)):
        names[node] = bytes([tree.symbol[node]]) + names[tree.parent[node]]
    return set(names.values())


@pytest.mark.parametrize("contexts", [2, 20, 300])
def test_code_lengths_are_those_of_a_plain_coder(contexts):
    rng = np.random.default_rng(4)
    config = langid.LanguageConfig(order=3, contexts=contexts, least_seen=2, stretch=50)
    texts = [prose("aa", 30, rng).encode() for _ in range(6)] + [b"", b"x"]
    tree = langid.ContextTree.fit(texts, config)
    nodes = contexts_of(tree)
    assert len(tree.parent) <= contexts and b"" in nodes
    model = langid.LanguageModel({"aa": tree.written()}, config)
    for text in (prose("aa", 40, rng).encode(), prose("bb", 5, rng).encode(), b"", b"q", bytes(range(256))):
        got = model.lengths([b"other", text, b"x"])[1, 0] / langid.UNITS
        assert got == pytest.approx(plain_length(texts, text, config, nodes), abs=len(text) / langid.UNITS + 1e-9)


def test_probabilities_never_exceed_one():
    rng = np.random.default_rng(6)
    tree = langid.ContextTree.fit([prose("cc", 200, rng).encode()], CONFIG)
    chance = 2.0 ** -(tree.code_lengths().reshape(-1, 256)[1:] / langid.UNITS)
    assert (chance.sum(1) <= 1.001).all() and (chance > 0).all()


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, prose(lang := "abc"[i % 3] * 2, int(rng.integers(4, 60)), rng), lang, "src") for i in range(n)]


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(500)
    odd = [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "12 3!", "bb", None), (None, rows[1][1], None, None), (1003, "ünsch " * 90_000, None, None), (1004, rows[2][1], None, None), (2, rows[2][1], "cc", "src")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string").selectExpr("*", "'q' AS lang_pred", "1 AS score", "2 AS least", "3 AS place", "4 AS id")
    model = langid.train_languages(docs, CONFIG)
    assert model.languages == ["aa", "bb", "cc"]
    found = langid.identify_languages(docs, model, ["doc_id", "lang"], lang_out="told", score_out="sure").collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r.sure <= 1 for r in found)
    told = {r.doc_id: (r.told, r.sure) for r in found}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 60 and np.mean([told[i][0] == lang for i, _, lang, _ in held]) > 0.97
    assert [told[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert told[1003][0] == "bb" and told[1004] == told[2] and told[None] == told[1]


def test_held_out_documents_lang_and_source_change_nothing(spark):
    rows = corpus(200)
    wrong = [(i, t if zlib.crc32(str(i).encode()) % 5 else "zzz " * 50, lang if zlib.crc32(str(i).encode()) % 5 else "aa", "other") for i, t, lang, _ in rows]
    schema = "doc_id long, text string, lang string, source string"
    one, two = (langid.train_languages(spark.createDataFrame(r, schema), CONFIG) for r in (rows, wrong))
    assert one.trees == two.trees


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "aa")], "doc_id long, text string, lang string")
    model = langid.train_languages(docs)
    assert [tuple(r) for r in langid.identify_languages(docs, model, ["doc_id"]).orderBy("doc_id").collect()] == [(1, "und", 0.0), (2, "und", 0.0)]
    assert langid.identify_languages(docs.limit(0), model, ["doc_id"]).collect() == []


def test_samples_are_bounded(spark):
    rows = [(i, "mira " * 400, "aa") for i in range(60)]
    small = langid.LanguageConfig(order=2, sample_documents=5, sample_bytes=40, least_seen=1)
    model = langid.train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), small)
    tree = langid.ContextTree.read(model.trees[0])
    root = tree.counts[tree.counts[:, 0] == 1]
    assert root[:, 2].sum() == 5 * 40
    assert spark.range(1).select(langid.held_out(F.lit(None))).head()[0] is True
