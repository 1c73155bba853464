"""op7 against brute force over all pairs, with groups of copies, chains and odd rows."""

import random
import re

import numpy as np
import pytest

from sheaf.llm import graph, neardup


def plain_set(text, words):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    size = min(words, len(parts))
    return {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)} if parts else set()


def brute(rows, words, percent=80):
    sets = {i: plain_set(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 12, 40, 150]))]
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4])):
            near = list(words)
            for _ in range(rng.randint(0, max(1, len(near) // 25))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append("\t".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    chain = [f"w{i}" for i in range(60)]
    for step in range(25):  # each is near the next, first and last are far apart
        rows.append(" ".join(chain))
        chain[rng.randrange(60)] = f"c{step}"
    rows += ["", None, " \n\t ", "same", "same", "Same", "a b", "long " * 4000 + "end", "long " * 4000 + "end."]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("words", "blocks"), [(2, {"together": 2, "block": 3}), (5, {})])
def test_against_brute_force(spark, words, blocks):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as node", "3 as key", "4 as component")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, neardup.NearDupConfig(words=words, **blocks)).collect()}
    assert got == brute(rows, words)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "one two three"), (4, "one two three"), (9, "one two three"), (9, "one two three"), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, neardup.NearDupConfig(words=2)).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (4, 2, 4, True), (9, 2, 4, False), (9, 2, 4, False), (7, 0, 7, True)], key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    config = neardup.NearDupConfig()
    sketch, rng = neardup.SetSketch(config), np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(2))
    r = sketch.registers([a, b, np.concatenate([a, b])])
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    for share in (0.3, 0.6, 0.8, 0.95):
        n = 2000
        common = int(2 * n * share / (1 + share))
        found = []
        for _ in range(20):
            x = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            r = sketch.registers([x[:n], np.concatenate([x[:common], x[n : 2 * n - common]])])
            found.append(neardup.estimate(r[:1], r[1:], np.array([n]), np.array([n]), config.base)[0])
        assert abs(np.mean(found) - share) < 0.03


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000 + i) for i in range(1, 50)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


def test_bands_of_pairs_at_the_threshold():
    """Sets at a similarity of exactly 0.8 share as many bands as independent registers would: none is lost, and the spread
    is a binomial's, so that the stated share of lost pairs holds."""
    config, rng = neardup.NearDupConfig(), np.random.default_rng(12)
    sketch, n = neardup.SetSketch(config), 3000
    hits, ruled_out = [], 0
    for _ in range(n // 500):
        sets = []
        for _ in range(500):
            every = rng.integers(0, 2**64, 500, dtype=np.uint64)
            sets += [every[:450], np.concatenate([every[:400], every[450:]])]
        registers = sketch.registers(sets)
        keys = sketch.keys(registers)
        hits.append((keys[::2] == keys[1::2]).sum(1))
        likely = neardup.estimate(registers[::2], registers[1::2], np.full(500, 450.0), np.full(500, 450.0), config.base)
        ruled_out += int((likely < neardup._least_estimate(config)).sum())
    hits = np.concatenate(hits)
    share = hits.mean() / config.bands
    assert hits.min() >= 1 and share > 0.8**config.band_size
    assert 0.8 < hits.var() / (config.bands * share * (1 - share)) < 1.25
    assert not ruled_out
