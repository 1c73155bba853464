"""op9 against brute force over all strings, and its parts against plain restatements."""

import random

import numpy as np
import pytest

from sheaf.llm import suffix


def brute(rows, least):
    smallest = {}
    for i, text in rows:
        data = (text or "").encode()
        key = suffix.LAST if i is None else i
        for s in range(len(data) - least + 1):
            w = data[s : s + least]
            smallest[w] = min(smallest.get(w, key), key)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        key = suffix.LAST if i is None else i
        gone = np.zeros(len(data) + 2, bool)
        for s in range(len(data) - least + 1):
            if smallest[data[s : s + least]] < key:
                gone[s + 1 : s + least + 1] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(data, gone[1:-1], strict=True) if not g)
        out.append((i, len(data), len(data) - len(kept), spans, kept))
    return sorted(out, key=str)


def corpus(seed, n=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 6)))
    passages = ["".join(word() for _ in range(rng.choice([12, 20, 60]))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += ["".join(word() for _ in range(rng.randint(0, 30))), p[a:] if rng.random() < 0.5 else p]
        rows.append((i, "".join(parts)))
    rows += [(n, "a" * 700), (n + 1, "a" * 300 + "b" + "a" * 49), (n + 2, None), (n + 3, ""), (n + 4, "ab" * 400), (n + 5, "x" + "ba" * 200), (n + 6, "\x00" * 80), (n + 7, "q" + "\x00" * 80), (n + 8, "a" * 49), (n + 9, "a" * 50)]
    rows += [(None, passages[2] * 2), (None, passages[2]), (3, passages[3]), (3, rows[3][1]), (3, rows[3][1]), (1000, rows[5][1]), (-5, rows[7][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "config"), [(1, suffix.SuffixConfig()), (2, suffix.SuffixConfig(least=20, anchor=8, bwt_bytes=2000)), (3, suffix.SuffixConfig(split=1)), (4, suffix.SuffixConfig(least=20, anchor=8, split=2))])
def test_against_brute_force(spark, seed, config):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as h", "'x' as places", "3 as id").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(docs, config).collect()]
    assert sorted(got, key=str) == brute(rows, config.least)
    assert suffix.remove_repeats(docs.limit(0), config).count() == 0


def test_contexts_that_agree_in_half_their_hash(spark):
    """Different contexts of one anchor whose hashes agree in their upper, or lower, 32 bits are not repeats."""
    config, rng = suffix.SuffixConfig(), np.random.default_rng(6)
    k, reach, width = config.anchor, config.reach, config.context
    grams = rng.integers(97, 123, (20_000, k)).astype(np.int16)  # the one with the smallest hash is an anchor wherever it stands
    middle = grams[suffix.Blocks(grams.ravel(), k).at(np.arange(len(grams)) * k, k, 1).argmin()]
    rows, hashes = [], []
    for _ in range(10):
        part = rng.integers(97, 123, (30_000, width)).astype(np.uint8)
        part[:, reach : reach + k] = middle
        rows.append(part)
        hashes.append(suffix.Blocks(part.ravel().astype(np.int16), width).at(np.arange(len(part)) * width, width, 2))
    rows, c = np.concatenate(rows), np.concatenate(hashes)
    assert len(np.unique(c)) == len(c)
    pairs = []
    for half in (c >> np.uint64(32), c & np.uint64(0xFFFFFFFF)):
        order = np.argsort(half, kind="stable")
        at = np.flatnonzero(np.diff(half[order]) == 0)
        pairs += [(rows[order[i]].tobytes().decode(), rows[order[i + 1]].tobytes().decode()) for i in at]
    assert len(pairs) > 10
    docs = [(i, text) for i, text in enumerate(text for pair in pairs for text in pair)]
    places = suffix.anchors([text.encode() for _, text in docs], config)[1]
    assert (places == reach).sum() == len(docs)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), config).collect()]
    assert sorted(got, key=str) == brute(docs, config.least)


def test_hot_anchors_are_spread():
    """Contexts of one anchor go to as many groups as they have different sides; those that share a string meet."""
    config, rng = suffix.SuffixConfig(), np.random.default_rng(3)
    made = np.zeros(2000, suffix._context_type(config))
    made["a"], made["n"] = 77, 1
    made["row"] = rng.integers(97, 123, (2000, config.context))
    made["row"][:, config.reach : config.reach + config.anchor] = 120
    made["row"][1, 5:55] = made["row"][0, 5:55]  # a string that reaches to the left, and one to the right
    made["row"][3, 30:80] = made["row"][2, 30:80]
    split, places = suffix._split(made, np.arange(2000, dtype=np.uint32), np.ones(2000, bool), config)
    assert len(split) == 4000 and len(np.unique(split["a"])) >= 3990
    by = {}
    for a, place in zip(split["a"].tolist(), places.tolist(), strict=True):
        by.setdefault(a, set()).add(place)
    assert {0, 1} in by.values() and {2, 3} in by.values() and max(map(len, by.values())) == 2


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        symbols = np.r_[rng.integers(5, 8, n - 1), 0] if n > 1 else np.array([0])
        order, rank = suffix.suffix_array(symbols)
        assert order.tolist() == sorted(range(n), key=lambda i: symbols[i:].tolist())
        assert (rank[order] == np.arange(n)).all()


def test_shared_strings():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, (30, 25)).astype(np.int16)
    rows[3, :6] = suffix.PAD
    rows[4, 20:] = suffix.PAD
    rows[5] = rows[6]
    group, context, start = suffix.shared_strings(rows, 9)
    got = {}
    for g, c, s in zip(group, context, start, strict=True):
        got.setdefault(g, set()).add((c, s))
    want = {}
    for c in range(30):
        for s in range(25 - 8):
            if (rows[c, s : s + 9] != suffix.PAD).all():
                want.setdefault(rows[c, s : s + 9].tobytes(), set()).add((c, s))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_anchors_cover_every_string():
    rng, config = random.Random(4), suffix.SuffixConfig(least=20, anchor=6)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (20, 25, 300, 60)]
    text, place, a, c = suffix.anchors(texts, config)
    have = [set(place[text == i].tolist()) for i in range(4)]
    for i, data in enumerate(texts):
        for s in range(len(data) - 19):
            assert any(p in have[i] for p in range(s, s + 15))


def test_whole_characters():
    data = "aéb€c".encode()
    assert suffix.whole_characters(data, [(2, 5)]) == "aé" + "€c"
    assert suffix.whole_characters(data, [(1, 7)]) == "a" + "c"
    assert suffix.whole_characters(data, []) == "aéb€c"


def test_findings_in_pieces():
    """Pieces hold all rows once, and a context's places stay together behind its first."""
    rng = np.random.default_rng(4)
    rows = np.zeros(900, suffix.FINDING)
    rows["k"], rows["place"] = np.repeat(rng.integers(0, 40, 300), 3), np.arange(900)
    rows["a"][300:], rows["n"][300::3] = 7, 3
    pieces = list(suffix.in_buckets(rows, 8, most=50))
    assert len(pieces) > 10
    seen = [np.frombuffer(x, suffix.FINDING) for p in pieces for x in p.column(1).to_pylist()]
    assert sorted(np.concatenate(seen)["place"].tolist()) == list(range(900))
    for part in seen:
        for at in np.flatnonzero(part["n"]):
            assert part["place"][at : at + 3].tolist() == list(range(part["place"][at], part["place"][at] + 3))
    assert sum(p.num_rows for p in suffix.in_buckets(rows, 8)) <= 8 and not list(suffix.in_buckets(rows[:0], 8))
