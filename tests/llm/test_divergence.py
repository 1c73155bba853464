"""op13: both ways to recount against brute force, blocks of terms and sources, odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sheaf.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string"


def brute(rows, least, top=50):
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    found = []
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        seen[lang].update(set(terms))
        found.append((lang, source, terms))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in seen.items()}
    for lang, source, terms in found:
        counts[lang, source].update(t for t in terms if t in kept[lang])
        counts[lang, None].update(t for t in terms if t in kept[lang])

    def p(key):
        v, n = len(kept[key[0]]), sum(counts[key].values())
        return {t: 1 + 10**9 * (counts[key][t] + 5) // (n + 5 * v) for t in kept[key[0]]}

    shares, out = {key: p(key) for key in [*groups, *((lang, None) for lang in kept)]}, []
    for lang, source in groups:
        own = shares[lang, source]
        pairs = [(s, sum(abs(own[t] - shares[lang, s][t]) for t in own)) for la, s in groups if la == lang and s != source]
        terms = [(t, own[t] - shares[lang, None][t]) for t in own if counts[lang, source][t] and own[t] > shares[lang, None][t]]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(items[:limit])]
    return sorted(out)


def corpus(n, sources, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{''.join(rng.choice(list('abcdeéß'), rng.integers(1, 5)))}" for _ in range(120)] + ["The", "THE", "ÉCOLE", "x"]
    weights = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(n):
        picked = rng.choice(words, rng.integers(0, 40), p=weights / weights.sum())
        source = "hot" if i % 3 == 0 else f"s{int(rng.integers(0, sources))}"
        rows.append((i, "".join(w + str(rng.choice([" ", ", ", "-", "\n", "1", "\x00"])) for w in picked), ["en", "fr", "de"][i % 3] if i % 7 else "en", source))
    return rows


def result(spark, rows, **config):
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS term", "2 AS n", "3 AS p", "4 AS value", "5 AS block")
    frame = divergence.audit_sources(docs, divergence.AuditConfig(**config))
    assert dict(frame.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


ODD = [(900, None, "en", "hot"), (901, "", None, None), (None, "The the THE", "en", None), (902, "wa " * 40_000, "fr", ""), (903, "Lone", "xx", "only"), (903, "Lone", "xx", "only"), (904, None, "xx", "other")]


@pytest.mark.parametrize("config", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "block_bytes": 500, "held_entries": 40}, {"matrix_terms": 7, "matrix_sources": 3, "held_entries": 25, "top": 4}])
def test_against_brute_force(spark, config):
    rows = corpus(240, 9) + ODD
    assert result(spark, rows, least_docs=5, **config) == brute(rows, 5, config.get("top", 50))


def test_no_kept_terms_and_no_rows(spark):
    rows = [(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, None, None, "z")]
    assert result(spark, rows) == brute(rows, 30) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert result(spark, []) == []


def test_shares_of_counts_beyond_a_long_product(spark):
    n, total, terms = 9_000_000_000_000, 31_000_000_000_000_007, 4_000_000
    frame = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    got = frame.select(divergence.share(*(divergence.F.col(c) for c in ("n", "total", "terms")), divergence.AuditConfig())).head()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_a_delimiter_is_shared_by_neighbours():
    found = divergence.Vocabulary([b"a", b"ab", "é".encode()])
    assert [found.terms[k] for k in found.occurrences("ab a.A é1éa".encode()).elements()].count(b"a") == 2
    assert found.occurrences(b"") == Counter() == divergence.Vocabulary([]).occurrences(b"a")
