"""An audit of how sources differ in their vocabulary: document frequencies, an automaton's recount, pairs and ranks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, stored

#: Bytes of UTF-8 text that belong to terms: ASCII letters, of which A-Z are lower-cased, and all of non-ASCII
#: characters. Every other byte becomes the delimiter.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class AuditConfig:
    """Terms in least_docs documents of a language are kept; a share is 1 + floor(scale * (count + smoothing) / (total +
    smoothing * terms)). The rest bounds memory and changes no result: a kept vocabulary of up to broadcast_bytes is
    sent to all tasks, a larger one to blocks of about block_bytes of documents, each of which gets the terms that occur
    in it; a task holds at most held_entries counts before it passes them on; matrices have about matrix_terms terms and
    matrix_sources sources on each side."""

    least_docs: int = 30
    smoothing: int = 5
    scale: int = 1_000_000_000
    top: int = 50
    broadcast_bytes: int = 4 << 20
    block_bytes: int = 8 << 20
    held_entries: int = 200_000
    matrix_terms: int = 2048
    matrix_sources: int = 128


def flushed(held: dict[tuple, Counter], names: list[str]) -> pa.RecordBatch:
    """The counts held for each key as rows: the key's columns, term, n."""
    columns: list[list] = [[] for _ in names]
    for key, counts in held.items():
        for column, value in zip(columns, key, strict=False):
            column.extend([value] * len(counts))
        columns[-2].extend(counts.keys())
        columns[-1].extend(counts.values())
    types = [pa.string()] * (len(names) - 2) + [pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def count_documents(config: AuditConfig, keys: list[str]):
    """Of rows (keys..., text): for each of a task's keys, in how many of its documents each term occurs. Counts go on
    whenever many are held, and are added up after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = {}
        size = 0
        for batch in batches:
            *columns, texts = (batch.column(i) for i in range(len(keys) + 1))
            for *key, text in zip(*(c.to_pylist() for c in columns), texts, strict=True):
                counts = held.setdefault(tuple(key), Counter())
                before = len(counts)
                counts.update(set(text.as_py().translate(TERM_BYTES).split()))
                size += len(counts) - before
                if size > config.held_entries:
                    yield flushed(held, [*keys, "term", "n"])
                    held, size = {}, 0
        yield flushed(held, [*keys, "term", "n"])

    return run


class Vocabulary:
    """An automaton over kept terms, each between two delimiters, so that only whole terms match. A delimiter may end
    one match and begin the next; of the terms one at most ends at any place."""

    def __init__(self, terms: Iterable[bytes]):
        self.terms = sorted(terms)
        self.automaton = ahocorasick.Automaton()
        for at, term in enumerate(self.terms):
            self.automaton.add_word(f" {term.decode('latin-1')} ", at)
        if self.terms:
            self.automaton.make_automaton()

    def occurrences(self, text: bytes) -> Counter:
        """How often each term (by number) occurs. Bytes are read as characters, so UTF-8 needs no decoding."""
        if not self.terms:
            return Counter()
        return Counter(map(itemgetter(1), self.automaton.iter(f" {text.translate(TERM_BYTES).decode('latin-1')} ")))


class Recount:
    """Occurrences of kept terms by (lang, source), held up to a bound."""

    def __init__(self, config: AuditConfig):
        self.config, self.vocabularies, self.held, self.size = config, {}, {}, 0

    def add(self, lang: str, source: str, text: bytes) -> Iterator[pa.RecordBatch]:
        found = self.vocabularies.get(lang)
        if found is None:
            return
        counts = self.held.setdefault((lang, source), Counter())
        before = len(counts)
        counts.update(found.occurrences(text))
        self.size += len(counts) - before
        if self.size > self.config.held_entries:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        named = {key: {self.vocabularies[key[0]].terms[at]: n for at, n in counts.items()} for key, counts in self.held.items()}
        self.held, self.size = {}, 0
        return flushed(named, ["lang", "source", "term", "n"])


COUNTED = "lang string, source string, term binary, n long"


def recount_with_all_terms(rows: DataFrame, kept: DataFrame, config: AuditConfig) -> DataFrame:
    """Occurrences by one scan without a shuffle of texts; every task has the whole kept vocabulary, of checked size."""
    terms: dict[str, list[bytes]] = {}
    for lang, term in kept.select("lang", "term").collect():
        terms.setdefault(lang, []).append(bytes(term))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recount = Recount(config)
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
                if lang in terms and lang not in recount.vocabularies:
                    recount.vocabularies[lang] = Vocabulary(terms[lang])
                yield from recount.add(lang, source, text.as_py())
        yield recount.flush()

    return rows.select("lang", "source", "text").mapInArrow(run, COUNTED)


def recount_by_blocks(rows: DataFrame, kept: DataFrame, config: AuditConfig) -> DataFrame:
    """Occurrences where the kept vocabulary is too large to send around: documents are dealt into blocks by a hash, and
    each block's kept terms go to it. A block's terms come before its documents, which then stream past: memory is
    bounded by the terms that occur in a block, which are no more than its text has."""
    blocks = partitions_for(rows, config.block_bytes)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    local = dealt.select(F.col("block").cast("string").alias("block"), "lang", "text").mapInArrow(count_documents(config, ["block", "lang"]), "block string, lang string, term binary, n long")
    local = local.select(F.col("block").cast("int").alias("block"), "lang", "term").distinct().join(kept.select("lang", "term"), ["lang", "term"])
    texts = dealt.select("block", F.lit(1).alias("kind"), "lang", "source", "text")
    both = local.select("block", F.lit(0).alias("kind"), "lang", F.lit("").alias("source"), F.col("term").alias("text")).unionByName(texts)
    both = both.repartition(blocks, "block").sortWithinPartitions("block", "kind", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recount, terms, at = Recount(config), {}, None
        for batch in batches:
            for block, kind, lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if block != at:
                    yield recount.flush()
                    recount, terms, at = Recount(config), {}, block
                if kind == 0:
                    terms.setdefault(lang, []).append(text.as_py())
                    continue
                if lang in terms:
                    recount.vocabularies[lang] = Vocabulary(terms.pop(lang))
                yield from recount.add(lang, source, text.as_py())
        yield recount.flush()

    return both.mapInArrow(run, COUNTED)


def share(count: Column, total: Column, terms: Column, config: AuditConfig) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * terms)), by decimals: no product leaves their range."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = wide(count + config.smoothing) * F.lit(config.scale).cast("decimal(10,0)")
    below = wide(total) + wide(terms * config.smoothing)
    return F.when(terms > 0, F.call_function("div", above, below) + 1).otherwise(0)


def pair_excess(group: pa.Table) -> pa.Table:
    """Of rows (lang, left, right, source, side, base, term, p) of one block of terms and two blocks of sources: for each
    pair of sources how much the sum of |p - p'| over the block's terms exceeds |base - base'| a term."""
    names = ["lang", "a", "b", "excess"]
    source, number = np.unique(np.array(group.column("source").to_pylist(), object), return_inverse=True)
    side, base = np.zeros(len(source), np.int64), np.zeros(len(source), np.int64)
    side[number], base[number] = group.column("side").to_numpy(), group.column("base").to_numpy()
    has_term = group.column("term").is_valid().to_numpy(zero_copy_only=False)
    terms, term = np.unique(group.column("term").filter(pa.array(has_term)).to_numpy(zero_copy_only=False), return_inverse=True)
    p = np.repeat(base[:, None], len(terms), axis=1)
    p[number[has_term], term] = group.column("p").filter(pa.array(has_term)).to_numpy()
    left, right = group.column("left")[0].as_py(), group.column("right")[0].as_py()
    a, b, excess = [], [], []
    for i in np.flatnonzero(side == left):
        others = np.flatnonzero(side == right)
        others = others[others > i] if left == right else others
        a += [source[i]] * len(others)
        b += source[others].tolist()
        excess.append(np.abs(p[others] - p[i]).sum(1) - len(terms) * np.abs(base[others] - base[i]))
    excess = np.concatenate(excess) if excess else np.zeros(0, np.int64)
    return pa.Table.from_arrays([pa.array([group.column("lang")[0].as_py()] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(excess, pa.int64())], names)


def source_pairs(postings: DataFrame, groups: DataFrame, config: AuditConfig) -> DataFrame:
    """(lang, source, item, value) of all pairs of a language's sources, from postings (lang, source, term, p) and
    groups (lang, source, terms, base), base being the share of a term that doesn't occur.

    Postings are dealt into blocks of terms and pairs of blocks of sources, so that a group is a bounded matrix; only
    what a block adds to a pair leaves it. A pair's value is terms * |base - base'| plus what all blocks add."""
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("terms").alias("terms"))
    sizes = per_lang.select("lang", F.greatest(F.lit(1), F.ceil(F.col("terms") / config.matrix_terms)).cast("int").alias("nt"), F.ceil(F.col("sources") / config.matrix_sources).cast("int").alias("ns"))
    placed = groups.join(sizes, "lang").withColumn("side", F.pmod(F.xxhash64("source"), F.col("ns")).cast("int"))
    every = placed.select("lang", "source", "side", "ns", "base", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)).alias("at"), F.lit(None).cast("binary").alias("term"), F.lit(None).cast("long").alias("p"))
    own = postings.join(placed.select("lang", "source", "side", "ns", "nt", "base"), ["lang", "source"])
    own = own.select("lang", "source", "side", "ns", "base", F.pmod(F.xxhash64("term"), F.col("nt")).cast("int").alias("at"), "term", "p")
    both = every.unionByName(own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)))
    both = both.select("lang", "at", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"), "source", "side", "base", "term", "p")
    found = both.groupBy("lang", "at", "left", "right").applyInArrow(pair_excess, "lang string, a string, b string, excess long").groupBy("lang", "a", "b").agg(F.sum("excess").alias("excess"))
    of = lambda end: groups.select("lang", F.col("source").alias(end), F.col("base").alias(f"base_{end}"), F.col("terms").alias(f"terms_{end}"))
    value = F.col("terms_a") * F.abs(F.col("base_a") - F.col("base_b")) + F.col("excess")
    pairs = found.join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"]).withColumn("value", value)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    return pairs.select("lang", ways, "value").select("lang", "way.source", "way.item", "value")


def term_postings(rows: DataFrame, config: AuditConfig) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, term) and the postings (lang, source, term, n) of kept terms that occur, both written."""
    docs = rows.select("lang", "text").mapInArrow(count_documents(config, ["lang"]), "lang string, term binary, n long")
    kept = stored(docs.groupBy("lang", "term").agg(F.sum("n").alias("docs")).where(F.col("docs") >= config.least_docs).select("lang", "term"), "terms")
    size = kept.agg(F.sum(F.octet_length("term") + 4)).head()[0] or 0
    recount = recount_with_all_terms if size <= config.broadcast_bytes else recount_by_blocks
    counted = recount(rows, kept, config)
    return kept, stored(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "postings")


def audit_sources(docs: DataFrame, config: AuditConfig | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks, for each source of a language, the language's other
    sources by the sum over kept terms of the differences of their shares; part `term` ranks the terms that have a larger
    share in the source than in the language, the first `top` of them.

    Null text, lang and source count as empty strings. Rows that repeat count as often as they occur. A language without
    kept terms has pairs of value 0 and no terms; a language of one source has no pairs; an empty table gives no rows.
    Equal values are ranked by the UTF-8 bytes of the item. Texts of any length are read whole.
    """
    config = config or AuditConfig()
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(known(lang_col).alias("lang"), known(source_col).alias("source"), known(text_col).cast("binary").alias("text"), F.col(id_col).alias("id"))
    kept, postings = term_postings(rows, config)
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(of_lang, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "total"])
    groups = stored(groups.withColumn("base", share(F.lit(0), F.col("total"), F.col("terms"), config)), "groups")
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shares = postings.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("terms"), config).alias("p"))
    expected = shares.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(whole, "lang").join(of_lang, "lang")
    expected = expected.select("lang", "term", share(F.col("n"), F.col("lang_total"), F.col("terms"), config).alias("q"))
    terms = shares.join(expected, ["lang", "term"]).where(F.col("p") > F.col("q"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    pairs = source_pairs(shares.drop("n"), groups, config).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part: part.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= config.top))
