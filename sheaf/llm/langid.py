"""Language identification by prediction by partial matching: code lengths under context trees with frozen counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands for a language where there is nothing to tell one by.
UNDETERMINED = "und"
#: Code lengths are whole numbers of this part of a bit, so sums are the same however texts are dealt out.
UNITS = 1 << 16
#: What stands before the first byte of every text.
START = b"\n"


@dataclass(frozen=True)
class LanguageConfig:
    """Contexts of up to `order` bytes, those seen least_seen times in training, at most `contexts` a language (the most
    frequent ones). Trained on at most sample_documents documents of each language, chosen by a hash of their ids, of
    each a stretch of at most sample_bytes bytes that begins at a place set by that hash; of more than `languages`
    languages the most frequent ones are learned. Scoring reads all bytes of all texts, `stretch` bytes at a time."""

    order: int = 4
    contexts: int = 4096
    least_seen: int = 4
    sample_documents: int = 400
    sample_bytes: int = 2048
    languages: int = 256
    stretch: int = 1 << 18


class ContextTree:
    """Contexts of one language as a trie that is walked back from the byte before the one that is coded.

    Node 1 is the empty context, node 0 stands for contexts that aren't in the tree; numbers grow with length. Of each
    context the tree keeps how often each byte followed it. With a context seen total times before `distinct` different
    bytes, a byte seen n times there has the probability n / (total + distinct), and others share the escape,
    distinct / (total + distinct), as the context one byte shorter has it; below the empty one all bytes are alike.
    """

    def __init__(self, parent: np.ndarray, symbol: np.ndarray, counts: np.ndarray):
        """parent and symbol of each node, the first two apart, and counts as rows (node, byte, times)."""
        self.parent, self.symbol, self.counts = parent.astype(np.int32), symbol.astype(np.uint8), counts.astype(np.int32)

    @classmethod
    def fit(cls, texts: list[bytes], config: LanguageConfig) -> ContextTree:
        row = np.frombuffer(b"".join(START * config.order + t for t in texts), np.uint8).astype(np.int64)
        lengths = np.array([len(t) + config.order for t in texts], np.int64)
        begins = np.cumsum(lengths) - lengths
        coded = np.ones(len(row), bool)
        for i in range(config.order):
            coded[begins + i] = False
        at = np.flatnonzero(coded)
        seen = []  # contexts of each length, the byte nearest to what is coded lowest, and how often each was seen
        for length in range(1, config.order + 1):
            key = sum(row[at - i - 1] << (8 * i) for i in range(length))
            found, times = np.unique(key, return_counts=True)
            seen.append((np.full(len(found), length), found, times))
        length, key, times = (np.concatenate(c) for c in zip(*seen, strict=True)) if len(at) else (np.zeros(0, np.int64),) * 3
        enough = np.flatnonzero(times >= config.least_seen)
        # a context is never seen more often than what it extends, so the most frequent ones form a trie
        enough = enough[np.lexsort((key[enough], length[enough], -times[enough]))][: config.contexts - 2]
        enough = enough[np.lexsort((key[enough], length[enough]))]
        number = {(0, 0): 1} | {(int(n), int(k)): i + 2 for i, (n, k) in enumerate(zip(length[enough], key[enough], strict=True))}
        parent, symbol = np.zeros(len(number) + 1, np.int64), np.zeros(len(number) + 1, np.int64)
        for (n, k), node in number.items():
            if n:
                parent[node], symbol[node] = number[n - 1, k & ((1 << 8 * (n - 1)) - 1)], k >> (8 * (n - 1))
        tree = cls(parent, symbol, np.zeros((0, 3)))
        # every context of a byte counts it, not the longest alone
        pairs, path = [], np.ones(len(at), np.int64)
        child = tree.children()
        for i in range(config.order + 1):
            pairs.append(path[path > 0] * 256 + row[at[path > 0]])
            if i < config.order:
                path = child[path * 256 + row[at - i - 1]] // 256
        found, times = np.unique(np.concatenate(pairs), return_counts=True)
        return cls(parent, symbol, np.stack([found // 256, found % 256, times], 1))

    def children(self) -> np.ndarray:
        """256 times the node of each node's context made longer by a byte, 0 if the tree doesn't have it."""
        child = np.zeros(len(self.parent) * 256, np.int32)
        nodes = np.arange(2, len(self.parent))
        child[self.parent[2:].astype(np.int64) * 256 + self.symbol[2:]] = nodes * 256
        return child

    def code_lengths(self) -> np.ndarray:
        """Of each node and byte, in units: minus the binary logarithm of the byte's probability."""
        n = np.zeros((len(self.parent), 256))
        n[self.counts[:, 0], self.counts[:, 1]] = self.counts[:, 2]
        total, distinct = n.sum(1), (n > 0).sum(1)
        probability = np.full(n.shape, 1 / 256)
        for node in range(1, len(n)):  # shorter contexts come first
            if distinct[node]:
                below = probability[self.parent[node]]
                probability[node] = np.where(n[node] > 0, n[node], distinct[node] * below) / (total[node] + distinct[node])
        return np.rint(-np.log2(probability) * UNITS).astype(np.int32).ravel()

    def written(self) -> bytes:
        sizes = np.array([len(self.parent), len(self.counts)], np.int32)
        return sizes.tobytes() + self.parent.tobytes() + self.counts.tobytes() + self.symbol.tobytes()

    @classmethod
    def read(cls, data: bytes) -> ContextTree:
        nodes, counts = np.frombuffer(data, np.int32, 2).tolist()
        table = np.frombuffer(data, np.int32, 3 * counts, 8 + 4 * nodes).reshape(-1, 3)
        return cls(np.frombuffer(data, np.int32, nodes, 8), np.frombuffer(data, np.uint8, nodes, 8 + 4 * nodes + 12 * counts), table)


class LanguageModel:
    """The trees of all learned languages, by name. Tables are made where they are first used and never sent."""

    def __init__(self, trees: dict[str, bytes], config: LanguageConfig):
        self.languages, self.config = sorted(trees), config
        self.trees = [trees[lang] for lang in self.languages]
        self.tables: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each whole text in each language, in units."""
        if self.tables is None:
            read = [ContextTree.read(data) for data in self.trees]
            self.tables = [(tree.children(), tree.code_lengths()) for tree in read]
        order, out = self.config.order, np.zeros((len(texts), len(self.trees)), np.int64)
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            padded = START * order + text
            for at in range(0, len(text), self.config.stretch):
                piece = padded[at : at + self.config.stretch + order]
                held.append((i, piece))
                size += len(piece)
                if size > self.config.stretch:
                    self.add(held, out)
                    held, size = [], 0
        self.add(held, out)
        return out

    def add(self, pieces: list[tuple[int, bytes]], out: np.ndarray) -> None:
        """Adds the code lengths of pieces, each with `order` bytes before it, to their texts' lengths. The longest
        context in the tree is the one with the largest number that a walk back from the byte meets."""
        if not pieces:
            return
        order = self.config.order
        row = np.frombuffer(b"".join(piece for _, piece in pieces), np.uint8).astype(np.int32)
        lengths = np.array([len(piece) for _, piece in pieces])
        begins = np.cumsum(lengths) - lengths
        context = np.zeros(len(row), bool)
        for i in range(order):
            context[begins + i] = True
        texts = np.array([i for i, _ in pieces])
        for lang, (child, cost) in enumerate(self.tables):
            node = child.take(row[order - 1 : -1] + 256)
            deepest = np.maximum(node, 256)
            for i in range(2, order + 1):
                node = child.take(node + row[order - i : -i])
                np.maximum(deepest, node, out=deepest)
            spent = np.zeros(len(row), np.int64)
            spent[order:] = cost.take(deepest + row[order:])
            spent[context] = 0
            np.add.at(out[:, lang], texts, np.add.reduceat(spent, begins))

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language of the shortest code, ties to the smaller name, and its probability if all are as likely."""
        lengths = self.lengths(texts)
        best = lengths.argmin(1)
        more = (lengths - lengths.min(1, keepdims=True)) / UNITS
        return [self.languages[i] for i in best], 1 / np.exp2(-np.minimum(more, 1000)).sum(1)


def held_out(id_col: Column) -> Column:
    """The documents that nothing is learned from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train_languages(docs: DataFrame, config: LanguageConfig | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A tree for each language of the documents that aren't held out and have a text and a language.

    A language's tree is fitted in one task, on its bounded sample; a threshold on the hash lets few more rows than the
    sample be shuffled. Only trees reach the driver, of at most `contexts` nodes each."""
    config = config or LanguageConfig()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("text") != "") & ~held_out(F.col("id")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(config.languages).collect()
    # enough rows pass a threshold on the hash for a sample nearly always to be full; fewer do no harm
    share = [(r.lang, int(min(1.0, (2 * config.sample_documents + 100) / r["count"]) * (1 << 30))) for r in counts]
    picked = F.broadcast(rows.sparkSession.createDataFrame(share, "lang string, least long"))
    order = F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1 << 30))
    whole = F.col("text").cast("binary")
    begin = F.pmod(F.xxhash64("id", F.lit(13)), F.greatest(F.lit(1), F.octet_length("text") - config.sample_bytes + 1))
    sample = rows.join(picked, "lang").where(order < F.col("least")).select("lang", order.alias("order"), "id", F.substring(whole, (begin + 1).cast("int"), F.lit(config.sample_bytes)).alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "id", "text"))
    sample = sample.withColumn("place", place).where(F.col("place") <= config.sample_documents).select("lang", "place", "text")

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        tree = ContextTree.fit(group.column("text").to_pylist(), config)
        return pa.Table.from_arrays([group.column("lang").slice(0, 1), pa.array([tree.written()], pa.binary())], ["lang", "tree"])

    found = sample.groupBy("lang").applyInArrow(fit, "lang string, tree binary").collect()
    return LanguageModel({r.lang: bytes(r.tree) for r in found}, config)


def identify_languages(docs: DataFrame, model: LanguageModel, columns: list[str], text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The given columns, the language of each whole text and the probability of it, from 0 to 1.

    Null texts, and those without a letter, are UNDETERMINED, with a score of 0; so is every text if nothing was learned.
    Rows that repeat are predicted each by itself, a text of any length by all its bytes.
    """
    text = F.col(text_col).cast("string")
    source = docs.select(*columns, F.when(text.rlike(r"\p{L}"), text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(len(columns)).to_pylist()
                lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                told = [i for i, t in enumerate(texts) if t is not None and model.languages]
                if told:
                    found, sure = model.predict([texts[i] for i in told])
                    score[told] = sure
                    for i, name in zip(told, found, strict=True):
                        lang[i] = name
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(lang, pa.string()), pa.array(score)], [*columns, lang_out, score_out])

    return source.mapInArrow(run, docs.select(*columns).schema.add(lang_out, "string").add(score_out, "double"))
