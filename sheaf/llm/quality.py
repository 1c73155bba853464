"""A byte-level convolutional quality classifier in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nets import Adam, calibrate, sigmoid

#: The byte after a text's end.
PAD = 256


@dataclass(frozen=True)
class QualityConfig:
    """A filter sees `width` bytes and is applied at every `stride`-th byte. Its outputs are max-pooled in chunks of
    two blocks of `block` bytes, each overlapping the next by one block.

    A small sample is gone through more often, for least_steps steps. Training takes at most sample_per_class labelled documents of each class, chosen by a hash of their ids, of up to
    sample_bytes bytes each. Scoring has no limit of any kind.
    """

    width: int = 8
    stride: int = 2
    block: int = 128
    embedding: int = 4
    filters: int = 24
    hidden: int = 12
    sample_per_class: int = 2500
    sample_bytes: int = 1 << 13
    epochs: int = 8
    least_steps: int = 400
    batch: int = 48
    rate: float = 0.01
    seed: int = 1


class ByteConvolution:
    """embedding -> convolution -> ReLU -> max in each chunk -> hidden units of each chunk -> mean and max over all
    chunks of the document -> one logit -> calibrated probability."""

    def __init__(self, config: QualityConfig):
        c, rng = config, np.random.default_rng(config.seed)
        self.config = c
        draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        self.weights = {
            "E": draw(257, c.embedding, scale=0.5),
            "W": draw(c.width * c.embedding, c.filters, scale=1 / np.sqrt(c.width)),
            "c": np.zeros(c.filters, np.float32),
            "H": draw(c.filters, c.hidden, scale=1 / np.sqrt(c.filters)),
            "h": np.zeros(c.hidden, np.float32),
            "u": draw(2 * c.hidden, scale=0.3),
            "b": np.zeros(1, np.float32),
        }
        self.weights["E"][PAD] = 0
        self.slope, self.offset = 1.0, 0.0

    # -- layout

    def laid_out(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All bytes in one row, each text padded to whole blocks with a filter's width of padding at least; and the
        number of blocks of each."""
        c = self.config
        blocks = np.array([-(-(len(t) + c.width) // c.block) for t in texts], np.int64)
        row = np.full(int(blocks.sum()) * c.block + c.width, PAD, np.int16)
        at = 0
        for text, n in zip(texts, blocks.tolist(), strict=True):
            row[at : at + len(text)] = np.frombuffer(text, np.uint8)
            at += n * c.block
        return row, blocks

    def windows(self, row: np.ndarray) -> np.ndarray:
        c = self.config
        embedded = self.weights["E"][row]
        seen = np.lib.stride_tricks.sliding_window_view(embedded, c.width, axis=0)[: len(row) - c.width : c.stride]
        return np.ascontiguousarray(seen.transpose(0, 2, 1)).reshape(len(seen), -1)

    def block_maxima(self, row: np.ndarray) -> np.ndarray:
        """The pooled filters of each block, a bounded stretch of the row at a time."""
        c, out = self.config, []
        step = 512 * c.block
        for at in range(0, len(row) - c.width, step):
            part = row[at : at + step + c.width]
            z = self.windows(part) @ self.weights["W"]
            out.append(z.reshape(-1, c.block // c.stride, c.filters).max(1))
        return np.maximum(np.concatenate(out) + self.weights["c"], 0)

    @staticmethod
    def chunk_pairs(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second block of each chunk and the document it belongs to; a text of one block is one chunk."""
        chunks = np.maximum(blocks - 1, 1)
        doc = np.repeat(np.arange(len(blocks)), chunks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        first = np.repeat(np.cumsum(blocks) - blocks, chunks) + nth
        return first, first + (np.repeat(blocks, chunks) > 1), doc

    def head(self, pooled: np.ndarray, doc: np.ndarray, n: int):
        w = self.weights
        hidden = np.tanh(pooled @ w["H"] + w["h"])
        starts = np.searchsorted(doc, np.arange(n))
        count = np.diff(np.r_[starts, len(doc)])[:, None]
        mean = np.add.reduceat(hidden, starts, axis=0) / count
        most = np.maximum.reduceat(hidden, starts, axis=0)
        return hidden, count, mean, most, np.concatenate([mean, most], 1) @ w["u"] + w["b"][0]

    def logits(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        row, blocks = self.laid_out(texts)
        maxima = self.block_maxima(row)
        first, second, doc = self.chunk_pairs(blocks)
        return self.head(np.maximum(maxima[first], maxima[second]), doc, len(texts))[-1].astype(float)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.slope * self.logits(texts) + self.offset)

    # -- training

    def slopes(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        c, w = self.config, self.weights
        row, blocks = self.laid_out(texts)
        seen = self.windows(row)
        z = (seen @ w["W"]).reshape(-1, c.block // c.stride, c.filters)
        at = z.argmax(1)
        maxima = np.take_along_axis(z, at[:, None], 1)[:, 0] + w["c"]
        first, second, doc = self.chunk_pairs(blocks)
        use_second = maxima[second] > maxima[first]
        raw = np.where(use_second, maxima[second], maxima[first])
        pooled = np.maximum(raw, 0)
        hidden, count, mean, most, logit = self.head(pooled, doc, len(texts))
        error = ((sigmoid(logit) - labels) / len(labels)).astype(np.float32)
        g = {"b": error.sum(keepdims=True), "u": np.concatenate([mean, most], 1).T @ error}
        up = error[:, None] * w["u"][None, :]
        is_most = hidden == most[doc]
        d_hidden = up[doc, : c.hidden] / count[doc] + up[doc, c.hidden :] * is_most
        d_hidden *= 1 - hidden * hidden
        g["H"], g["h"] = pooled.T @ d_hidden, d_hidden.sum(0)
        d_pool = (d_hidden @ w["H"].T) * (raw > 0)
        g["c"] = d_pool.sum(0)
        block = np.where(use_second, second[:, None], first[:, None])
        place = block * (c.block // c.stride) + at[block, np.arange(c.filters)]
        picked = seen[place]  # chunk, filter, window
        g["W"] = np.einsum("kf,kfw->wf", d_pool, picked)
        d_seen = (d_pool[:, :, None] * w["W"].T[None]).reshape(-1, c.width, c.embedding)
        symbols = row[(place.ravel() * c.stride)[:, None] + np.arange(c.width)]
        g["E"] = np.stack([np.bincount(symbols.ravel(), d_seen[:, :, e].ravel(), 257) for e in range(c.embedding)], 1)
        g["E"][PAD] = 0
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, prior: float) -> ByteConvolution:
        c, rng = self.config, np.random.default_rng(self.config.seed)
        held = np.arange(len(texts)) % 6 == 5
        train, check = np.flatnonzero(~held), np.flatnonzero(held)
        steps = Adam(self.weights, c.rate)
        epochs = max(c.epochs, -(-c.least_steps * c.batch // max(1, len(train))))
        for epoch in range(epochs):
            steps.rate = c.rate * (1 - epoch / epochs)
            order = rng.permutation(train)
            for at in range(0, len(order), c.batch):
                pick = order[at : at + c.batch]
                steps.update(self.slopes([texts[i] for i in pick], labels[pick]))
        if len(check):
            self.slope, self.offset = calibrate(self.logits([texts[i] for i in check]), labels[check], prior)
        return self


def held_out(id_col: Column) -> Column:
    """The documents whose labels nothing is learned from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteConvolution | None:
    """The classifier, fitted on a bounded sample of the labelled documents that aren't held out; None without both
    classes. Only the sample's ids, at most twice sample_per_class of them, are broadcast."""
    config = config or QualityConfig()
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).head()[0]
    if share in (None, 0.0, 1.0):
        return None
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(config.sample_per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= config.sample_bytes)
    rows = sorted(texts.join(F.broadcast(picked), "id").select("id", "text", "y").dropDuplicates(["id"]).collect(), key=lambda r: r.id)
    y = np.array([r.y for r in rows], float)
    if len(rows) < 2 or len(set(y.tolist())) < 2:
        return None
    order = np.random.default_rng(config.seed).permutation(len(rows))
    return ByteConvolution(config).fit([rows[i].text.encode() for i in order], y[order], float(share))


def score_quality(docs: DataFrame, model: ByteConvolution | None, columns: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The given columns and a score from 0 to 1 for each row's whole text. A null text counts as empty; an empty text
    has the score of padding alone. Without a model every score is 0.5."""

    n, at_text = len(columns), columns.index(text_col) if text_col in columns else len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(x or "").encode() for x in part.column(at_text).to_pylist()]
                scores = model.scores(texts) if model else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(scores, pa.float64())], [*columns, score_col])

    source = docs.select(*columns, *[text_col] * (at_text == n))
    return source.mapInArrow(run, docs.select(*columns).schema.add(score_col, "double"))
