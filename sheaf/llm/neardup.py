"""Near-duplicate documents: SetSketch registers, banding, likelihood estimates, then full sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored
from .graph import components


@dataclass(frozen=True)
class NearDupConfig:
    """words: of a shingle. percent: least 100 * intersection / union. A register is the level, in powers of base, of
    the smallest of a set's exponential values; band_size registers make a key, and documents that share one of the
    bands' keys are compared. At a similarity of 0.8 all keys differ with a probability below 1.3e-5, as (1 - 0.8**7)**48.
    Pairs are ruled out by an estimate more than `margin` standard deviations too low, about 3e-6 of those at 0.8. Buckets of over `together` classes are compared in
    blocks of about `block` classes."""

    words: int = 5
    percent: int = 80
    bands: int = 48
    band_size: int = 7
    base: float = 1.08
    margin: float = 4.5
    together: int = 32
    block: int = 1024
    seed: int = 7


LEVELS = 255
MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str, words: int, hashes: dict | None = None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word shingles. A-Z are lower-cased, words are what ASCII white space
    separates; with fewer words than asked, the whole sequence is one shingle; without any, none."""
    hashes = _WordHashes() if hashes is None else hashes
    parts = text.encode().lower().split()  # of bytes: these two know ASCII alone
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(31))) * MIX + h[i : len(h) - size + 1 + i]
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    return np.unique(out)


class SetSketch:
    """Registers of sets of hashes: register i of a set is 1 - log_base of its least value of exponential hash i, rounded
    down and held to 0..255. The register of a union is the greater one, so parts of a set can be sketched apart."""

    def __init__(self, config: NearDupConfig):
        rng = np.random.default_rng(config.seed)
        self.config, self.size = config, config.bands * config.band_size
        self.times = rng.integers(0, 2**31, self.size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 2**32, self.size, dtype=np.uint32)
        # level 0 stands for values above e^3; 255 levels of 1.08 then reach sets of about 10^7 elements
        self.log_base, self.shift = np.log(config.base), 3.0

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, registers) of non-empty sets, as bytes."""
        starts = np.cumsum([0, *map(len, sets[:-1])])
        every = np.concatenate(sets)
        x = (every >> np.uint64(32)).astype(np.uint32) ^ every.astype(np.uint32)
        least = np.empty((len(sets), self.size), np.uint32)
        buffer = np.empty_like(x)
        for i in range(self.size):
            np.multiply(x, self.times[i], out=buffer)
            buffer += self.plus[i]
            least[:, i] = np.minimum.reduceat(buffer, starts)
        uniform = (least.astype(float) + 0.5) / 2.0**32
        level = np.floor(1 - np.log(-np.log1p(-uniform)) / self.log_base + self.shift / self.log_base)
        return np.clip(level, 0, LEVELS).astype(np.uint8)

    def keys(self, registers: np.ndarray) -> np.ndarray:
        """(sets, bands): a 64-bit key of each band's registers."""
        key = np.arange(self.config.bands, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
        for i in range(self.config.band_size):
            key = (key ^ (key >> np.uint64(29))) * MIX + registers[:, i :: self.config.band_size]
        key ^= key >> np.uint64(32)
        key = key * np.uint64(0xFF51AFD7ED558CCD)
        return (key ^ (key >> np.uint64(29))).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float, steps: int = 101) -> np.ndarray:
    """The likeliest similarity of each pair of sets of known sizes, given how many registers of the first are greater,
    less and equal. With u and v the sizes' shares, the first is greater with probability p(u - v J), less with
    p(v - u J), where p(x) = -log_base(1 - x (base - 1) / base)."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = most * np.linspace(0, 1, steps)[None, :]
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (base - 1) / base) / np.log(base)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-300
    likelihood = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))
    return np.take_along_axis(j, likelihood.argmax(1)[:, None], 1)[:, 0]


def _sketched(docs: DataFrame, config: NearDupConfig) -> DataFrame:
    """(doc_id, text_hash, n, set_id, keys, registers) of each (doc_id, text, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, hashes = SetSketch(config), _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(x or "", config.words, hashes) for x in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, registers = [None] * len(sets), [None] * len(sets)
                if full:
                    got = sketch.registers([sets[i] for i in full])
                    for i, k, r in zip(full, sketch.keys(got), got, strict=True):
                        keys[i], registers[i] = k, r.tobytes()
                ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(registers, pa.binary())], ["doc_id", "text_hash", "n", "set_id", "keys", "registers"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, set_id binary, keys array<long>, registers binary")


def _sets(docs: DataFrame, nodes: DataFrame, config: NearDupConfig) -> DataFrame:
    """(node, s): the full shingle sets of the documents whose ids are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(x or "", config.words, hashes).view(np.int64) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    # the same plan at every size, so that what small tables need tells what large ones will
    wanted = nodes.select(F.col("node").alias("doc_id")).hint("merge")
    return docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "node long, s array<long>")


def _least_estimate(config: NearDupConfig) -> float:
    share = config.percent / 100
    return share - config.margin * float(np.sqrt(share * (1 - share) / (config.bands * config.band_size)))


def _likely(pairs: DataFrame, classes: DataFrame, config: NearDupConfig) -> DataFrame:
    """Of the pairs (a, b), those whose sketches don't rule out the asked similarity: sizes that fit, and an estimate
    not too far below it."""
    least = _least_estimate(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                if part.num_rows:
                    r_a, r_b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(part.num_rows, -1) for i in (2, 4))
                    n_a, n_b = (part.column(i).to_numpy().astype(float) for i in (3, 5))
                    keep = estimate(r_a, r_b, n_a, n_b, config.base) >= least
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in part.columns[:2]], ["a", "b"])

    one = classes.select(F.col("node").alias("a"), F.col("registers").alias("r_a"), F.col("n").alias("n_a")).hint("merge")
    two = classes.select(F.col("node").alias("b"), F.col("registers").alias("r_b"), F.col("n").alias("n_b")).hint("merge")
    joined = pairs.join(one, "a").join(two, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * config.percent)
    return joined.select("a", "b", "r_a", "n_a", "r_b", "n_b").mapInArrow(run, "a long, b long").distinct()


def _links_in_blocks(members: DataFrame, classes: DataFrame, sets: DataFrame, config: NearDupConfig) -> DataFrame:
    """Links (a, b) between the components of large buckets, from (key, node, c, size).

    A bucket is hashed into blocks, and each two of its blocks are a group of bounded size. There the registers are
    compared as arrays; pairs that they don't rule out are compared on their full sets, likeliest first, unless links
    of that group have joined their components already. So a group gives no more links than it has classes. A class is
    sent once for every block of its bucket.
    """
    least = _least_estimate(config)
    blocks = F.ceil(F.col("size") / config.block).cast("int")
    rows = members.join(classes.select("node", "registers", "n").hint("merge"), "node").join(sets.hint("merge"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(23)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "c", "n", "registers", "s")

    def run(table: pa.Table) -> pa.Table:
        own, i, j, node, c = (table.column(x).to_numpy() for x in ("own", "i", "j", "node", "c"))
        n = table.column("n").to_numpy().astype(float)
        registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(len(node), -1)
        held = table.column("s").combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        values, starts = held.values.to_numpy(), held.offsets.to_numpy()
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        left, right = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        share = config.percent / 100
        found: list[tuple[int, int]] = []
        for x in left:
            fits = (c[right] != c[x]) & (np.minimum(n[right], n[x]) >= share * np.maximum(n[right], n[x]))
            if i[0] == j[0]:
                fits &= node[right] > node[x]
            y = right[fits]
            # equal registers first: a pair that agrees in too few can't reach the estimate
            y = y[(registers[y] == registers[x]).sum(1, dtype=np.int16) >= (least - 0.05) * registers.shape[1]]
            if not len(y):
                continue
            likely = estimate(np.broadcast_to(registers[x], (len(y), registers.shape[1])), registers[y], np.full(len(y), n[x]), n[y], config.base)
            order = np.argsort(-likely)
            mine = values[starts[x] : starts[x + 1]]
            for at in order[: int((likely >= least).sum())]:
                other = int(y[at])
                here, there = find(int(c[x])), find(int(c[other]))
                if here != there:
                    both = len(np.intersect1d(mine, values[starts[other] : starts[other + 1]], assume_unique=True))
                    if 100 * both >= config.percent * (n[x] + n[other] - both):
                        root[max(here, there)] = min(here, there)
                        found.append((min(node[x], node[other]), max(node[x], node[other])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, config: NearDupConfig, label: str) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough, written to the shared folder."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")).hint("merge"), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("s").alias("s_b")).hint("merge"), "b")
    both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return stored(with_b.where(100 * both >= config.percent * (F.size("s_a") + F.size("s_b") - both)).select("a", "b").distinct(), f"{label}-links")


def near_duplicates(docs: DataFrame, config: NearDupConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of each row; text_hash is xxhash64 of its text.

    Rows whose sets are equal are one class from the start. Classes that share a band's key are candidates. In each
    bucket every class is first compared with one leader alone, of which a group has several, by eight orders; then components are made of the links, and only
    classes of one bucket that are still in different components are compared with each other. So a group of copies
    costs its size, not its square, and no pair of a bucket is left out that could join two components. Large buckets
    that are still mixed are compared block by block, on their registers and then on their sets. Every link is confirmed on full sets.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. Rows without an id
    are linked with nothing and have no component_id; they are kept. Rows that repeat an id with other texts
    go each by their own text's class, and classes with the same smallest id are one. Ties don't matter: component_id
    is the smallest doc_id reachable.
    """
    config = config or NearDupConfig()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(_sketched(docs.withColumn("text_hash", F.xxhash64("text")), config), "sketches")
    some = rows.where("n > 0 and doc_id is not null")
    firsts = some.groupBy("set_id").agg(F.min("doc_id").alias("node"))
    # the sketch of a class comes from its smallest document alone
    classes = stored(some.join(firsts.hint("merge"), "set_id").where("doc_id = node").dropDuplicates(["set_id"]).select("set_id", "node", "n", "keys", "registers"), "classes")
    bucket = Window.partitionBy("key")
    shared = classes.select("node", F.explode("keys").alias("key")).withColumns({"low": F.min("node").over(bucket), "high": F.max("node").over(bucket), "first": F.min(F.struct(F.xxhash64("node", F.col("key") % 8), "node")).over(bucket)})
    members = stored(shared.where("low < high").select("key", "node", F.col("first.node").alias("first")), "members")

    sets = stored(_sets(docs, members.select("node").distinct(), config), "sets")
    release(docs.sparkSession)

    stars = members.where("node <> first").select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")).distinct()
    links = _confirmed(_likely(stars, classes, config), sets, config, "stars")
    parts = components(links, "stars-components")
    placed = members.select("key", "node").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    mixed = placed.withColumns({"low": F.min("c").over(bucket), "high": F.max("c").over(bucket), "size": F.count("*").over(bucket)})
    open_ = stored(mixed.where("low < high").select("key", "node", "c", "size"), "open")
    few = open_.where(F.col("size") <= config.together)
    left, right = few.select("key", F.col("node").alias("a"), F.col("c").alias("c_a")), few.select("key", F.col("node").alias("b"), F.col("c").alias("c_b"))
    across = left.join(right.hint("merge"), "key").where("c_a <> c_b and a < b").select("a", "b").distinct()
    more = _confirmed(_likely(across, classes, config), sets, config, "across")
    rest = stored(_links_in_blocks(open_.where(F.col("size") > config.together), classes, sets, config).distinct(), "blocks")
    release(docs.sparkSession)
    whole = components(links.unionByName(more).unionByName(rest), "components")

    named = firsts.join(whole.hint("merge"), "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "text_hash", "n", "set_id").join(named.hint("merge"), "set_id", "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")
