"""Removal of substrings that repeat across documents, to the byte.

Every string of `least` bytes holds an anchor: the k-gram with the smallest hash in it. All k-grams that are smallest
in some such string are found where a document is read, and only their hashes, the hashes of their contexts and their
places are shuffled. The context of an anchor is all bytes of the strings that hold it. Of equal contexts, those in
larger documents are repeats as a whole; contexts count as equal if the anchors' hashes and the contexts' own are, of 64
bits each, which of n contexts of one anchor takes about n * n / 2**65 pairs for equal that aren't. Different contexts
around equal anchors are fetched and go to one task, which sorts their suffixes, forms the Burrows-Wheeler transform and
extends its intervals backwards, breadth first, up to `least` bytes: intervals that are left hold the strings that
contexts share. An anchor with very many contexts is split by the bytes on either side of it, so that its contexts are
spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, plan_bytes, release, stored

#: What stands between documents, and the id that rows without one are ordered by.
PAD = 256
LAST = 2**63 - 1

MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SuffixConfig:
    """least: bytes of a repeated string. anchor: bytes of an anchor, at most `least`. partition_bytes: input that one
    partition of the shuffles stands for. bwt_bytes: contexts of different anchors are sorted together up to so many.
    split: an anchor with more contexts than this is split by what stands around it."""

    least: int = 50
    anchor: int = 16
    partition_bytes: int = 4 << 20
    bwt_bytes: int = 1 << 20
    split: int = 512

    @property
    def reach(self) -> int:
        return self.least - self.anchor

    @property
    def context(self) -> int:
        return self.least + self.reach

    @property
    def sides(self) -> tuple[tuple[int, int], tuple[int, int]]:
        """Two stretches of a context: any string of `least` bytes around the anchor reaches half way to its left, or as
        far to its right as makes up for it, and so holds one of them."""
        half = self.reach // 2
        return (self.reach - half, self.reach + self.anchor), (self.reach, self.least + self.reach - half)


class Blocks:
    """Hashes of all stretches of 1, 2, 4, ... symbols of a row, and of any length at given places."""

    def __init__(self, row: np.ndarray, longest: int):
        table = np.random.default_rng(11).integers(0, 2**63, PAD + 1, dtype=np.uint64)
        self.levels = [table[row]]
        n = 1
        while 2 * n <= longest:
            h = self.levels[-1]
            h = (h[:-n] * MIX) + h[n:]
            h ^= h >> np.uint64(29)
            self.levels.append(h)
            n *= 2

    def at(self, places: np.ndarray, length: int, seed: int) -> np.ndarray:
        out = np.full(len(places), seed, np.uint64)
        for level in range(len(self.levels) - 1, -1, -1):
            while length >= 1 << level:
                out = (out ^ (out >> np.uint64(31))) * MIX + self.levels[level][places]
                places, length = places + (1 << level), length - (1 << level)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        return out ^ (out >> np.uint64(32))


def sliding(values: np.ndarray, width: int, function) -> np.ndarray:
    """function (minimum or maximum) over each stretch of `width` values."""
    n = 1
    while 2 * n <= width:
        values = function(values[:-n], values[n:])
        n *= 2
    return function(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


def laid_out(texts: list[bytes], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row with `gap` pads before, between and after; and where each starts."""
    starts = gap + np.cumsum([0, *(len(t) + gap for t in texts[:-1])])
    row = np.full(int(starts[-1]) + len(texts[-1]) + gap, PAD, np.int16)
    for start, text in zip(starts.tolist(), texts, strict=True):
        row[start : start + len(text)] = np.frombuffer(text, np.uint8)
    return row, starts


def anchors(texts: list[bytes], config: SuffixConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash, hash of the context) of each anchor, in order. Among equal smallest k-grams all are anchors."""
    least, k, reach = config.least, config.anchor, config.reach
    row, starts = laid_out(texts, least)
    blocks = Blocks(row, config.context)
    windows = reach + 1
    every = blocks.at(np.arange(len(row) - k + 1), k, 1)
    order = np.maximum((every >> np.uint64(32)).astype(np.uint32), 1)
    lowest = sliding(order, windows, np.minimum)  # of the string at each place
    whole = np.zeros(len(lowest), bool)
    for start, text in zip(starts.tolist(), texts, strict=True):
        whole[start : start + max(0, len(text) - least + 1)] = True
    lowest[~whole] = 0
    lowest = np.concatenate([np.zeros(reach, np.uint32), lowest, np.zeros(reach, np.uint32)])
    place = np.flatnonzero(sliding(lowest, windows, np.maximum)[: len(order)] == order)
    text = np.searchsorted(starts, place, "right") - 1
    return text, place - starts[text], every[place], blocks.at(place - reach, config.context, 2)


#: An anchor on its way: its hash, its context's, the number of its document in the table before it, and its place. Equal
#: anchors share a, so all 64 bits of c are needed to tell their contexts apart.
ANCHOR = np.dtype([("a", "<u8"), ("c", "<u8"), ("doc", "<u2"), ("place", "<u4")])


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def settle(a: np.ndarray, c: np.ndarray, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of anchors with equal contexts, those in larger documents than the smallest are repeats. Returns the order by
    (a, c, doc, key), and which of them in that order are repeats."""
    order = np.lexsort((key, doc, c, a))
    first = runs(a[order], c[order])
    return order, doc[order] > np.repeat(doc[order][first], np.diff(np.r_[first, len(order)]))


def document_runs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by document, and the edges of each one's run in it."""
    order = np.lexsort((key, doc))
    return order, np.r_[runs(doc[order], key[order]), len(order)]


def binaries(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of data[edges[i]:edges[i + 1]] for each i, without a loop."""
    offsets = (edges * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


MESSAGES = "part int, k long, h long, payload binary"


def _find_anchors(config: SuffixConfig, parts: int):
    """Reads (k, h, text); sends anchors to the part of their hash. Of contexts that a task sees several times only
    those of the smallest document go on; the places of the others are sent as found (with k and h)."""
    shift = np.uint64(64 - (parts - 1).bit_length()) if parts > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "k", "h", "payload"]
        held: list[tuple] = []
        docs: list[tuple[int, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            table = np.array(docs, np.int64).reshape(-1, 2)
            number, place, a, c = (np.concatenate([h[i] for h in held]) for i in range(4))
            order = np.argsort(a)
            number, place, a, c = number[order], place[order], a[order], c[order]
            first = runs(a)
            count = np.diff(np.r_[first, len(a)])
            many = np.flatnonzero(np.repeat(count > 1, count))
            keep = np.ones(len(a), bool)
            rows: list[tuple] = []
            early = None
            if len(many):
                docs_of, keys_of = table[number[many], 0], table[number[many], 1]
                inner, repeats = settle(a[many], c[many], docs_of, keys_of)
                found = many[inner[repeats]]
                keep[found] = False
                inner, edges = document_runs(table[number[found], 0], table[number[found], 1])
                found = found[inner]
                heads = table[number[found[edges[:-1]]]]
                early = pa.RecordBatch.from_arrays([pa.array((-1 - (heads[:, 1] & 0xFFFF)).astype(np.int32)), pa.array(heads[:, 0]), pa.array(heads[:, 1]), binaries(place[found].astype("<u4"), edges)], names)
            number, place, a, c = number[keep], place[keep], a[keep], c[keep]
            part = (a >> shift).astype(np.int64) if shift is not None else np.zeros(len(a), np.int64)
            first = runs(part)
            for start, end in zip(first.tolist(), [*first[1:].tolist(), len(a)], strict=True):
                used, local = np.unique(number[start:end], return_inverse=True)
                made = np.empty(end - start, ANCHOR)
                made["a"], made["c"], made["doc"], made["place"] = a[start:end], c[start:end], local, place[start:end]
                rows.append((int(part[start]), len(used), 0, table[used].tobytes() + made.tobytes()))
            held.clear(), docs.clear()
            size = 0
            if early:
                yield early
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

        for batch in batches:
            ks, hs, texts = (batch.column(i) for i in range(3))
            at = 0
            while at < batch.num_rows:
                group, own, total = [], [], 0
                while at < batch.num_rows and total < 1 << 20 and len(docs) + len(group) < 60_000:
                    text = (texts[at].as_py() or "").encode()
                    if len(text) >= config.least:
                        group.append(text)
                        own.append((ks[at].as_py(), hs[at].as_py()))
                        total += len(text)
                    at += 1
                if group:
                    number, place, a, c = anchors(group, config)
                    held.append(((number + len(docs)).astype(np.uint16), place.astype(np.uint32), a, c))
                    docs += own
                    size += len(a)
                if docs and (size > 1_500_000 or len(docs) >= 60_000):
                    yield from flush()
        if docs and size:
            yield from flush()

    return run


#: A finding on its way to its document: a place of a repeat (a is 0 and n is 0), or a context that is asked for, with
#: the hash of its anchor and, at its first place, the number of its places, which follow one another.
FINDING = np.dtype([("k", "<i8"), ("h", "<i8"), ("a", "<u8"), ("n", "<u4"), ("place", "<u4")])


#: Findings or ranges that are held before they are sent on.
SENT = 1 << 20

#: Set in n: the anchor's contexts are so many that they are split.
SPLIT = np.uint32(1 << 31)


def in_buckets(rows: np.ndarray, buckets: int, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """(bucket, payload): rows with fields k and h, dealt by their document, in order otherwise; in batches of about
    `most` rows, which are cut where no context's places are under way."""
    whole = np.arange(len(rows)) if "a" not in rows.dtype.names else np.flatnonzero((rows["a"] == 0) | (rows["n"] > 0))
    edges = np.unique(np.r_[np.r_[whole, len(rows)][np.searchsorted(whole, np.arange(0, len(rows), most))], len(rows)])
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        some = rows[low:high]
        bucket = ((some["k"] ^ (some["h"] >> 33)) % buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        first = runs(bucket[order])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order[first]]), binaries(some[order], np.r_[first, len(order)])], ["bucket", "payload"])


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The (part, n, h, payload) of one part after the other, from rows that are sorted by part."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _match_anchors(buckets: int, split: int):
    """A partition's anchors, one part after the other: findings in the buckets of their documents. A context is asked for once, with all its
    places in its smallest document, and told whether its anchor is to be split."""

    def findings(rows: list[tuple]) -> list[np.ndarray]:
        tables, pieces, out, base = [], [], [], 0
        for part, n, h, payload in rows:
            if part < 0:
                places = np.frombuffer(payload, "<u4")
                early = np.zeros(len(places), FINDING)
                early["k"], early["h"], early["place"] = n, h, places
                out.append(early)
                continue
            tables.append(np.frombuffer(payload, "<i8", 2 * n).reshape(n, 2))
            made = np.frombuffer(payload, ANCHOR, offset=16 * n)
            pieces.append((made["a"], made["c"], made["doc"].astype(np.int64) + base, made["place"]))
            base += n
        if pieces:
            table = np.concatenate(tables)
            a, c, number, place = (np.concatenate(x) for x in zip(*pieces, strict=True))
            pieces.clear()
            order = np.argsort(a)
            count = np.diff(np.r_[runs(a[order]), len(a)])
            many = order[np.repeat(count > 1, count)]
            a, c, number, place = a[many], c[many], number[many], place[many]
            doc, key = table[number, 0], table[number, 1]
            order, repeats = settle(a, c, doc, key)
            a, c, doc, key, place = a[order], c[order], doc[order], key[order], place[order]
            found = np.zeros(int(repeats.sum()), FINDING)
            found["k"], found["h"], found["place"] = doc[repeats], key[repeats], place[repeats]
            out.append(found)
            keep = ~repeats
            a, c, doc, key, place = a[keep], c[keep], doc[keep], key[keep], place[keep]
            if len(a):
                first = runs(a)
                # a context needs looking at if its anchor has another one, and one of another document
                kinds = (np.maximum.reduceat(c, first) != np.minimum.reduceat(c, first)) & (np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first))
                some = np.repeat(kinds, np.diff(np.r_[first, len(a)]))
                a, c, doc, key, place = a[some], c[some], doc[some], key[some], place[some]
                asked = np.zeros(len(a), FINDING)
                asked["k"], asked["h"], asked["a"], asked["place"] = doc, key, np.maximum(a, 1), place
                if len(a):
                    first = runs(a, c, doc, key)
                    asked["n"][first] = np.diff(np.r_[first, len(a)])
                    of = runs(a)
                    contexts = np.add.reduceat((asked["n"] > 0).astype(np.int64), of)
                    asked["n"][first[np.repeat(contexts > split, contexts)]] |= SPLIT
                out.append(asked)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        size = 0
        for rows in by_part(batches):
            found = findings(rows)
            out += found
            size += sum(map(len, found))
            if size > SENT:
                yield from in_buckets(np.concatenate(out), buckets)
                out, size = [], 0
        if size:
            yield from in_buckets(np.concatenate(out), buckets)

    return run


def _beside(documents: DataFrame, sent: list[DataFrame], buckets: int, partitions: int) -> DataFrame:
    """(bucket, kind, payload, *documents' columns): each bucket's payloads, kind 0 for those of the first frame and so
    on, and behind them its documents, one bucket after the other."""
    number = F.pmod(F.col("k").bitwiseXOR(F.shiftright("h", 33)), F.lit(buckets)).cast("int")
    rows = documents.select(number.alias("bucket"), F.lit(len(sent)).alias("kind"), F.lit(None).cast("binary").alias("payload"), *documents.columns)
    for kind, frame in enumerate(sent):
        rows = rows.unionByName(frame.select("bucket", F.lit(kind).alias("kind"), "payload"), allowMissingColumns=True)
    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind")


class Held:
    """The payloads of the bucket that is being read, by document."""

    def __init__(self, kind: np.dtype, use=None):
        self.kind, self.use, self.bucket = kind, use, None
        self.clear()

    def clear(self) -> None:
        self.parts, self.rows, self.at = [], None, {}

    def enter(self, bucket: int) -> None:
        if bucket != self.bucket:
            self.bucket = bucket
            self.clear()

    def add(self, payload: bytes) -> None:
        part = np.frombuffer(payload, self.kind)
        self.parts.append(part if self.use is None else part[self.use(part)])

    def of(self, k: int, h: int) -> np.ndarray:
        if self.rows is None:
            rows = np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
            self.rows = rows[np.lexsort((rows["h"], rows["k"]))]
            edges = [*runs(self.rows["k"], self.rows["h"]).tolist(), len(rows)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                self.at[int(self.rows["k"][low]), int(self.rows["h"][low])] = low, high
        low, high = self.at.get((k, h), (0, 0))
        return self.rows[low:high]


#: A repeated stretch of a document's bytes.
RANGE = np.dtype([("k", "<i8"), ("h", "<i8"), ("low", "<u4"), ("high", "<u4")])


def _context_type(config: SuffixConfig) -> np.dtype:
    return np.dtype([("a", "<u8"), ("k", "<i8"), ("h", "<i8"), ("n", "<u4"), ("left", "<u2"), ("right", "<u2"), ("row", "u1", (config.context,))])


def _padded(made: np.ndarray) -> np.ndarray:
    """The contexts' symbols, their pads restored."""
    rows = made["row"].astype(np.int16)
    column = np.arange(rows.shape[1])
    rows[column < made["left"][:, None]] = PAD
    rows[column >= rows.shape[1] - made["right"][:, None].astype(int)] = PAD
    return rows


def _split(made: np.ndarray, places: np.ndarray, hot: np.ndarray, config: SuffixConfig) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of hot anchors twice, once under each of their sides, in place of once under their anchor. Contexts that
    share a string share one of the sides; a side that a document's end cuts holds no such string."""
    n = made["n"].astype(np.int64)
    first = np.cumsum(n) - n
    rows = _padded(made[hot])
    keys, line = Blocks(rows.ravel(), config.context), np.arange(len(rows)) * config.context
    parts, picks = [made[~hot]], [np.flatnonzero(~hot)]
    for seed, (start, end) in enumerate(config.sides, 5):
        have = (rows[:, start] != PAD) & (rows[:, end - 1] != PAD)
        under = made[hot][have]
        under["a"] = np.maximum((under["a"] ^ keys.at(line + start, end - start, seed)[have]) * MIX, 1)
        parts.append(under)
        picks.append(np.flatnonzero(hot)[have])
    pick = np.concatenate(picks)
    spread = np.repeat(first[pick] - (np.cumsum(n[pick]) - n[pick]), n[pick]) + np.arange(int(n[pick].sum()))
    return np.concatenate(parts), places[spread]


def _fetch_contexts(config: SuffixConfig, parts: int):
    """Reads what _beside makes of findings and (k, h, text); sends each context, padded at a document's ends, to its anchor's part."""
    kind = _context_type(config)
    shift = np.uint64(64 - (parts - 1).bit_length()) if parts > 1 else None
    names = ["part", "k", "h", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            made, places = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            size = 0
            part = (made["a"] >> shift).astype(np.int64) if shift is not None else np.zeros(len(made), np.int64)
            order = np.argsort(part, kind="stable")
            n = made["n"].astype(np.int64)
            start = (np.cumsum(n) - n)[order]
            n = n[order]
            total = np.r_[0, np.cumsum(n)]
            spread = np.repeat(start - total[:-1], n) + np.arange(total[-1])
            made, places = made[order], places[spread]
            edges = [*runs(part[order]).tolist(), len(order)]
            rows = [(int(part[order[low]]), high - low, 0, made[low:high].tobytes() + places[total[low] : total[high]].tobytes()) for low, high in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

        held = Held(FINDING, lambda rows: rows["a"] > 0)
        for batch in batches:
            bucket, kind_of, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i in range(batch.num_rows):
                held.enter(bucket[i])
                if kind_of[i] == 0:
                    held.add(payloads[i].as_py())
                    continue
                k, h = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                asked = held.of(k, h)
                if not len(asked):
                    continue
                data = batch.column(5)[i].as_py().encode()
                row = np.zeros(len(data) + 2 * config.least, np.uint8)
                row[config.least : config.least + len(data)] = np.frombuffer(data, np.uint8)
                heads, places = asked[asked["n"] > 0], asked["place"]
                hot, n = (heads["n"] & SPLIT) > 0, heads["n"] & ~SPLIT
                at = heads["place"].astype(np.int64) + config.least - config.reach
                made = np.empty(len(heads), kind)
                made["a"], made["n"], made["k"], made["h"] = heads["a"], n, k, h
                made["row"] = row[at[:, None] + np.arange(config.context)]
                made["left"] = np.maximum(config.least - at, 0)
                made["right"] = np.maximum(at + config.context - config.least - len(data), 0)
                if hot.any():
                    made, places = _split(made, places, hot, config)
                waiting.append((made, places))
                size += made.nbytes + places.nbytes
                if size > 24 << 20:
                    yield flush()
        if waiting:
            yield flush()

    return run


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes of a row that ends with a symbol found nowhere else, and each suffix's rank: known to
    three symbols first, then by doubling what is known."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    known, base = 1, int(rank.max()) + 2
    if base < 2**21:
        padded = np.concatenate([rank + 1, np.zeros(2, np.int64)])
        key, known = (padded[:n] * base + padded[1 : n + 1]) * base + padded[2 : n + 2], 3
    else:
        key = rank
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        if rank[order[-1]] == n - 1:
            return order, rank
        ahead = np.zeros(n, np.int64)
        ahead[: n - known] = rank[known:] + 1
        key, known = rank * (n + 1) + ahead, 2 * known


def shared_strings(contexts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, context, start) of all strings of `least` symbols that occur more than once in the rows of contexts.

    The rows are joined, each with an end of its own. Intervals of the suffix order whose strings have d symbols become
    those of d + 1 by one step backwards in the Burrows-Wheeler transform: two neighbours share d + 1 symbols if their
    first ones are equal and what follows lies in one interval of d. The borders first seen in step d are the common
    prefixes of d symbols, and the steps stop at `least`.
    """
    n_rows, width = contexts.shape
    real = contexts != PAD
    # rows become text with pads taken out; an end symbol of its own stands behind each row
    ends = np.arange(n_rows)[:, None]
    joined = np.concatenate([contexts.astype(np.int64) + n_rows, np.broadcast_to(ends, (n_rows, 1))], 1)
    use = np.concatenate([real, np.ones((n_rows, 1), bool)], 1).ravel()
    text = joined.ravel()[use]
    where = np.flatnonzero(use)
    order, rank = suffix_array(text)
    n = len(text)
    first = text[order]
    follows = rank[np.minimum(order + 1, n - 1)]  # the interval step: where the suffix without its first symbol stands
    border = np.ones(n, bool)
    border[1:] = first[1:] != first[:-1]  # common prefixes of nothing
    active = np.flatnonzero(~border)
    for _ in range(1, least):
        interval = np.cumsum(border, dtype=np.int32)
        new = interval[follows[active]] != interval[follows[active - 1]]
        border[active[new]] = True
        active = active[~new]
        if not len(active):
            break
    start = np.flatnonzero(border)
    length = np.diff(np.r_[start, n])
    inside = np.repeat(length > 1, length)
    group = np.repeat(np.arange(len(start)), length)[inside]
    place = where[order[inside]]
    return group, place // (width + 1), place % (width + 1)


def _compare_contexts(config: SuffixConfig, buckets: int):
    """A partition's contexts, one part after the other: what is repeated, as ranges in the buckets of their documents."""
    kind = _context_type(config)
    reach, least = config.reach, config.least

    def marked(a: np.ndarray, doc: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, start) of the strings of `least` bytes that smaller documents have."""
        keys = Blocks(rows.ravel(), config.context)
        line = np.arange(len(rows)) * config.context
        some = np.zeros(len(rows), bool)
        for start, end in config.sides:
            have = (rows[:, start] != PAD) & (rows[:, end - 1] != PAD)
            key = keys.at(line + start, end - start, 3)
            order = np.lexsort((key, a))
            begin = runs(a[order], key[order])
            count = np.diff(np.r_[begin, len(order)])
            some[order] |= np.repeat(count > 1, count) & have[order]
        some = np.flatnonzero(some)
        if not len(some):
            return some, some
        group, context, start = shared_strings(rows[some], least)
        if not len(group):
            return group, group
        context = some[context]
        begin = runs(group)
        least_doc = np.repeat(np.minimum.reduceat(doc[context], begin), np.diff(np.r_[begin, len(group)]))
        larger = doc[context] > least_doc
        return context[larger], start[larger]

    def repeated(rows: list[tuple]) -> np.ndarray:
        made = [np.frombuffer(payload, kind, n) for _, n, _, payload in rows]
        places = [np.frombuffer(payload, "<u4", offset=n * kind.itemsize) for _, n, _, payload in rows]
        every, place = np.concatenate(made), np.concatenate(places)
        first_place = np.cumsum(every["n"], dtype=np.int64) - every["n"]
        order = np.argsort(every["a"], kind="stable")
        begin = runs(every["a"][order])
        limit = max(1, config.bwt_bytes // config.context)
        out: list[tuple[np.ndarray, ...]] = []
        at = 0
        while at < len(begin):  # whole groups, up to the limit, or one group
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + limit)) - (0 if begin[-1] < begin[at] + limit else 1))
            to = min(to, len(begin))
            pick = order[begin[at] : begin[to] if to < len(begin) else len(order)]
            at = to
            part = every[pick]
            context, start = marked(part["a"], part["k"], _padded(part))
            if len(context):
                inner = np.lexsort((start, context))
                context, start = context[inner], start[inner]
                new = np.r_[True, (context[1:] != context[:-1]) | (start[1:] > start[:-1] + least)]
                begins = np.flatnonzero(new)
                lasts = np.r_[begins[1:], len(start)] - 1
                context, low, high = pick[context[begins]], start[begins] - reach, start[lasts] + least - reach
                times = every["n"][context].astype(np.int64)
                where = np.repeat(first_place[context], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                anchor = place[where].astype(np.int64)
                out.append((np.repeat(every["k"][context], times), np.repeat(every["h"][context], times), anchor + np.repeat(low, times), anchor + np.repeat(high, times)))
        ranges = np.zeros(sum(len(x[0]) for x in out), RANGE)
        for i, name in enumerate(("k", "h", "low", "high")):
            if out:
                ranges[name] = np.concatenate([x[i] for x in out])
        return ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        size = 0
        for rows in by_part(batches):
            out.append(repeated(rows))
            size += len(out[-1])
            if size > SENT:
                yield from in_buckets(np.concatenate(out), buckets)
                out, size = [], 0
        if size:
            yield from in_buckets(np.concatenate(out), buckets)

    return run


def removed_spans(length: int, places: np.ndarray, ranges: np.ndarray, config: SuffixConfig) -> np.ndarray:
    """(start, end) of the maximal stretches that are covered."""
    at = places.astype(np.int64)
    low = np.concatenate([np.maximum(at - config.reach, 0), ranges["low"].astype(np.int64)])
    high = np.concatenate([np.minimum(at + config.least, length), ranges["high"].astype(np.int64)])
    if not len(low):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    return np.stack([low[new], high[np.r_[new[1:], len(high)] - 1]], 1)


def _spans_beside(batches: Iterator[pa.RecordBatch], config: SuffixConfig) -> Iterator[tuple[pa.RecordBatch, list[int], list]]:
    """(batch, numbers of its document rows, their spans) of what _beside makes of findings, ranges and documents."""
    places, ranges = Held(FINDING, lambda rows: rows["a"] == 0), Held(RANGE)
    for batch in batches:
        bucket, kind, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        rows, spans = [], []
        for i in range(batch.num_rows):
            for held in (places, ranges):
                held.enter(bucket[i])
            if kind[i] < 2:
                (places, ranges)[kind[i]].add(payloads[i].as_py())
                continue
            k, h = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
            found, more = places.of(k, h)["place"], ranges.of(k, h)
            text = batch.column(5)[i]
            spans.append(removed_spans(len((text.as_py() or "").encode()), found, more, config).tolist() if len(found) or len(more) else [])
            rows.append(i)
        if rows:
            yield batch, rows, spans


def repeated_substrings(docs: DataFrame, config: SuffixConfig | None = None, id_col: str = "doc_id", text_col: str = "text", others: list[str] | None = None) -> DataFrame:
    """(bucket, kind, payload, k, h, text, id [, others]): the rows and what tells which of their bytes are repeats, as
    _spans_beside reads them. The named other columns come back as a struct.

    A byte is a repeat if a string of `least` bytes covers it that also starts in a row with a smaller id; strings are
    those of the whole input, within rows. Null texts count as empty. Rows without an id come after all others, and
    rows with equal ids don't repeat one another.
    """
    config = config or SuffixConfig()
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if others is not None:
        base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*others).alias("others"))
    base = base.withColumns({"k": F.coalesce("id", F.lit(LAST)), "h": F.xxhash64("text")})
    partitions = partitions_for(docs, config.partition_bytes)
    # beyond the most partitions there are, parts go on growing: a task takes one of its parts at a time
    size = plan_bytes(docs)
    parts = 4 << (max(partitions, size // (64 * config.partition_bytes) if size < 1 << 60 else 0) - 1).bit_length()

    sent = base.select("k", "h", "text").mapInArrow(_find_anchors(config, parts), MESSAGES)
    in_bucket = "bucket int, payload binary"
    found = stored(sent.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(_match_anchors(parts, config.split), in_bucket), "anchors")
    release(spark)

    contexts = _beside(base.select("k", "h", "text"), [found], parts, partitions).mapInArrow(_fetch_contexts(config, parts), MESSAGES)
    ranges = stored(contexts.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(_compare_contexts(config, parts), in_bucket), "ranges")
    release(spark)
    return _beside(base.select("k", "h", "text", "id", *["others"] * (others is not None)), [found, ranges], parts, partitions)


def remove_repeats(docs: DataFrame, config: SuffixConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept): each row's maximal removed stretches of bytes and the rest.

    See repeated_substrings for what is removed and how odd rows count.
    """
    config = config or SuffixConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, found in _spans_beside(batches, config):
            columns: list[list] = [[], [], [], [], []]
            for i, spans in zip(rows, found, strict=True):
                data = (batch.column(5)[i].as_py() or "").encode()
                kept, to = [], 0
                for low, high in spans:
                    kept.append(data[to:low])
                    to = high
                kept = b"".join([*kept, data[to:]])
                for column, value in zip(columns, (len(data), len(data) - len(kept), len(spans), spans, kept), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(6).take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    out = repeated_substrings(docs, config, id_col, text_col).mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the characters that lie in spans as a whole."""
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80  # noqa: E731  not the first byte of a character
    out, at = [], 0
    for low, high in spans:
        while inside(low) and low < high:
            low += 1
        while inside(high) and high > low:
            high -= 1
        out.append(data[at:low])
        at = high
    return b"".join([*out, data[at:]]).decode()


def without_repeats(docs: DataFrame, config: SuffixConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, their texts without the repeated bytes; of characters that are only in part repeats, all bytes stay."""
    config = config or SuffixConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, found in _spans_beside(batches, config):
            texts = []
            for i, spans in zip(rows, found, strict=True):
                text = batch.column(5)[i].as_py()
                texts.append(whole_characters(text.encode(), spans) if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(7).take(pa.array(rows))], ["text", "others"])

    others = [c for c in docs.columns if c != text_col]
    found = repeated_substrings(docs, config, id_col, text_col, others)
    schema = found.select("text", "others").schema
    clean = found.mapInArrow(run, schema)
    return clean.select(*(F.col("text").cast(docs.schema[text_col].dataType).alias(text_col) if c == text_col else F.col("others").getField(c).alias(c) for c in docs.columns))
