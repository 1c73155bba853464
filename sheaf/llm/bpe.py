"""Byte-level BPE by a monoid tree reduction.

A piece is split in halves down to single bytes; two encoded neighbours are joined by re-encoding a window around
their border. Ranks are merged lowest first, leftmost on ties, so a sequence of tokens is the encoding of its bytes
exactly if every two neighbouring tokens are the encoding of theirs: the first merge to cross a border would also be
made with those two alone. A window has grown enough when its outer tokens and the tokens next to it pass that test;
nothing outside it can change then. Joining is associative, so any tree gives the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo

#: The characters that \s stands for in the tokenizers' pattern.
WHITE = "\\t\\n\\x0B\\x0C\\r\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"

#: White space followed by white space or by nothing.
IRREGULAR = re.compile(f"[{WHITE}](?:[{WHITE}]|\\Z)")


def words_of(text: str) -> list[str] | None:
    """A text cut before every space and every line feed, or None if it has white space next to white space or at its
    end. No match of the pattern holds a space or a line feed behind another character then, so the words' ids are the
    text's. The first word is written as it is, others without their space or with their line feed."""
    if IRREGULAR.search(text):
        return None
    first, *lines = text.split("\n")
    words = first.split(" ")
    for line in lines:
        head, *rest = line.split(" ")
        words.append("\n" + head)
        words += rest
    return words


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def compile_pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]"))


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class TreeEncoder:
    """Encodes and decodes with the given ranks; pattern cuts a text into pieces that are encoded one by one."""

    #: Windows up to so many bytes are merged by scanning, longer ones with a heap.
    SCANNED = 48

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 300_000):
        self.ranks, self.pattern = ranks, compile_pattern(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pairs, self.parts, self.chunks = Memo(400_000), Memo(100_000), Memo(memo)

    # -- windows

    def merged(self, data: bytes) -> list[int]:
        """The ids of a window: the lowest rank first, leftmost on ties."""
        ranks = self.ranks
        if len(data) > self.SCANNED:
            return self._merged_by_heap(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[x] for x in parts]

    def _merged_by_heap(self, data: bytes) -> list[int]:
        n, ranks = len(data), self.ranks
        end, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        queue: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if end[i] < n:
                to = end[end[i]]
                rank = ranks.get(data[i:to])
                if rank is not None:
                    heapq.heappush(queue, (rank, i, to))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, to = heapq.heappop(queue)
            if gone[i] or end[i] >= n or end[end[i]] != to:
                continue
            gone[end[i]] = 1
            end[i] = to
            if to < n:
                before[to] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def pair(self, x: int, y: int) -> tuple[int, ...]:
        """The ids of two tokens' bytes: (x, y) itself if their border is stable."""
        key = x << 24 | y
        found = self.pairs.get(key)
        if found is None:
            self.pairs.put(key, found := tuple(self.merged(self.tokens[x] + self.tokens[y])))
        return found

    # -- the monoid

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The ids of the bytes of a followed by those of b, for encodings a and b."""
        if not a or not b:
            return a or b
        window = self.pair(a[-1], b[0])
        if window == (a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            left = i == len(a) or self.pair(a[-i - 1], window[0]) == (a[-i - 1], window[0])
            right = j == len(b) or self.pair(window[-1], b[j]) == (window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + list(window) + b[j:]
            i = i if left else min(2 * i, len(a))
            j = j if right else min(2 * j, len(b))
            window = self.merged(b"".join(map(self.tokens.__getitem__, a[len(a) - i :] + b[:j])))

    def tree(self, data: bytes) -> list[int]:
        n = len(data)
        if n == 1:
            return [self.ranks[data]]
        if n <= 8:
            found = self.parts.get(data)
            if found is not None:
                return found
        out = self.join(self.tree(data[: n // 2]), self.tree(data[n // 2 :]))
        if n <= 8:
            self.parts.put(data, out)
        return out

    def piece(self, data: bytes) -> list[int]:
        """A piece that is a token as a whole is that token, as in the public library."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tree(data) if data else []

    # -- texts

    def _ids(self, text: str) -> bytes:
        out: list[int] = []
        for match in self.pattern.finditer(text):
            out += self.piece(match.group().encode())
        return packed(out)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        words = words_of(text)
        if words is None:
            return self._ids(text)
        found = [self._ids(words[0])]
        del words[0]
        found += map(self.chunks.young.get, words)
        at = 0
        try:
            while True:
                at = found.index(None, at)
                word = words[at - 1]
                ids = self.chunks.get(word)
                if ids is None:
                    ids = self._ids(word if word[:1] == "\n" else " " + word)
                    if len(word) < 64:
                        self.chunks.put(word, ids)
                found[at] = ids
        except ValueError:  # no word is left
            return b"".join(found)

    def decode(self, ids: list[int]) -> bytes:
        """Concatenates up the tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_ENCODERS: dict[tuple[str, str], TreeEncoder] = {}


def _encoder(path: str, pattern: str) -> TreeEncoder:
    """One of each per Python worker."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TreeEncoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids, decoded): every text's ids, packed as unsigned 32-bit integers, and the bytes they stand for.

    Null and empty texts have no ids. Rows stay one to one, repeated ones too; other columns are not looked at.
    No shuffle: a row is encoded where it is read. With keep_ids false the two binary columns come as SHA-256 hex
    digests instead (ids_sha256, decoded_sha256), so that nothing large leaves the Python worker.
    """
    kind = pa.binary() if keep_ids else pa.string()
    names = ("ids", "decoded") if keep_ids else ("ids_sha256", "decoded_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(ranks_path, pattern)
        seal = (lambda x: x) if keep_ids else (lambda x: hashlib.sha256(x).hexdigest())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, ids_out, back_out = [], [], []
                for text in part.column(1):
                    ids = coder.encode(text.as_py() or "")
                    counts.append(len(ids) // 4)
                    ids_out.append(seal(ids))
                    back_out.append(seal(coder.decode(np.frombuffer(ids, "<u4").tolist())))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids_out, kind), pa.array(back_out, kind)], ["id", "n_tokens", *names])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    typed = "binary" if keep_ids else "string"
    out = source.mapInArrow(run, f"id long, n_tokens long, {names[0]} {typed}, {names[1]} {typed}")
    return out.withColumnRenamed("id", id_col)
