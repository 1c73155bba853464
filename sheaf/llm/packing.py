"""Cost-balanced packing of tokenised documents into sequences."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The characters that \s stands for in the tokenizers' pattern; and white space next to white space or at the end.
WHITE_SPACE = r"\t\n\x0B\x0C\r\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
IRREGULAR_TEXT = rf"[{WHITE_SPACE}](?:[{WHITE_SPACE}]|\z)"


@dataclass(frozen=True)
class PackConfig:
    """capacity: tokens of a sequence. end_id: the id after each document. group_tokens: documents are packed together
    in groups of about so many tokens. A piece of n tokens costs linear * n + quadratic * n * n, as attention does."""

    capacity: int = 1024
    end_id: int = 0
    group_tokens: int = 1 << 20
    linear: float = 1.0
    quadratic: float = 1.0 / 1024


def pack(lengths: np.ndarray, config: PackConfig) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) of a group of documents with these lengths, all positive.

    Whole multiples of the capacity become full sequences of their own. The rest of each document, dearest first, goes
    to the cheapest sequence with room for it; where none has, the cheapest one with any room is filled up and what is
    left goes on as a shorter document. The open sequences hold exactly the tokens there are: full ones, and one of
    each power of two in the remainder, so that no sequence needs padding.
    """
    size = config.capacity
    whole, rest = lengths // size, lengths % size
    made = []
    if whole.sum():
        doc = np.repeat(np.arange(len(lengths)), whole)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
        made.append(np.stack([doc, nth * size, np.full(len(doc), size), np.arange(len(doc)), np.zeros(len(doc), np.int64)], 1))
    first = int(whole.sum())
    total = int(rest.sum())
    over = total % size
    room = np.array([size] * (total // size) + [1 << k for k in range(over.bit_length() - 1, -1, -1) if over >> k & 1], np.int64)
    capacity, cost = room.copy(), np.zeros(len(room))
    pieces: list[tuple[int, int, int, int, int]] = []
    price = config.linear * rest + config.quadratic * rest.astype(float) ** 2
    for doc in np.argsort(-price, kind="stable").tolist():
        left, start = int(rest[doc]), int(whole[doc]) * size
        while left:
            fits = np.where(room >= left, cost, np.inf)
            to = int(fits.argmin())
            if fits[to] == np.inf:
                to = int(np.where(room > 0, cost, np.inf).argmin())
            n = min(left, int(room[to]))
            pieces.append((doc, start, n, first + to, int(capacity[to] - room[to])))
            room[to] -= n
            cost[to] += config.linear * n + config.quadratic * n * n
            left, start = left - n, start + n
    if pieces:
        made.append(np.array(pieces, np.int64))
    return np.concatenate(made) if made else np.zeros((0, 5), np.int64)


class WordTable:
    """The ids of words, as numbers into one row of ids. When it has `size` words or 8 * size ids, the words that only
    one batch had are let go, and long ones, or all if too few are."""

    def __init__(self, size: int):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.edges, self.batches = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def find(self, words: list[str]) -> np.ndarray:
        """The numbers of the words, -1 for those that aren't held."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The numbers that new words get."""
        first = len(self.number)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(lengths)])
        self.batches = np.concatenate([self.batches, np.zeros(len(words), np.int32)])
        return np.arange(first, first + len(words))

    def make_room(self) -> None:
        """Between batches: numbers change."""
        if len(self.number) < self.size and len(self.ids) < 8 * self.size:
            return
        keep = np.flatnonzero((self.batches > 1) & (np.diff(self.edges) < 32))
        if len(keep) > self.size // 2:
            self.clear()
            return
        words, times = list(self.number), self.batches[keep]
        ids, lengths = self.gathered(keep)
        self.clear()
        self.add([words[i] for i in keep.tolist()], ids, lengths)
        self.batches = times

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, one after the other, and how many each has."""
        start, lengths = self.edges[numbers], self.edges[numbers + 1] - self.edges[numbers]
        place = np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        return self.ids[place], lengths


class ChunkTokenizer:
    """A tokenizer file's ids of whole texts. Texts are cut where the byte-level pattern always cuts, before each space
    and each line feed; each distinct word of a batch is looked up once, and encoded by the tokenizer once, as long as it
    is remembered. Texts with white space next to white space or at their end, and such as hold a special token, are
    encoded as they are."""

    #: Stands in front of a text's first word, which has no space: regular texts have no two line feeds in a row.
    FIRST = "\n\n"

    def __init__(self, path: str, words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = WordTable(words)
        tokens = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(tokens.values(), default=-1) + 1, np.int64)
        self.bytes_of[list(tokens.values())] = list(map(len, tokens))  # a byte is a character of a token's name

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _encode_words(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of keys of the table: first words one by one, the others as one text, which the bytes of its tokens
        cut into words again."""
        first = np.fromiter((x.startswith(self.FIRST) for x in keys), bool, len(keys))
        alone, of_alone = self._encode([keys[i][2:] for i in np.flatnonzero(first).tolist()])
        written = [x if x[:1] == "\n" else " " + x for x, f in zip(keys, first.tolist(), strict=True) if not f]
        joined, _ = self._encode(["".join(written)])
        ends = np.cumsum(pc.binary_length(pa.array(written, pa.string())).to_numpy(zero_copy_only=False))
        of_joined = np.diff(np.searchsorted(np.cumsum(self.bytes_of[joined]), ends, "right"), prepend=0)
        lengths = np.empty(len(keys), np.int64)
        lengths[first], lengths[~first] = of_alone, of_joined
        ids = np.empty(int(lengths.sum()), np.uint32)
        belongs = np.repeat(first, lengths)
        ids[belongs], ids[~belongs] = alone, joined
        return ids, lengths

    def regular(self, texts: pa.Array) -> np.ndarray:
        held = pc.match_substring_regex(texts, IRREGULAR_TEXT)
        for special in self.special:
            held = pc.or_(held, pc.match_substring(texts, special))
        return ~held.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Of each text (a string array without nulls), its ids as unsigned 32-bit integers."""
        regular = self.regular(texts)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        at = np.flatnonzero(regular)
        if len(at):
            cut = pc.replace_substring(texts.take(pa.array(at)), "\n", " \n")
            words = pc.split_pattern(pc.binary_join_element_wise(self.FIRST, cut, ""), " ")
            coded = words.flatten().dictionary_encode()
            edges = words.offsets.to_numpy() - words.offsets[0].as_py()
            keys = coded.dictionary.to_pylist()
            self.table.make_room()
            numbers = self.table.find(keys)
            new = np.flatnonzero(numbers < 0)
            if len(new):
                ask = [keys[i] for i in new.tolist()]
                numbers[new] = self.table.add(ask, *self._encode_words(ask))
            self.table.batches[numbers] += 1
            ids, lengths = self.table.gathered(numbers[coded.indices.to_numpy()])
            ends = np.concatenate([[0], np.cumsum(lengths)])[edges]
            for i, low, high in zip(at.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out[i] = ids[low:high]
        rest = np.flatnonzero(~regular)
        if len(rest):
            ids, lengths = self._encode(texts.take(pa.array(rest)).to_pylist())
            for i, piece in zip(rest.tolist(), np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                out[i] = piece
        return out


def stretches(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(start, end) of neighbouring texts that have about `size` bytes together."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, to
        at = to


_TOKENIZERS: dict[str, ChunkTokenizer] = {}

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, config: PackConfig | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids]) of each piece of each document.

    Null and empty texts are documents of the end id alone. Every task packs the documents it reads, in groups of
    about config.group_tokens tokens: no shuffle, bounded memory, and a lost task repeats the same work. A sequence
    holds capacity tokens, or a power of two of them, without padding. Repeated rows are packed as often as they
    occur. sequence_id is unique; its high bits are the task's number.
    """
    config = config or PackConfig()
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _TOKENIZERS.get(tokenizer_path) or _TOKENIZERS.setdefault(tokenizer_path, ChunkTokenizer(tokenizer_path))
        following = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        end = np.array([config.end_id], "<u4")
        ids, keys, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal following, held
            lengths = np.array([len(x) for x in ids], np.int64)
            rows = pack(lengths, config)
            first = (np.cumsum(lengths) - lengths)[rows[:, 0]] + rows[:, 1]
            every = memoryview(np.concatenate(ids).astype("<u4", copy=False)).cast("B")
            cuts = [every[4 * s : 4 * (s + n)] for s, n in zip(first.tolist(), rows[:, 2].tolist(), strict=True)]
            columns = [pa.array(keys, pa.int64()).take(pa.array(rows[:, 0])), rows[:, 1], rows[:, 2], [zlib.crc32(x) for x in cuts], lengths[rows[:, 0]], rows[:, 3] + following, rows[:, 4]]
            out = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns]
            if keep_ids:
                out.append(pa.array([bytes(x) for x in cuts], pa.binary()))
            following += int(rows[:, 3].max()) + 1
            ids.clear(), keys.clear()
            held = 0
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for at, to in stretches(texts):
                for key, got in zip(batch.column(0)[at:to].to_pylist(), coder.encode(texts[at:to]), strict=True):
                    keys.append(key)
                    ids.append(np.concatenate([got, end]))
                    held += len(got) + 1
                    if held >= config.group_tokens:
                        yield flush()
        if ids:
            yield flush()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, PIECES + ", ids binary" * keep_ids).withColumnRenamed("id", id_col)
