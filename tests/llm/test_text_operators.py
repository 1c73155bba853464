"""op2, op3, op5 and op10 against brute force, round trips and odd input."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheaf.llm import bpe, chat, packing, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, "a", "  ", "a  b", " \n x", "x \n\n  y ", "aaaa" * 700, "é" * 300, "The the  the  　 x", "x\x1c y", "don't 'S it's", "😀 <|endoftext|> 123456", "\r\n\r\n\t a", "ab " * 500, "ÀÉÎ ñandú " * 40]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.TreeEncoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


def test_bpe_matches_the_library(spark, library):
    docs = spark.createDataFrame(list(enumerate([*ODD, *ODD])), "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as n_tokens", "2 as id")
    for row in bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect():
        text = ([*ODD, *ODD][row.doc_id]) or ""
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert row.decoded == text.encode() and row.n_tokens == len(row.ids) // 4
    assert bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabbcde  éß\n\t'sTh1🙂中"), max_size=120))
def test_bpe_property(coder, library, text):
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_join_is_associative(coder):
    data = b"thethingthatthenetherein" * 9
    for i in range(1, len(data), 7):
        assert coder.join(coder.tree(data[:i]), coder.tree(data[i:])) == coder.tree(data)


TURNS = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "a\\\\</turn>### b"), (2, 1, "assistant", None), (2, 0, None, "x"), (3, 0, "tool: ### x", ""), (3, None, "user", "hi: there"), (None, 0, "user", "q"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 1, "assistant", "é" * 5000)]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as position", "'z' as segments")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, row in got.items():
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in TURNS if c == conv))
        assert row.n_turns == len(own)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].valid and not got[2].valid and not got[3].valid and not got[4].valid
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "x: y", "?"]), st.text(alphabet=st.sampled_from("\\#: </turn>aU"), max_size=30)), max_size=5))
def test_template_is_reversible(turns):
    template = chat.Template()
    assert list(template.parse("".join(x for role, text in turns for x, _ in template.segments(role, text)))) == turns


def test_packing_covers_every_id_without_padding(spark):
    texts = [*ODD, "word " * 3000, "one two three " * 700, *["short text"] * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "5 as length", "'q' as offset").coalesce(2)
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), packing.PackConfig(group_tokens=4000)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sequences = {}
    for doc, text in enumerate(texts):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        own, at = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start), 0
        for r in own:
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing_balances_cost():
    lengths = np.random.default_rng(1).integers(1, 400, 3000)
    rows = packing.pack(lengths, packing.PackConfig())
    assert rows[:, 2].sum() == lengths.sum()
    cost = np.bincount(rows[:, 3], rows[:, 2] + rows[:, 2].astype(float) ** 2 / 1024)
    full = np.bincount(rows[:, 3], rows[:, 2]) == 1024
    assert cost[full].max() < 1.35 * cost[full].mean()


PAGES = [(1, "http://a/\r\nx", "same"), (2, "http://b", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"), (7, "u", "é" * 9000), (7, "u", "é" * 9000), (None, "n", "same"), (8, "u", "é" * 9000)]


@pytest.mark.parametrize("least", [0, 1, 5])
def test_warc_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "7 as refers_to", "'y' as record_type")
    warc.write_warc(pages, f"file://{tmp_path}/w{least}", min_payload_bytes=least, records_per_file=3)
    rows = warc.read_warc(spark, f"file://{tmp_path}/w{least}").collect()
    assert len(rows) == len(PAGES)
    for page, url, html in PAGES:
        row = next(r for r in rows if r.page_id == page)
        payload = (html or "").encode()
        assert row.payload_bytes == len(payload) and row.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        best = max((p for p, _, h in PAGES if (h or "").encode() == payload and p is not None))
        if len(payload) < least or page == best:
            assert (row.record_type, row.refers_to, row.payload, row.digest_ok) == ("response", None, html or "", True)
        else:
            assert (row.record_type, row.refers_to, row.payload) == ("revisit", best, None)


def test_warc_of_no_pages(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_base32(spark):
    assert spark.range(1).select(warc.base32_sha1(__import__("pyspark").sql.functions.lit("abc"))).head()[0] == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


def test_reading_back_turns_out_of_order(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}") for c in (1, 2) for t in range(6)]
    formatted = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).coalesce(1)
    assert {r.conv_id: r.n_turns for r in chat.read_back(formatted).collect()} == {1: 6, 2: 6}
    for order in ("position", "-position", "conv_id, -position"):
        with pytest.raises(Exception, match="doesn't follow the one before it"):
            chat.read_back(formatted.coalesce(1).sortWithinPartitions(*(F.expr(o) for o in order.split(", ")))).collect()
    with pytest.raises(Exception, match="doesn't follow the one before it"):
        chat.read_back(formatted.where("position <> 2")).collect()
