import io
import random
import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardline.llm import token_count, token_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a  b", "a \n b", "\n\n x", "don't  we'll 've", "a<|endoftext|> b <|endoftext|>", "x\x1c y", "tab\t a\t", "é ü ñ ß", "Ա ա ῼ 中文 　 字", "é a", "a " * 500, "z" * 3000, " 's 's", "12 345 ²", "a b   c", "<|startoftext|>x", "  a  b"]


@pytest.fixture(scope="module")
def counter():
    return token_count.TokenCounter.of(BYTES)


@pytest.fixture(scope="module")
def tools():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS), token_files.Encoder.of(WORDS)


def test_whole_tokens_are_proved(counter):
    assert len(counter.whole) > 40_000
    assert {" the", "the", "\n"} <= counter.whole
    assert all(len(counter.tokenizer.encode(t).ids) == 1 for t in random.Random(1).sample(sorted(counter.whole), 300))


def test_letters_agree_below_the_bound(counter):
    texts = [f"a{chr(c)} {chr(c)}1 a{chr(c)}{chr(c)}b" for c in range(1, 0x530)]
    assert counter.count(pa.array(texts)).tolist() == [len(counter.tokenizer.encode(t).ids) for t in texts]


def test_odd_texts(counter, tools):
    assert counter.count(pa.array(ODD)).tolist() == [len(tools[0].encode(t, add_special_tokens=False).ids) for t in ODD]
    assert [bytes(x) for x in tools[2].encode(pa.array(ODD))] == [struct.pack(f"<{len(i)}I", *i) for i in (tools[1].encode(t, add_special_tokens=False).ids for t in ODD)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 's\n\t\x1c é<|endoftext|>12.Ωж中́"), max_size=40), min_size=1, max_size=4))
def test_any_text(counter, tools, texts):
    assert counter.count(pa.array(texts)).tolist() == [len(tools[0].encode(t, add_special_tokens=False).ids) for t in texts]
    assert [bytes(x) for x in tools[2].encode(pa.array(texts))] == [struct.pack(f"<{len(i)}I", *i) for i in (tools[1].encode(t, add_special_tokens=False).ids for t in texts)]


def test_counts_over_a_table(spark, tools):
    rows = [(1, None, 5), (2, "", None), (None, "Hello world", 1), (2, "", None), *[(9 + k, t, k) for k, t in enumerate(ODD)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = {(r.doc_id, r.text, r.n_tokens) for r in token_count.token_counts(docs, BYTES).collect()}
    assert got == {(i, t, len(tools[0].encode(t or "").ids)) for i, t, _ in rows}
    out = token_count.op1_token_counts(docs, BYTES, limit=2)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert out.filter("doc_id = 1").first()[1:] == (0, 0, False)
    assert out.count() == len(rows)
    assert token_count.op1_token_counts(docs.limit(0), BYTES).count() == 0


def test_files_round_trip(spark, tools, tmp_path):
    rows = [(5, "b c"), (3, None), (4, "Hello  world"), (5, "b c"), (5, "a"), (None, "n"), *[(100 + k, t) for k, t in enumerate(ODD)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    files = token_files.write_token_files(docs, f"file://{tmp_path}/x", WORDS, 1, files=3)
    got = sorted(tuple(r) for r in token_files.read_token_files(spark, files).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    ids = lambda t: [*tools[1].encode(t or "", add_special_tokens=False).ids, 1]
    want = sorted((-1 if k is None else k, n, c) for k, t in rows for n, c in [(len(ids(t)), zlib.crc32(struct.pack(f"<{len(ids(t))}I", *ids(t))))])
    assert sorted((-1 if r[1] is None else r[1], r[2], r[3]) for r in got) == want
    assert [-1 if r[1] is None else r[1] for r in got] == [w[0] for w in want]
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert {(r.doc_id, r.n_tokens) for r in token_files.op3_token_files(docs, WORDS).collect()} == {(r[1], r[2]) for r in got}
    assert token_files.op3_token_files(docs.limit(0), WORDS).count() == 0


def test_a_plain_decoder_reads_the_file_and_damage_is_found():
    out, squeeze = io.BytesIO(), zstandard.ZstdCompressor()
    writer = token_files.FrameWriter(out)
    import xxhash

    for key, plain in ((7, b"abcd" * 9), (None, b"efgh")):
        writer.add(key, squeeze.compress(plain), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF)
    writer.close()
    data = out.getvalue()
    reader = token_files.FrameReader(io.BytesIO(data))
    assert reader.keys == [7, None]
    assert reader.read(1) == b"efgh"
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"abcd" * 9 + b"efgh"
    broken = bytearray(data)
    broken[-9 - 12 + 8] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.FrameReader(io.BytesIO(bytes(broken))).read(1)
