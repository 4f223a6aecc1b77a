"""Byte-level BPE against the tiktoken library, and the way back."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tapeworks.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def model():
    return byte_bpe.model_json(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def texts():
    draw = random.Random(5)
    odd = ["a", "b", "Z", "'s", "'ll", "é", "ß", "中", "🙂", "́", "1", "２", "_", "!", "--", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "\x00", "<|endoftext|>"]
    mixed = ["".join(draw.choice(odd) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    return [None, "", " ", "\n\n", "a" * 5000, "=" * 3000, " " * 2000 + "x", "🙂" * 300, *mixed, *mixed[:5], " ".join(mixed)]


def test_pieces_join_to_the_text():
    for t in texts():
        assert "".join(byte_bpe.pieces(t or "")) == (t or "")


def test_same_ids_as_tiktoken_and_back(spark, model, reference):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, ids string, n_tokens string")
    tokens = byte_bpe.encode(docs, model)
    got = {r["doc_id"]: r for r in tokens.collect()}
    back = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(tokens, model).collect()}
    assert set(got) == set(back) == {i for i, _ in rows}
    for i, t in rows:
        t = t or ""
        ids = reference.encode_ordinary(t)
        assert byte_bpe.numbers(got[i]["ids"]) == ids and got[i]["n_tokens"] == len(ids), repr(t)
        assert back[i] == t.encode()


def test_places_name_the_characters_of_each_token(spark, model, reference):
    t = "a 🙂 é中\U00013000 ok"
    row = byte_bpe.encode(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).first()
    ids, starts, ends = (byte_bpe.numbers(row[c]) for c in ("ids", "first_char", "end_char"))
    at = inside = 0
    for i, s, e in zip(ids, starts, ends):
        piece = reference.decode_single_token_bytes(i)
        before, after = t.encode()[:at], t.encode()[: at + len(piece)]
        assert s == len((before + b"").decode("utf-8", "ignore")) and e == len(after.decode("utf-8", "replace"))
        inside += (t.encode()[at] & 0xC0) == 0x80
        at += len(piece)
    assert row["n_split"] == inside > 0


def test_empty_table_null_key_and_unknown_id(spark, model):
    docs = spark.createDataFrame([(None, "x y")], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(docs, model), model).first()["decoded"] == b"x y"
    assert byte_bpe.encode(docs.where("false"), model).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x7f"))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode(bad, model).collect()


def test_query(spark, reference):
    from tapeworks.llm.queries import op13_byte_bpe

    sf = "/root/testdata/sf0.001"
    texts_ = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts_)
    for r in rows:
        ids = reference.encode_ordinary(texts_[r["doc_id"]])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts_[r["doc_id"]].encode()).hexdigest()
