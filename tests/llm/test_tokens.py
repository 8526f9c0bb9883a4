"""Token files, counts and byte-level BPE against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import byte_bpe, token_counts, token_store

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, " ", "\n", "a", "It's 12 o'clock.\n\n\nYes  we'll  go!", "x<|endoftext|>y \n\n<|endoftext|>", "ünïcödé 漢字 \U0001f600", "a" * 5000, "Wort. " * 4000, "\t\r\n tab", "end  ", "same", "same"]
SCHEMA = "doc_id long, text string, ids string, start string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranks():
    found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=found, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


def random_texts(n, seed):
    random.seed(seed)
    parts = ["a", "b", " ", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\xa0", "é", "ñ", "漢字", "'s", "'ll", "'", "1", "22", "<|endoftext|>", "<|endof", "!", ".", ",", "***", "\x1c", "\x85", "​", "\U0001f600", "the", "THE", "́", "\x00", "　", "½", "ʰ"]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 11))) for _ in range(n)]


def test_random_texts_equal_the_libraries(library, ranks):
    count, bpe, encode = token_counts.TokenCounter(JSON), byte_bpe.ByteBpe(RANKS), token_store.LibraryEncoder(JSON)
    for text in random_texts(8000, 3):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert count(text) == len(wanted), repr(text)
        assert np.frombuffer(encode(text), "<u4").tolist() == wanted, repr(text)
        packed = bpe.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ranks.encode_ordinary(text), repr(text)
        assert bpe.decode(packed) == text.encode()


def test_every_token_is_its_own_encoding():
    merges = byte_bpe.Merges(byte_bpe.read_ranks(RANKS))
    for token, rank in random.Random(1).sample(sorted(merges.ranks.items()), 3000):
        assert merges.encode(token) == [rank]


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_packing(bits):
    for n in (0, 1, 7, 8, 9, 999):
        ids = np.random.default_rng(n).integers(0, 1 << bits, n, np.uint64).astype(np.uint32)
        data = token_store.pack(ids, bits)
        assert len(data) == -(-n * bits // 8) and (token_store.unpack(data, n, bits) == ids).all()
    assert token_store.bits_for(50257) == 16 and token_store.bits_for(2) == 1


def test_random_access(tmp_path):
    rng = np.random.default_rng(5)
    held = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 3, 1000, 1, 64, 0, 500)]
    writer = token_store.TokenWriter(str(tmp_path / "a.tok"), 13, 64)
    for k, ids in enumerate(held):
        writer.add(None if k == 1 else k, ids)
    assert writer.close() == (7, sum(map(len, held)))
    file, flat = token_store.TokenFile(str(tmp_path / "a.tok")), np.concatenate(held)
    assert file.doc_ids.to_pylist() == [0, None, 2, 3, 4, 5, 6]
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(flat) + 1, 2))
        assert (file.ids(a, b) == flat[a:b]).all()
    assert all((file.document(k) == ids).all() for k, ids in enumerate(held))


def test_token_files(spark, docs, library):
    more = docs.unionAll(spark.createDataFrame([(None, "no id", "", ""), (3, "other text of 3", "", "")], SCHEMA))
    manifest = token_store.write_tokens(more, JSON, end_id=2, block_tokens=64)
    got = token_store.read_tokens(manifest, with_ids=True, at_once=100).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([*range(len(TEXTS)), 3, None], key=lambda i: -1 if i is None else i)
    assert len(got) == len(TEXTS) + 2
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
        if r.doc_id not in (None, 3):
            assert r.ids[:-1] == library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
    assert token_store.read_tokens(token_store.write_tokens(docs.limit(0), JSON, 2)).collect() == []


def test_counts(docs, library):
    got = {r.doc_id: r for r in token_counts.count_report(docs, JSON).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    kept = token_counts.token_counts(docs.withColumn("n_tokens", F.lit("x")), JSON)
    assert set(kept.columns) == {*docs.columns, "n_tokens"} and kept.count() == len(TEXTS)
    assert token_counts.token_counts(docs.limit(0), JSON).collect() == []


def test_bpe(docs, ranks):
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, RANKS).collect()}
    for i, t in enumerate(TEXTS):
        ids = ranks.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = byte_bpe.encode_texts(docs, RANKS)
    back = {r.doc_id: r for r in byte_bpe.decode_ids(encoded, RANKS).collect()}
    assert all(bytes(back[i].decoded) == (t or "").encode() and back[i].ids == ranks.encode_ordinary(t or "") for i, t in enumerate(TEXTS))
    assert back[0].start == "clash"
    both = {r.doc_id: r for r in byte_bpe.encode_and_decode(docs, RANKS).collect()}
    assert all(both[i].ids == back[i].ids and both[i].ids_sha256 == got[i].ids_sha256 and both[i].decoded_sha256 == got[i].decoded_sha256 for i in got)
    assert byte_bpe.round_trip(docs.limit(0), RANKS).collect() == []


def test_int_ids_become_long(spark):
    import public_tokenizers

    from tidemill.llm import byte_bpe, token_counts

    docs = spark.createDataFrame([(1, "some words"), (None, None)], "doc_id int, text string")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for out in (token_counts.count_report(docs, public_tokenizers.path("byte_bpe_50k.json")), byte_bpe.round_trip(docs, ranks), byte_bpe.encode_and_decode(docs, ranks)):
        assert {r.doc_id for r in out.collect()} == {1, None} and dict(out.dtypes)["doc_id"] == "bigint"
