"""Operators 1, 5 and 6 against the public libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

from vellum.llm import bpe, packing, unigram

from .cases import SCHEMA, documents, frame

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


def reference(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def key(row):
    return tuple((x is not None, x) for x in row)


def test_encode_and_decode_are_exact(spark):
    enc = reference(MULTI)
    got = bpe.decode(bpe.encode(frame(spark), MULTI, P.PATTERN), MULTI).collect()
    want = []
    for i, text, *_ in documents():
        ids = enc.encode_ordinary(text or "")
        want.append((i, np.array(ids, dtype="<u4").tobytes(), (text or "").encode()))
    assert sorted(map(key, ((r[0], bytes(r[1]), bytes(r[2])) for r in got))) == sorted(map(key, want))


def test_digests(spark):
    enc = reference(MULTI)
    got = {tuple(r) for r in bpe.digests(frame(spark), MULTI, P.PATTERN).collect()}
    for i, text, *_ in documents():
        ids = np.array(enc.encode_ordinary(text or ""), dtype="<u4").tobytes()
        assert (i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()) in got


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_backtracking_equals_merging(name):
    import random

    enc = reference(P.path(name))
    own = bpe.BacktrackEncoder(bpe.parse_ranks(open(P.path(name), "rb").read()))
    r = random.Random(1)
    tokens = list(own.ranks)
    for n in range(3000):
        piece = b"".join(r.choice(tokens) for _ in range(r.randrange(1, 6))) if n % 2 else bytes(r.randrange(256) for _ in range(r.randrange(1, 30)))
        if piece in own.ranks:
            assert own.encode(piece) == [own.ranks[piece]]
        else:
            assert own.encode(piece) == enc._encode_single_piece(piece)


def test_every_character_is_split_as_the_library_does():
    enc = reference(MULTI)
    own = bpe.TextEncoder(lambda p, b=bpe.BacktrackEncoder(bpe.parse_ranks(open(MULTI, "rb").read())): b.encode(p.encode()), P.PATTERN)
    for lo in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)}1 {chr(c)}b " for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(own(text), "<u4").tolist() == enc.encode_ordinary(text), hex(lo)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.digests(none, MULTI, P.PATTERN).count() == 0
    assert packing.write(none, P.path("byte_bpe_50k.json"), P.PATTERN, 2) == []
    assert packing.read(spark, []).count() == 0
    assert unigram.token_counts(none, P.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 31])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint32)
    data = packing.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (packing.unpack(data, 1001, bits) == ids).all()


def test_token_files(spark):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = []
    for i, text, *_ in documents():
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        rows.append((i, ids))
    df = frame(spark)
    manifest = packing.write(df, path, P.PATTERN, 2, file_bytes=20_000)
    assert len(manifest) > 3 and sum(m["n_docs"] for m in manifest) == len(rows)
    got = packing.read(spark, manifest).collect()
    assert sorted(map(key, ((r[0], bytes(r[3])) for r in got))) == sorted(map(key, ((i, np.array(x, "<u4").tobytes()) for i, x in rows)))
    in_order = sorted(got, key=lambda r: r["start"])
    assert [key([r[0]]) for r in in_order] == sorted(key([r[0]]) for r in got)
    at = 0
    for r in in_order:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    crcs = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.round_trip(df, path, P.PATTERN, 2).collect()}
    assert crcs == {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["ids"])) for r in got}


def test_added_tokens_are_those_of_the_library():
    path = P.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), packing.LibraryEncoder(open(path).read(), P.PATTERN, 16)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>'s  y", "<|endoftext|", "<|endoftext|>|>\n\n 12"):
        assert np.frombuffer(own(text), "<u2").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_files_of_a_hot_id_and_of_null_ids(spark):
    rows = [(None if i % 3 else 7, f"text {i} of many", "en", "s", 1) for i in range(3000)] + [(i, "one", "en", "s", 1) for i in range(5)]
    manifest = packing.write(frame(spark, rows), P.path("byte_bpe_50k.json"), P.PATTERN, 2, file_bytes=4000)
    assert len(manifest) > 8 and max(m["n_docs"] for m in manifest) < 900
    ids = [r["doc_id"] for r in packing.read(spark, manifest).orderBy("start").collect()]
    assert ids == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))


def test_ids_that_the_vocabulary_lacks(spark):
    df = spark.createDataFrame([(1, bytearray(np.array([97, 60_000, 2**31, 98], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    token = {i: b for b, i in bpe.parse_ranks(open(MULTI, "rb").read()).items()}
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(df, MULTI).collect()} == {1: token[97] + token[98], 2: b""}


def test_caches_stay_within_their_bytes():
    own = bpe.TextEncoder(lambda p: list(p.encode()), P.PATTERN, limit=200_000)
    texts = [" ".join(f"w{i * 31 + k}" for k in range(50)) for i in range(200)]
    want = [bpe.TextEncoder(lambda p: list(p.encode()), P.PATTERN)(t) for t in texts]
    assert [own(t) for t in texts] == want and own.parts.size <= 200_000 and len(own.parts) + len(own.parts.old) < 2500


def test_random_access(spark):
    manifest = packing.write(frame(spark), P.path("byte_bpe_50k.json"), P.PATTERN, 2)
    fs, name = packing._filesystem(manifest[0]["path"])
    with fs.open_input_file(name) as source:
        file = packing.TokenFile(source)
        for k, (_, lo, ids) in enumerate(file.documents()):
            assert (file.document(k) == ids).all() and (file.tokens(lo, lo + len(ids)) == ids).all()


def test_unigram_counts_as_the_library(spark):
    path = P.path("piece_bpe_32k.model")
    vocab = unigram.vocabulary(path)
    lib = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = sorted(map(key, unigram.token_counts(frame(spark), path).collect()))
    assert got == sorted(key((i, len(lib.encode(t or "", add_special_tokens=False).ids))) for i, t, *_ in documents())
