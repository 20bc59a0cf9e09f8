import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from versalake.llm import bpe, bpe_codec, token_files
from versalake.llm.common import tokenizer_path

ALPHABET = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "é", "日", "12", "_", "<|endoftext|>", "the", "ing", "\t", " ", " ", "\x1c", "==", "🙂", "T", "ion", "́", "---"]
EDGE = ["", " ", "a " * 3 + " ", "x" * 5000, "=" * 3000, "ab" * 900 + "é" * 300, "a \n ", "a\n  b", "<|endoftext|><|endoftext|>", "aaaaaaa aaa aaaaaaaaaaa"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def texts():
    rng = random.Random(5)
    return EDGE + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(1500)]


def test_encoding_is_the_librarys(library):
    coder, all_ = bpe.load(tokenizer_path()), texts()
    ids, at = coder.encode(all_)
    for i, (text, e) in enumerate(zip(all_, library.encode_batch(all_, add_special_tokens=False))):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, text
    assert coder.decode(ids, at) == [library.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(at, at[1:])]


def test_speculation_agrees_with_exact_merging():
    coder = bpe.load(tokenizer_path())
    words = [w.encode() for t in texts() for w in coder.split(t)]
    ids, at = coder.encode_words(words)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [coder.merge(w) for w in words]


def test_decoding_of_broken_bytes(library):
    coder = bpe.load(tokenizer_path())
    ids = np.array([coder.byte_id[0xE6], coder.byte_id[0x41], coder.byte_id[0xFF]])
    assert coder.decode(ids, np.array([0, 3])) == [library.decode(ids.tolist(), skip_special_tokens=False)]


def rows(spark):
    data = [(i, t, i) for i, t in enumerate([*EDGE, None, "same text", "same text"])]
    return spark.createDataFrame(data, "doc_id long, text string, ids int")


def test_digests(spark, library):
    got = {r.doc_id: r for r in bpe_codec.digests(rows(spark), tokenizer_path()).collect()}
    for r in rows(spark).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_encode_then_decode(spark):
    encoded = bpe_codec.encode(rows(spark), tokenizer_path())
    assert encoded.columns == ["doc_id", "text", "ids"]
    back = bpe_codec.decode(encoded.drop("text"), tokenizer_path())
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text or "" for r in rows(spark).collect()}
    assert bpe_codec.encode(rows(spark).limit(0), tokenizer_path()).count() == 0


def test_token_files(spark, library, tmp_path):
    docs = rows(spark).repartition(3)
    index = token_files.write(docs, tokenizer_path(), f"file://{tmp_path}/tokens", length=8)
    got = {r.doc_id: r for r in token_files.read(index).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (start, len(ids))
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    total = index.agg(F.sum("n_tokens")).first()[0]
    seen = 0
    for file in [r.file for r in index.select("file").distinct().collect()]:
        reader = token_files.Reader(file)
        for i in range(sum(reader.file.get_batch(k).num_rows for k in range(reader.file.num_record_batches))):
            ids, mask = reader.sequence(i)
            assert len(ids) == len(mask) == 8
            seen += mask.sum()
    assert seen == total == start
    assert token_files.round_trip(docs.limit(0), tokenizer_path()).count() == 0


def thue_morse(n):
    """n letters and their complement: sums of byte times base^i, modulo 2^64, are equal for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join("ab"[b ^ x] for b in bits) for x in (0, 1)]


def test_chunks_of_equal_hash(library):
    coder = bpe.ByteBPE(tokenizer_path())
    rng = random.Random(6)
    all_ = [x for n in (1024, 2048, 4096, 65536) for x in thue_morse(n)] + texts()[:300]
    all_ += [" ".join(rng.choice(all_) for _ in range(3)) for _ in range(40)]
    for some in (all_, all_[::-1]):
        ids, at = coder.encode(some)
        assert coder.decode(ids, at) == [library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in some]
        for i, (text, e) in enumerate(zip(some, library.encode_batch(some, add_special_tokens=False))):
            assert ids[at[i] : at[i + 1]].tolist() == e.ids


@pytest.mark.parametrize("same", [lambda d, p, q: np.zeros(len(p), np.uint64), lambda d, p, q: (q - p).astype(np.uint64)])
def test_forced_collisions(library, monkeypatch, same):
    coder = bpe.ByteBPE(tokenizer_path())
    monkeypatch.setattr(coder, "_hashes", same)
    for part in (texts()[:200], texts()[100:400]):
        ids, at = coder.encode(part)
        for i, (text, e) in enumerate(zip(part, library.encode_batch(part, add_special_tokens=False))):
            assert ids[at[i] : at[i + 1]].tolist() == e.ids, text


def test_memory_starts_afresh(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    coder = bpe.ByteBPE(tokenizer_path())
    for text in texts()[:300]:
        assert coder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_very_long_words(library):
    coder = bpe.load(tokenizer_path())
    rng = random.Random(7)
    for word in ("".join(rng.choice("etaoinshrdlu日本éü") for _ in range(60_000)), "=" * 100_000, "internationalization" * 3000):
        assert coder.encode([word])[0].tolist() == library.encode(word, add_special_tokens=False).ids
