import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from lattica.llm import bpe, chunks, packing
from tokenizers import Tokenizer

from tests.llm.conftest import EDGE_TEXTS


def strange_texts():
    rng = random.Random(7)
    parts = ["the", " of", "  ", "\n", "\n\n", " \n ", "\t", "é", "日本", "🙂", "'s", "'ll", "12", ".", "!?", " ", " ", "\x85", "<|endoftext|>", "ab" * 9, "İ", "ǅ", "²", "़"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    path = bpe.default_path()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=chunks.read_ranks(path), special_tokens={})


def texts_of(spark, sf="sf0.001"):
    return {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}


def test_codec_against_the_library(library):
    texts = [*strange_texts(), *EDGE_TEXTS, "x" * 1500 + "ab" * 700]
    made = bpe.Codec(bpe.default_path()).encode_batch(texts)
    for text, (ids, decoded) in zip(texts, made, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(text or "")
        assert decoded == (text or "").encode()


def test_recursion_and_heap_agree():
    codec = bpe.Codec(bpe.default_path())
    rng = random.Random(8)
    words = [bytes(rng.choices(b"abcdefghij xyz", k=rng.randrange(1, 60))) for _ in range(200)]
    for word, ids in zip(words, codec.encode_words(words), strict=True):
        assert ids.tolist() == codec._heap(word)
    assert codec.decode(codec.encode_words([*words, b""])) == [*words, b""]


def test_cost_of_the_recursion():
    """A step costs a word's list once and two lookups, so long words stay near the heap's cost; steps over a sorted row a token take about ten times it."""
    codec = bpe.Codec(bpe.default_path())
    rng = random.Random(9)
    words = ["".join(rng.choices(["en", "th", "e", "a", "ing", "ion", "x", "q"], k=240)).encode()[: bpe.LONG - 12] for _ in range(300)]
    began = time.process_time()
    heap = [codec._heap(w) for w in words]
    between = time.process_time()
    found = [x.tolist() for x in codec.encode_words(words)]
    assert found == heap
    assert time.process_time() - between < 4 * (between - began)


def test_words_are_cut_as_the_pattern_cuts():
    rng = random.Random(10)
    space = [chr(k) for k in range(0x3001) if chr(k).isspace() or chunks._SPLIT.fullmatch(chr(k)) and chunks._ADJACENT.match(2 * chr(k))]
    plain = [" ".join(rng.choices(["a", "bc,d", "'s", "é", "日本語", "x.\ny", "12.5", "\u0085"], k=rng.randrange(9))) for _ in range(300)]
    mixed = ["".join(rng.choices(["a", "b.", " ", "'ll", *space], k=rng.randrange(9))) for _ in range(300)]
    for texts in ([], [""], ["", " ", " a ", "a"], ["a  b"] * 3, plain, mixed, [*plain, *mixed], [*strange_texts(), *(x or "" for x in EDGE_TEXTS)]):
        words, many, pieces, counts = chunks.cut_texts(pa.array(texts, type=pa.large_string()))
        of_piece = np.split(np.array(words, dtype=object), np.cumsum(many)[:-1]) if len(many) else []
        found = [[w for p in x for w in of_piece[p]] for x in np.split(pieces, np.cumsum(counts)[:-1])] if texts else []
        assert found == [chunks.pretokens(x) for x in texts]


def test_memory_and_slices_do_not_change_ids(monkeypatch, library):
    """Small slices, small queries and a memory that is emptied, with texts of many sizes and nulls between them."""
    for name, most in (("WORDS", 50), ("QUERY_WORDS", 7), ("QUERY_SQUARES", 300), ("SLICE_BYTES", 200)):
        monkeypatch.setattr(bpe, name, most)
    rng = random.Random(11)
    texts = [None, *strange_texts()[:120], "ab" * 300, "", *("".join(rng.choices("ab", k=k)) + " end" for k in (1, 90, 511, 512, 513))]
    for text, (ids, decoded) in zip(texts, bpe.Codec(bpe.default_path()).encode_batch(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(text or "")
        assert decoded == (text or "").encode()


def test_digests_of_a_table(spark, library, edge_docs, no_docs):
    texts = texts_of(spark)
    found = bpe.digests(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.digests(edge_docs).count() == edge_docs.count() and bpe.digests(no_docs).count() == 0
    assert [list(r.ids) for r in bpe.encode(edge_docs).where("doc_id = 3").collect()] == [library.encode_ordinary("one")] * 2


def test_byte_level_against_tokenizers():
    path = packing.default_path()
    whole = Tokenizer.from_file(path)
    one = chunks.byte_level(path)
    cache = chunks.ChunkCache(lambda some: [one(x) for x in some])
    texts = [(x or "").replace("<|endoftext|>", "<|end|>") for x in [*strange_texts(), *EDGE_TEXTS]]
    for text, parts in zip(texts, cache.batch(texts), strict=True):
        assert [k for p in parts for k in p] == whole.encode(text or "", add_special_tokens=False).ids


def check_pieces(pieces, texts, ids_of):
    fill, seen = {}, {}
    for p in pieces:
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
        seen.setdefault(p.doc_id, []).append(p)
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert sorted(fill) == list(range(len(fill)))
    assert sum(sum(n for _, n in s) < 2048 for s in fill.values()) <= 1
    for doc, own in seen.items():
        ids, at = ids_of(texts[doc]), 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert set(seen) == set(texts)


def test_packing_round_trip(spark, no_docs):
    whole = Tokenizer.from_file(packing.default_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    check_pieces(packing.pack(docs).collect(), texts_of(spark), lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 1])
    edge = spark.createDataFrame(list(enumerate(EDGE_TEXTS)), "doc_id long, text string").repartition(3)
    check_pieces(packing.pack(edge).collect(), dict(enumerate(EDGE_TEXTS)), lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 1])
    assert packing.pack(no_docs).count() == 0


def test_packing_special_strings(spark):
    whole = Tokenizer.from_file(packing.default_path())
    texts = {k: x for k, x in enumerate(["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n x", "<|endoftext", *strange_texts()])}
    assert 50256 in whole.encode(texts[1], add_special_tokens=False).ids
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    check_pieces(packing.pack(df).collect(), texts, lambda t: [*whole.encode(t, add_special_tokens=False).ids, 1])


def test_packing_repeated_rows(spark, edge_docs):
    pieces = packing.pack(edge_docs).collect()
    assert sum(p.length for p in pieces if p.doc_id == 3) == 2 * next(p.doc_tokens for p in pieces if p.doc_id == 3)
