import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roadlens.llm import packing, queries, tokens
from roadlens.llm.encoder import encoder, tokenizer_version
from roadlens.session import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_agrees_with_the_library(library):
    ids = encoder(PATH)
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)}!" for c in [*range(0xD800), *range(0xE000, 0x11000)]]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(text).tolist() == want.ids
    for text in ("<|endoftext|>", "x<|endoftext|>y <|endoftext|", "   \n\n  x", "can't WE'LL 123abc", ""):
        assert ids(text).tolist() == ids_of(library, text)


def test_other_kinds_of_tokenizers():
    assert len(encoder(public_tokenizers.path("piece_bpe_32k.model"))("a short text")) > 0
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder(public_tokenizers.path("word_bpe_49k.json"))("A Short text").tolist() == whole.encode("A Short text", add_special_tokens=False).ids


def test_counts(spark, awkward, library):
    got = [tuple(r)[:4] for r in tokens.token_counts(awkward, PATH, fresh_path(spark, "cache"), limit=5).collect()]
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(ids_of(library, r["text"])), n > 5) for r in awkward.collect()]
    assert Counter(got) == Counter(want)


def test_cache_encodes_only_new_texts(spark, awkward, crowd, empty):
    path = fresh_path(spark, "cache")
    assert tokens.token_counts(empty, PATH, path).count() == 0
    tokens.token_counts(awkward, PATH, path).count()
    size = spark.read.parquet(path).count()
    assert size == awkward.select("text").na.fill("").distinct().count()
    again = tokens.token_counts(awkward, PATH, path)
    assert spark.read.parquet(path).count() == size and again.count() == awkward.count()
    tokens.token_counts(crowd, PATH, path).count()
    assert spark.read.parquet(path).count() == size + crowd.select("text").distinct().count()


def test_versions_differ():
    assert tokenizer_version(PATH) != tokenizer_version(public_tokenizers.path("word_bpe_49k.json"))


def packed_whole(docs, rows, library, room):
    """Pieces put together are the documents; sequences are gapless and within their room."""
    want = Counter()
    for r in docs.collect():
        want[(r["doc_id"], tuple([*ids_of(library, r["text"]), 0]))] += 1
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= room
    crc = Counter()
    for (doc, ids), n in want.items():
        first, at = len(ids) % room or room, 0
        for piece, stop in enumerate(range(first, len(ids) + 1, room)):
            crc[(doc, piece, at, stop - at, zlib.crc32(np.array(ids[at:stop], "<u4").tobytes()))] += n
            at = stop
    assert crc == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    return len(by_sequence)


@pytest.mark.parametrize("room", [16, 2048])
def test_packing_round_trip(awkward, empty, library, room):
    rows = packing.pack(awkward, PATH, room).collect()
    packed_whole(awkward, rows, library, room)
    assert packing.pack(empty, PATH, room).count() == 0


def test_packing_in_many_tasks(crowd, library, monkeypatch):
    monkeypatch.setattr(packing, "FIRST_ROUND", 20)
    rows = packing.pack(crowd, PATH, 256).collect()
    n = packed_whole(crowd, rows, library, 256)
    assert n <= 1.15 * sum(r["length"] for r in rows) / 256 + 1


def test_equal_rows_are_dealt_to_many_tasks(spark, library, monkeypatch):
    """Rows that share id and text, with and without an id, don't meet in one bucket."""
    monkeypatch.setattr(packing, "FIRST_ROUND", 100)
    docs = spark.createDataFrame([(None, "a few words")] * 1500 + [(4, "a few more words")] * 1500, "doc_id long, text string").repartition(4)
    rows = packing.pack(docs, PATH, 64).collect()
    packed_whole(docs, rows, library, 64)
    buckets = Counter((r["sequence_id"] >> 30) & ((1 << 20) - 1) for r in rows)
    assert len(buckets) > 1 and max(buckets.values()) < 1500


def test_sum_of_squares_wastes_little():
    """Few copies of many lengths are the rule's worst case; texts' lengths pack within a part in a thousand."""
    rng = np.random.default_rng(3)
    texts = np.minimum(2047, rng.lognormal(6.2, 0.9, 20_000).astype(np.int64) + 1)
    assert len(packing.sum_of_squares(texts, 2048)[2]) <= 1.01 * texts.sum() / 2048
    lengths = rng.integers(1, 2048, 5000)
    bins, offsets, gaps = packing.sum_of_squares(lengths, 2048)
    assert np.bincount(bins, lengths).max() <= 2048 and len(gaps) == bins.max() + 1
    assert len(gaps) <= 1.06 * lengths.sum() / 2048
    assert (2048 - np.bincount(bins, lengths) == gaps).all()


def test_queries(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = queries.op10_best_fit_packing(spark, small).collect()
    packed_whole(docs, rows, library, 2048)
    counts = {r["doc_id"]: r["n_tokens"] for r in queries.op1_token_counts(spark, small).collect()}
    assert counts == {r["doc_id"]: len(ids_of(library, r["text"])) for r in docs.collect()}
