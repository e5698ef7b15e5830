"""Byte BPE, token counts and packing against the libraries and exact conditions."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from forewarn.llm import byte_bpe, packing, token_counts
from forewarn.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "é", "ß", "İ", "Σ", "中", "😀", "'s", "1", "!", "▁", "<s>", "</s>", "the",
         " th", "ing", "$$$", "​", "　", "\r\n", "<|endoftext|>", "\x00", "\x1c", "\x85", " ", "<0x0A>"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=40)
EDGES = ["", " ", "\n", "x" * 30_000, "ab " * 20_000, None]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


CODER = byte_bpe.coder(RANKS, public_tokenizers.PATTERN)
COUNTER = token_counts.counter(PIECES)
SENTENCEPIECE = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TOKENIZER = Tokenizer.from_file(WORDS)
WORD_TOKENS = packing.word_tokens(WORDS)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_byte_bpe_is_the_library(library, text):
    packed = CODER.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert CODER.decode(packed) == text.encode()


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_are_the_library(text):
    assert COUNTER.count(text) == len(SENTENCEPIECE.encode(text))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_tokens_are_the_library(text):
    ids = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(WORD_TOKENS.encode(text), "<u4").tolist() == ids


def test_whole_strings_encode_alone():
    for piece in random.Random(1).sample(sorted(COUNTER.whole), 300):
        if piece != token_counts.MARK:
            assert len(SENTENCEPIECE.encode(piece[1:])) == 1


def test_small_memory_gives_the_same(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 6)
    monkeypatch.setattr(token_counts, "REMEMBERED", 6)
    monkeypatch.setattr(packing, "REMEMBERED", 6)
    text = "the cat  sat on\n\nthe other mats, Don't! " * 3
    assert np.frombuffer(CODER.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert COUNTER.count(text) == len(SENTENCEPIECE.encode(text))
    assert np.frombuffer(WORD_TOKENS.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_model_needs_ranks_without_gaps(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"a") + b" 1\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(path))


def _edges(spark):
    rows = [(i, t, "x") for i, t in enumerate(EDGES)] + [(0, "", "x"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_operators_on_edges(spark, library):
    docs = _edges(spark)
    coded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    rows = coded.collect()
    assert len(rows) == len(EDGES) + 2
    by_id = {r.doc_id: r for r in rows}
    for i, text in enumerate(EDGES):
        assert np.frombuffer(by_id[i].ids, "<u4").tolist() == library.encode_ordinary(text or "")
        assert by_id[i].decoded == (text or "").encode()
    counts = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, PIECES).collect()}
    assert counts[2] == (1, 2) and counts[5] == (0, 0) and counts[0] == (0, 0) and counts[3][0] == 30_000
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


def test_queries_over_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op3_byte_bpe"](spark, sf_dir).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in QUERIES["op6_token_counts"](spark, sf_dir).collect():
        n = len(SENTENCEPIECE.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def _check_packing(rows, texts, capacity=2048):
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    found = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    expected = Counter()
    for doc_id, text in texts:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, i in enumerate(range(0, len(ids), capacity)):
            part = ids[i : i + capacity]
            expected[doc_id, piece, i, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert found == expected
    tokens = sum(r["length"] for r in rows)
    return len(at), -(-tokens // capacity)


def test_packing_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op9_bin_completion"](spark, sf_dir).collect()
    sequences, least = _check_packing(rows, docs)
    assert sequences <= least * 1.02 + 1


def test_packing_edges(spark):
    docs = _edges(spark)
    packed = packing.pack_documents(docs, WORDS, capacity=64)
    rows = packed.collect()
    _check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 64)
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 12), max_size=12))
def test_plan_places_every_piece(lengths):
    plan = packing.plan_sequences(lengths, 30, nodes=200)
    used = Counter()
    for times, filling in plan:
        assert times > 0 and sum(length * n for length, n in filling.items()) <= 30
        for length, n in filling.items():
            used[length] += times * n
    assert used == Counter(lengths)
    counts = np.zeros(31, np.int64)
    for length, n in lengths.items():
        counts[length] = n
    assert packing.lower_bound(counts, 30) <= packing.sequences_of(plan) <= packing.sequences_of(packing.best_fit(lengths, 30))


def _optimum(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                go(i + 1, [*(b for j, b in enumerate(bins) if j != bins.index(room)), room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_bound_and_plan_against_all_packings():
    draw = random.Random(5)
    worse = 0
    for _ in range(60):
        items = sorted((draw.randint(3, 20) for _ in range(draw.randint(1, 9))), reverse=True)
        counts = np.zeros(21, np.int64)
        for x in items:
            counts[x] += 1
        best, plan = _optimum(items, 20), packing.sequences_of(packing.plan_sequences(Counter(items), 20))
        assert packing.lower_bound(counts, 20) <= best <= plan
        worse += plan > best
    assert worse <= 2
