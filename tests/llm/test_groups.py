"""Near duplicates, components, passages, fingerprints and shards against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forewarn.llm import components, ctph, near_dedup, prefilter, sharding, shingles, substring_dedup
from forewarn.llm.queries import QUERIES
from tests.llm import brute


def _words(draw, n):
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n)]


def _documents(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")


# Components


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, links):
    groups = brute.Groups()
    for a, b in links:
        if a != b:
            groups.join(a, b)
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    rows = [(r.node, r.component) for r in found.collect()]
    assert sorted(rows) == sorted((x, groups.find(x)) for x in list(groups))


def test_components_of_a_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.component) for r in components.connected_components(links).collect()} == {0}


# Near duplicates


def _check_near(spark, rows, size, percent):
    found = near_dedup.near_duplicate_groups(_documents(spark, rows), size, percent).collect()
    expected = brute.near_groups(rows, size, percent)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_near_groups_on_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = brute.near_groups(rows, 3, 85)
    for r in QUERIES["op1_minhash_near_dedup"](spark, sf_dir).collect():
        assert (r.n_shingles, r.component_id) == expected[r.doc_id]
    _check_near(spark, rows, 5, 80)


def test_near_groups_in_crowded_buckets(spark, monkeypatch):
    """Many texts around the threshold, in small blocks, so that the rest and its blocks are used."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    draw = random.Random(3)
    base = _words(draw, 60)
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        words = list(base)
        for _ in range(draw.randint(1, 6)):
            words[draw.randrange(60)] = draw.choice(base)
        rows.append((i, " ".join(words)))
    draw.shuffle(rows)
    _check_near(spark, rows, 3, 85)


def test_near_edges(spark):
    long = "word " * 50_000
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A b"), (4, "a  B"), (5, "a b c"), (6, long), (7, long + "end"), (8, "é"), (9, "É")]
    _check_near(spark, rows, 3, 85)
    found = near_dedup.near_duplicate_groups(_documents(spark, [(None, "a b c"), (5, "a b c"), (5, "a b c"), (9, "a b c")]))
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in found.collect()), key=str) == [
        (5, 5, True), (5, 5, True), (9, 5, False), (None, None, True)]
    assert near_dedup.near_duplicate_groups(_documents(spark, [])).count() == 0


def test_estimate_is_corrected_for_chance():
    draw = np.random.default_rng(1)
    common, own = draw.integers(0, 2**63, 800, np.uint64), draw.integers(0, 2**63, (2, 100), np.uint64)
    errors = []
    a, b = (near_dedup.packed_bits(near_dedup.minima(np.concatenate([common, o]))) for o in own)
    x = np.array(a, np.int64).view(np.uint64) ^ np.array(b, np.int64).view(np.uint64)
    differs = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    errors = near_dedup.estimated_similarity(near_dedup.HASHES - int(np.bitwise_count(differs).sum())) - 0.8
    assert abs(errors) < 0.15


def test_bit_counts_in_the_plan(spark):
    draw = np.random.default_rng(2)
    least = draw.integers(0, 2**32, (2, near_dedup.HASHES)).astype(np.uint64)
    least[1, ::2] = least[0, ::2]
    a, b = (near_dedup.packed_bits(x) for x in least)
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    assert df.select(near_dedup.matches("a", "b")).first()[0] == int(((least[0] ^ least[1]) & np.uint64(3) == 0).sum())


def test_shingle_sets():
    for size in (1, 3, 5):
        for text in ("", "a", "a b", "a b a b a b", "A a\tb\x0bc\x0cd\re", "a b c"):
            assert len(shingles.shingle_set(text, size)) == len(brute.shingles(text, size))


def test_prefilter_loses_no_key(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("k"), F.lit(1).alias("_hit_"))
    keys = spark.range(0, 3000, 7).select(F.when(F.col("id") > 7, F.col("id")).alias("key"))
    for bits in (64, 1 << 25):
        monkeypatch.setattr(prefilter, "BITS", bits)
        likely, rest = ([r.k for r in part.collect()] for part in prefilter.split(rows, "k", keys))
        assert {k for k in range(14, 3000, 7) if k % 50} <= set(likely)
        assert len(likely) + len(rest) == 3000
    assert len(likely) < 450
    assert prefilter.likely_in(rows, "k", keys.limit(0)).count() == 0


# Passages


def test_chunks_resist_insertions():
    draw = random.Random(4)
    words = _words(draw, 400)
    text = " ".join(words).encode()
    changed = " ".join([*words[:200], "inserted", *words[200:]]).encode()
    a, b = (set(substring_dedup.digests(t, substring_dedup.chunks(t)).tolist()) for t in (text, changed))
    assert len(a - b) <= 3
    first, end, n = substring_dedup.chunks(text)
    assert n.sum() == 400 and b" ".join(text[s:e] for s, e in zip(first, end)) == text


def test_passages_go_and_clean_texts_stay(spark):
    draw = random.Random(5)
    passage = " ".join(_words(draw, 60))
    rows = [(i, " ".join(_words(draw, 80))) for i in range(40)]
    planted = []
    for i in range(40, 60):
        before, after = " ".join(_words(draw, 50)), " ".join(_words(draw, 50))
        planted.append((i, before, after))
        rows.append((i, f"{before} {passage} {after}"))
    draw.shuffle(rows)
    out = {r.doc_id: r for r in substring_dedup.without_passages(_documents(spark, rows), removed="gone").collect()}
    assert len(out) == 60
    texts = dict(rows)
    for i in range(41):
        assert out[i].text == texts[i] and out[i].gone == ""
    for i, before, after in planted[1:]:
        text = out[i].text
        assert text.startswith(before.rsplit(" ", 1)[0]) and text.endswith(after.split(" ", 1)[1])
        assert len(text.split()) <= 100 + 40
        start, end = map(int, out[i].gone.split(",")[0].split(":"))
        assert texts[i][start:end].strip() in passage
    assert not brute.repeated_words([(i, r.text) for i, r in out.items()], 50)


def test_passage_edges(spark):
    draw = random.Random(6)
    copy = " ".join(_words(draw, 70))
    rows = [(1, copy), (1, copy), (2, copy), (None, copy), (3, None), (4, ""), (5, "é " + copy + "\n"), (6, "a " * 60_000)]
    out = substring_dedup.without_passages(_documents(spark, rows)).collect()
    assert len(out) == len(rows) and out[0].component_id == "x"
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r.text)
    assert by_id[1] == [copy, copy] and by_id[None] == [copy] and by_id[3] == [None] and by_id[4] == [""]
    assert by_id[2] == [""] and len(by_id[5][0].split()) < 15
    assert substring_dedup.without_passages(_documents(spark, [])).count() == 0


def test_passages_on_documents(spark, sf_dir):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op7_content_defined_chunks"](spark, sf_dir).collect()
    assert len(rows) == len(before)
    for r in rows:
        text, done, parts = before[r.doc_id], 0, []
        for span in filter(None, r.removed.split(",")):
            start, end = map(int, span.split(":"))
            parts.append(text[done:start])
            done = end
        assert "".join([*parts, text[done:]]) == r.text
    left = brute.repeated_words([(r.doc_id, r.text) for r in rows], 50)
    assert all(len(set(g)) < 5 for g in left)  # one word over and over has no chunk borders


# Fingerprints


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        after = [0]
        for j, y in enumerate(b):
            after.append(row[j] + 1 if x == y else max(row[j + 1], after[-1]))
        row = after
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", max_size=40), st.text("abcd", max_size=40))
def test_common_length(a, b):
    assert ctph.common_length(a, b) == _lcs(a, b)


def test_likeness():
    draw = random.Random(7)
    words = _words(draw, 500)
    text = " ".join(words)
    changed = " ".join([*words[:100], "new", "words", *words[100:]])
    other = " ".join(_words(draw, 500))
    mark = ctph.fingerprint(text)
    assert ctph.likeness(mark, mark) == 1.0
    assert ctph.likeness(mark, ctph.fingerprint(changed)) > 0.9
    assert ctph.likeness(mark, ctph.fingerprint(other)) < 0.2
    assert ctph.likeness(mark, ctph.fingerprint(text[: len(text) // 2])) > 0.5  # half the size: neighbouring block sizes
    assert ctph.fingerprint(None) == ctph.fingerprint("") == "0::"
    assert 0 <= ctph.likeness("0::", mark) <= 1


def _check_neighbours(rows, found):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = Counter()
    for i, (name, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        marks = [ctph.fingerprint(t) for t in (text, edited, following)]
        near = [round(ctph.likeness(marks[0], m), 9) for m in marks[1:]]
        expected[(name, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], *near)] += 1
    got = Counter(
        (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
        for r in found
    )
    assert got == expected


def test_neighbours_on_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    _check_neighbours(rows, QUERIES["op8_piecewise_hashing"](spark, sf_dir).collect())


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_neighbour_edges(spark, ranges):
    rows = [(5, "five"), (None, "none"), (1, None), (2, ""), (2, "two"), (2, "two"), (9, "né" * 30_000), (7, "seven " * 30)]
    _check_neighbours(rows, ctph.compare_with_next(_documents(spark, rows), ranges).collect())
    _check_neighbours(rows[:1], ctph.compare_with_next(_documents(spark, rows[:1]), ranges).collect())
    assert ctph.compare_with_next(_documents(spark, []), ranges).count() == 0


# Shards


def _check_shards(rows, shards, largest):
    slots, sizes = {}, Counter()
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
    for shard, found in slots.items():
        assert 0 <= shard < shards and sorted(found) == list(range(len(found)))
    if sizes:
        assert max(sizes[s] for s in range(shards)) - min(sizes[s] for s in range(shards)) <= 2 * largest


def test_shards_on_documents(spark, sf_dir):
    import zlib

    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r.asDict() for r in QUERIES["op10_sampled_splitters"](spark, sf_dir).collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None)
    _check_shards(rows, 16, max(map(len, texts.values())) + 1)


def test_full_ranges_are_divided(spark):
    """A third of all records with one key, and ranges of at most 40 records."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), (F.col("id") % 11).alias("n"))
    rows = [r.asDict() for r in sharding.shard_by_bytes(df, [F.col("doc_id")], F.col("n"), 16, most_records=40).collect()]
    assert len(rows) == 3000
    _check_shards(rows, 16, 11)
    order = sorted((r["shard"], r["slot"], r["doc_id"]) for r in rows)
    assert [x[2] for x in order] == sorted(x[2] for x in order)


def test_shard_edges(spark):
    df = spark.createDataFrame([(None, None), (1, None), (1, None), (2, None)], "doc_id long, n long")
    rows = [r.asDict() for r in sharding.shard_by_bytes(df, [F.col("doc_id")], F.col("n"), 2).collect()]
    assert sorted(r["shard"] for r in rows) == [0, 0, 1, 1]
    _check_shards(rows, 2, 0)
    assert sharding.shard_by_bytes(df.limit(0), [F.col("doc_id")], F.col("n")).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("doc_id"))
    sharded = sharding.shard_by_bytes(df, [F.col("doc_id")], F.lit(10), 4)
    sharding.write_shards(sharded, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "shard=3")).count() == 25
