"""Merkle manifest, spelling variants and source mixes against brute force, and their edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from forewarn.llm import merkle, mixing, spelling
from forewarn.llm.ranking import ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    doc_id, text, lang, source, n_chars = row
    return sha("".join(map(field, (doc_id, source, lang, None if n_chars is None else n_chars + more, text))))


def tree_of(digests):
    """The top and, for each digest, its siblings with their side (1: the sibling is left of it)."""
    paths, places, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for path, k in zip(paths, range(len(digests))):
            other = places[k] ^ 1
            path.append((level[other] if other < len(level) else "", places[k] & 1))
            places[k] //= 2
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def brute_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    if not trees:
        return []
    names = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = [tree_of([m[2] for m in sorted(trees[name], key=lambda m: m[:3])]) for name in names]
    root, ways = tree_of([top for top, _ in built])
    out = []
    for name, (top, paths), way in zip(names, built, ways):
        for (_, _, leaf, row), path in zip(sorted(trees[name], key=lambda m: m[:3]), paths):
            chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            now = leaf_of(row, 1) if chosen else leaf
            for sibling, left in path + way:
                now = sha(sibling + now if left else now + sibling)
            proof = sha("".join(sibling for sibling, _ in path + way))
            out.append((row[0], leaf, top, root, proof, now, now == root))
    return out


def as_set(rows):
    return sorted(tuple(str(v) for v in row) for row in rows)


MANY = [(i * 3 % 1009, f"text {i}", ["en", "fr", "Ä", None][i % 7 % 4], "s", i) for i in range(300)]
AWKWARD = [
    (None, None, None, None, None),
    (None, "a", None, "s", 1),
    (5, "", "", "", 0),
    (5, "", "", "", 0),
    (5, "", "", "", 0),
    (7, "x" * 300_000, "en", None, 300_000),
    (-7, "é\n:-", "-", "-", None),
    (14, "t", "=", "s", 3),
]


@pytest.mark.parametrize("rows", [MANY, AWKWARD, AWKWARD[:1], []])
def test_manifest_is_the_brute_force_one(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit(1)).withColumn("member", F.lit("x"))
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert as_set(got) == as_set(brute_manifest(rows))


@pytest.mark.parametrize("stride", [1, 5])
def test_levels_stored_do_not_matter(spark, stride):
    rows = MANY[:77]
    docs = spark.createDataFrame(rows, DOCS)
    assert as_set(merkle.manifest(docs, stride=stride).collect()) == as_set(brute_manifest(rows))


def test_untouched_leaves_are_verified_and_any_tampering_is_not(spark):
    docs = spark.createDataFrame(MANY, DOCS)

    def other_text(fields):
        return fields | {"text": F.when(F.col("doc_id") == 30, "other").otherwise(F.col("text"))}

    got = {r["doc_id"]: r["verified"] for r in merkle.manifest(docs, other_text).collect()}
    assert not got[30] and sum(got.values()) == len(got) - 1


def test_recursion_bound_is_set_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.manifest(spark.createDataFrame(MANY[:5], DOCS))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_ranked_places_ties_without_gaps(spark):
    rows = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") % 2).alias("k"))
    got = ranked(rows, "g", ["k"], "t").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(5000))
    assert [r["k"] for r in got] == [0] * 2500 + [1] * 2500 and {r["total"] for r in got} == {5000}


def brute_variants(rows):
    counts = {}
    for doc_id, text in rows:
        for run in spelling.RUN.findall((text or "").translate({c: c + 32 for c in range(65, 91)})):
            drawn = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drawn % 97 == 0:
                run = run[: drawn % len(run)] + run[drawn % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if n >= 3}
    letters = {c for w in words for c in w}
    form, near = {}, {}
    for w in words:
        cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in letters}
        edits |= {a + c + b[1:] for a, b in cut if b for c in letters}
        near[w] = {v for v in edits if v in words and v != w}
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def variants(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    return [tuple(r) for r in spelling.group_variants(docs).collect()]


def test_variants_are_the_brute_force_ones(spark):
    base = ["colour", "color", "colours", "cölour", "aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "ÿÿÿÿÿ", "ÿÿÿÿé", "×÷×÷×", "Straße"]
    rows = []
    for i, word in enumerate(base):
        rows += [(i * 100 + j, f"{word} {word.upper()},{word}-{base[(i + j) % len(base)]}1") for j in range(2 * i + 1)]
    rows += [(None, "colour colour colour"), (None, None), (3, ""), (4, "!!! 12 ab"), (4, "!!! 12 ab")]
    got = variants(spark, rows)
    assert as_set(got) == as_set(brute_variants(rows))
    assert any(row[1] for row in got)


def test_variants_of_crowded_short_words(spark):
    """All words over three letters: every bucket is full, chains of forms are long."""
    import itertools

    rows = [(7, " ".join([w] * (3 + (hash_of(w) % 40)))) for w in map("".join, itertools.product("abc", repeat=5))]
    assert as_set(variants(spark, rows)) == as_set(brute_variants(rows))


def hash_of(word):
    return zlib.crc32(word.encode())


def test_long_chains_end_at_their_root(spark):
    chain = ["aaaaa" + "b" * i for i in range(8)]
    rows = [(i, " ".join([word] * (3 * 2**i))) for i, word in enumerate(chain)]
    got = {row[0]: row[2] for row in variants(spark, rows)}
    assert got == {row[0]: row[2] for row in brute_variants(rows)}


def test_very_long_text_is_scanned_in_pieces(spark, monkeypatch):
    assert "".join(spelling._pieces("Ab " * 700_000)) == "ab " * 700_000
    assert len(list(spelling._pieces("a" * 3_000_000))) == 1
    rows = [(1, "straight strait " * 200_000)]
    assert as_set(variants(spark, rows)) == as_set(brute_variants(rows))


def test_empty_vocabulary(spark):
    assert variants(spark, []) == [] and variants(spark, [(1, None), (2, "one two")]) == []


MIX = "doc_id long, text string, source string"


def decided(spark, rows, **options):
    docs = spark.createDataFrame(rows, MIX).withColumn("rate", F.lit(1)).withColumn("nth", F.lit(1))
    sized = mixing.sizes(docs, mixing.word_count(F.col("text")))
    return mixing.decisions(sized, mixing.targets(sized, **options)).collect()


def brute_targets(size_of, weights, most):
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    total, bound = sum(size_of.values()), set()
    while True:
        rest = total - sum(most * size_of[n] for n in bound)
        free = sum(weight[n] for n in names if n not in bound)
        target = {n: most * size_of[n] if n in bound else weight[n] * rest / free for n in names}
        above = {n for n in names if n not in bound and target[n] > most * size_of[n]}
        if not above:
            return target
        bound |= above


@pytest.mark.parametrize("seed", range(3))
def test_targets_share_what_sources_cannot_take(spark, seed):
    import random

    draw = random.Random(seed)
    size_of = {f"s{i}": draw.choice([0, 1, 5, 40, 900]) for i in range(9)} | {None: 30, "": 7}
    rows = [(i, "w " * n, name) for i, (name, n) in enumerate(size_of.items())]
    docs = spark.createDataFrame(rows, MIX)
    got = {r["source"]: r["target"] for r in mixing.targets(mixing.sizes(docs, mixing.word_count(F.col("text")))).collect()}
    want = brute_targets(size_of, (5, 2, 1), 3)
    assert set(got) == set(want) and all(got[n] == pytest.approx(want[n], rel=1e-12) for n in want)
    assert sum(got.values()) == pytest.approx(sum(size_of.values()))


def test_taken_words_come_near_their_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i % 13), f"s{i % 11 % 4}") for i in range(20_000)]
    first = decided(spark, rows)
    taken, target = {}, {}
    for r in first:
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 2 * 13 for s in target)
    assert as_set(first) == as_set(decided(spark, rows[::-1]))


def test_copies_of_one_row_are_decided_each_for_itself(spark):
    rows = [(1, "a b", "x")] * 3000 + [(2, "a", "y")] * 3000
    got = decided(spark, rows)
    assert len(got) == 6000
    for source in "xy":
        of = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 2


def test_each_document_is_drawn_with_the_chance_of_its_fraction(spark):
    """Over many sources of the same shape, seeded each by its own name, every place is taken equally often."""
    rows = [(s * 100 + i, "w " * (i + 1), f"s{s:03d}") for s in range(300) for i in range(10)]
    got = decided(spark, rows, weights=(1, 2))
    for odd in (0, 1):
        of = [r for r in got if int(r["source"][1:]) % 2 == odd]
        rate = of[0]["target"] / of[0]["source_size"]
        for size in (1, 5, 10):
            mean = sum(r["copies"] for r in of if r["size"] == size) / 150
            assert abs(mean - rate) < 0.17


def test_mix_of_nothing(spark):
    assert decided(spark, []) == []
    got = decided(spark, [(1, None, None), (None, "", "a"), (None, " \t\n", "a")])
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 3


def test_word_count_splits_at_the_six_spaces_only(spark):
    rows = spark.createDataFrame([(" a\tb\nc\x0bd\x0ce\rf g h ",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(mixing.word_count(F.col("t"))).collect()] == [7, 0, 0]


def test_documents_are_emitted_as_often_as_decided(spark):
    rows = [(i, "w " * (i % 7), ["a", "b", None][i % 5 % 3]) for i in range(400)] + [(3, "w w w", "a")] * 50
    docs = spark.createDataFrame(rows, MIX).withColumn("a.b", F.lit(1)).withColumn("copies", F.col("doc_id"))
    out = mixing.mixed(docs, mixing.word_count(F.col("text")))
    assert out.columns == docs.columns
    emitted = {}
    for r in out.collect():
        assert r["a.b"] == 1 and r["copies"] == r["doc_id"]
        emitted[r["doc_id"]] = emitted.get(r["doc_id"], 0) + 1
    wanted = {}
    for r in decided(spark, rows):
        wanted[r["doc_id"]] = wanted.get(r["doc_id"], 0) + r["copies"]
    assert emitted == {d: n for d, n in wanted.items() if n}
