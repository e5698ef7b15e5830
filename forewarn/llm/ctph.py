"""Context-triggered piecewise hashing: fingerprints of texts that stay alike when a part is edited.

A rolling hash over the last ``WINDOW`` bytes triggers the end of a chunk where its low bits are zero; the number
of bits is the block size (a power of two), chosen so that a text has about ``CHUNKS`` chunks. Every chunk gives one
character of a signature. A fingerprint holds the block size and two signatures, at that block size and at twice it,
so that texts whose block sizes differ by one step can be compared. Likeness is one minus the edit distance (inserts
and deletes) over the length of both signatures, and 0 where no ``COMMON`` characters in a row agree.

Nulls are read as empty texts, whose fingerprint is "0::". Equal texts have equal fingerprints. Texts of any length
are read whole.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forewarn.llm.common import map_rows
from forewarn.llm.gear import rolling

WINDOW = 8
CHUNKS = 64
LEAST_BITS = 2
COMMON = 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def block_bits(n_bytes: int) -> int:
    return max(LEAST_BITS, (n_bytes // CHUNKS).bit_length())


def _signature(data: bytes, ends: list[int]) -> str:
    digest, signs, start = xxhash.xxh3_64_intdigest, [], 0
    for end in ends:
        signs.append(ALPHABET[digest(data[start:end]) & 63])
        start = end
    if start < len(data):
        signs.append(ALPHABET[digest(data[start:]) & 63])
    return "".join(signs)


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    if not data:
        return "0::"
    hashes = rolling(np.frombuffer(data, np.uint8), WINDOW)
    bits = block_bits(len(data)) + 1
    while True:  # repetitive texts trigger seldom and get smaller blocks
        bits -= 1
        ends = np.flatnonzero((hashes & np.uint64((1 << bits) - 1)) == 0)
        if bits == LEAST_BITS or len(ends) >= CHUNKS // 4:
            break
    wider = ends[(hashes[ends] & np.uint64(1 << bits)) == 0]
    return f"{bits}:{_signature(data, (ends + 1).tolist())}:{_signature(data, (wider + 1).tolist())}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one row of the table held in the bits of a number."""
    where: dict[str, int] = {}
    for i, sign in enumerate(a):
        where[sign] = where.get(sign, 0) | 1 << i
    everything = (1 << len(a)) - 1
    row = everything
    for sign in b:
        hit = row & where.get(sign, 0)
        row = (row + hit | row - hit) & everything
    return len(a) - row.bit_count()


def signature_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = min(COMMON, max(1, min(len(a), len(b)) // 2))
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 2.0 * common_length(a, b) / (len(a) + len(b))


def likeness(left: str, right: str) -> float:
    """Likeness of two fingerprints, from 0 to 1; 0 at block sizes that can't be compared."""
    if left == right:
        return 1.0
    bits_a, near_a, wide_a = left.split(":")
    bits_b, near_b, wide_b = right.split(":")
    step = int(bits_b) - int(bits_a)
    if step == 0:
        return max(signature_likeness(near_a, near_b), signature_likeness(wide_a, wide_b))
    if step == 1:
        return signature_likeness(wide_a, near_b)
    if step == -1:
        return signature_likeness(near_a, wide_b)
    return 0.0


def fingerprints(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: its key and ``fingerprint``."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for name, content in incoming:
            yield name, fingerprint(content)

    kind = dict(texts.dtypes)[key]
    return map_rows(texts.select(key, text), rows, f"`{key}` {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(texts: DataFrame, ranges: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ranges of texts in key order: (range, key, text, last), each range ended by a copy of what follows it.

    Rows with ``last`` are such copies: the first row of the next range that has any, or of the first range at the
    end. Texts with equal keys follow each other in the order of the texts; null keys come first.
    """
    rows = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = rows.agg(
        F.percentile_approx("key", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10 * ranges).alias("cuts")
    ).first()["cuts"] if ranges > 1 else None
    cuts = sorted(set(cuts or []))  # fewer than ``ranges`` numbers
    spread = F.lit(0)
    if cuts:
        spread = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("key")))
        spread = F.when(F.col("key").isNull(), 0).otherwise(spread)
    ranged = rows.withColumn("range", spread.cast("int"))
    # The first text of each range: by its key first, so that texts don't travel for it.
    least = F.min(F.struct(F.col("key").isNotNull().alias("known"), "key")).alias("least")
    first_keys = ranged.groupBy("range").agg(least).select("range", F.col("least.key").alias("first_key"))
    order = Window.orderBy("range")  # one row per range
    around = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = F.coalesce(F.lag("range").over(order), F.max("range").over(around)).alias("before")
    first_keys = F.broadcast(first_keys.select("range", "first_key", to))
    firsts = (
        ranged.join(first_keys, "range")
        .where(F.col("key").eqNullSafe(F.col("first_key")))
        .groupBy("before", "key")
        .agg(F.min("text").alias("text"))
        .select(F.col("before").alias("range"), "key", "text", F.lit(True).alias("last"))
    )
    return ranged.select("range", "key", "text", F.lit(False).alias("last")).unionByName(firsts)


def compare_with_next(texts: DataFrame, ranges: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text with its edited form (last half from the next text) and the next text.

    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Each range is
    ordered in a task and read once, two texts at a time.
    """
    kind = dict(texts.dtypes)[key]

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        held = None
        for range_, name, content, last in incoming:
            mark = fingerprint(content)
            if held is not None and held[0] == range_:
                _, before, own, own_mark = held
                changed = edited(own, content)
                changed_mark = own_mark if changed == own else fingerprint(changed)
                digest = hashlib.sha256(changed.encode()).hexdigest()
                near = likeness(own_mark, changed_mark), likeness(own_mark, mark)
                yield (before, len(own), digest, own_mark, changed_mark, *near)
            held = None if last else (range_, name, content, mark)

    dealt = with_following(texts, ranges, key, text).repartitionById(ranges, "range")
    ordered = dealt.sortWithinPartitions("range", "last", F.asc_nulls_first("key"), "text")
    schema = (
        f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return map_rows(ordered, rows, schema)
