"""Near-duplicate groups by b-bit MinHash.

One pass over the texts makes shingle sets, their digests and MinHash minima. Bands of minima name the buckets in which
candidates meet; of the minima only the low ``BITS`` bits are kept, packed into a few long numbers, and the similarity
of a candidate pair is estimated from the count of equal groups of bits, corrected for chance agreement. Pairs whose
estimate lies more than ``MARGIN`` deviations under the threshold go; all others are confirmed on their full sets.

Groups of any size, in steps that need no pairs of a group:

1. Texts with equal sets are one class, represented by its smallest id.
2. In each bucket every class is compared with the bucket's smallest id, one pair per member. Confirmed links give
   first components.
3. Buckets with other members in different components are the rest. They are compared pair by pair inside tasks, a
   large bucket in blocks, with pairs of one component left out; only links found are returned.

So every pair that meets in a bucket is compared or is connected already, and no bucket is capped. Bands make it
improbable (under one in ten million at the threshold, by the defaults) that similar texts never meet.

Texts without words are linked with nothing. Rows without an id are returned without a component and kept. Repeated
ids are one document, linked by any of its texts. Nulls are read as empty texts; other columns are ignored.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.llm.common import map_rows, ship, stage_table
from forewarn.llm.components import connected_components
from forewarn.llm.prefilter import likely_in
from forewarn.llm.shingles import mixed, shingle_set

SHINGLE = 5
THRESHOLD = 80  # percent
HASHES = 128
ROWS = 4
BITS = 2
MARGIN = 6.0
#: Most members, and about as many shingles, on one side of a block comparison.
BLOCK = 1024
BLOCK_SHINGLES = 2_000_000
_LONGS = HASHES * BITS // 64
_LOW = 0x5555555555555555

_rng = np.random.Generator(np.random.PCG64(20))
_MULTIPLY = _rng.integers(0, 2**64, HASHES, np.uint64, endpoint=False) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, HASHES, np.uint64, endpoint=False)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each of ``HASHES`` hash functions over a set, 32 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048, None] * _MULTIPLY + _ADD
        np.minimum(least, part.min(axis=0), out=least)
    return least >> np.uint64(32)


def packed_bits(least: np.ndarray) -> list[int]:
    """The low bits of the minima in signed 64-bit numbers."""
    low = (least & np.uint64((1 << BITS) - 1)).reshape(_LONGS, -1)
    shifts = np.arange(low.shape[1], dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64).tolist()


def band_keys(least: np.ndarray) -> list[int]:
    """One 64-bit key for each band of ``ROWS`` minima."""
    bands = least.reshape(-1, ROWS)
    keys = np.arange(len(bands), dtype=np.uint64)
    for i in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return keys.view(np.int64).tolist()


def least_matches(threshold: float) -> int:
    """Equal groups of bits from which a pair is confirmed on its sets."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    deviation = (p * (1 - p) / HASHES) ** 0.5
    return max(0, int(np.floor((p - MARGIN * deviation) * HASHES)))


def estimated_similarity(matches: Column | float) -> Column | float:
    """Similarity from the number of equal groups, corrected for those equal by chance."""
    chance = 2.0**-BITS
    return (matches / HASHES - chance) / (1 - chance)


def matches(left: str, right: str) -> Column:
    """Number of equal groups of bits in two packed signatures (columns with an array of longs)."""
    total = F.lit(HASHES)
    for i in range(_LONGS):
        x = F.col(left)[i].bitwiseXOR(F.col(right)[i])
        differs = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW))
        total = total - F.bit_count(differs)
    return total


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(texts: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """The key, n_shingles, digest of the set, packed bits and band keys of each text."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for name, content in incoming:
            shingles = shingle_set(content, shingle)
            if not len(shingles):
                yield name, 0, None, None, None
                continue
            least = minima(shingles)
            digest = xxhash.xxh3_128_digest(shingles.tobytes())
            yield name, len(shingles), digest, packed_bits(least), band_keys(least)

    schema = f"{key} long, n_shingles long, digest binary, bits array<long>, bands array<long>"
    return map_rows(texts.select(key, text), rows, schema)


def near_duplicate_groups(
    texts: DataFrame, shingle: int = SHINGLE, percent: int = THRESHOLD, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per text: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept."""
    # Every row gets a number: ids can be repeated, with the same text or with others. Rows without an id, which are
    # linked with nothing, get a negative one.
    given = texts.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    number = F.monotonically_increasing_id()
    given = given.withColumn("row", number).withColumn("row", F.expr("CASE WHEN id IS NULL THEN -1 - row ELSE row END"))
    given = stage_table(given, "near-texts")
    ids = given.select("row", "id")
    signed = stage_table(signatures(given, shingle, "row", "text"), "near-signatures")
    known = signed.where("n_shingles > 0 AND row >= 0")
    classes = known.groupBy("digest").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stage_table(classes.where("n > 1").select("digest", "rep"), "near-classes")
    named = known.join(classes, "digest", "left")
    # One node for each distinct set, whatever rows have it; inside, its row's number is its id.
    alone = F.col("rep").isNull() | (F.col("rep") == F.col("row"))
    nodes = named.where(alone).select(F.col("row").alias("doc_id"), "n_shingles", "bits", "bands")
    nodes = stage_table(nodes, "near-nodes")

    content = given.select(F.col("row").alias("doc_id"), "text")
    members = nodes.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top"))
    buckets = stage_table(buckets.where("hub < top").select("bucket", "hub"), "near-buckets")
    members = likely_in(members, "bucket", buckets.select("bucket"))
    least = least_matches(percent / 100)
    links = stage_table(_hub_links(nodes, members, buckets, content, shingle, percent, least), "near-links")
    first = stage_table(connected_components(links), "near-components")
    more = _rest_links(nodes, members, buckets, first, content, shingle, percent, least)
    if more is not None:
        links = links.unionByName(more)
    copies = named.where("rep <> row").select(F.col("rep").alias("a"), F.col("row").alias("b"))
    spoken = known.select("row").join(ids, "row")
    firsts = spoken.groupBy("id").agg(F.min("row").alias("a"), F.max("row").alias("z")).where("a < z").select("id", "a")
    same_id = spoken.join(stage_table(firsts, "near-repeated-ids"), "id").where("row <> a")
    same_id = same_id.select("a", F.col("row").alias("b"))
    components = stage_table(connected_components(links.unionByName(copies).unionByName(same_id)), "near-groups")
    # Groups of rows become groups of ids: each is named by its least one.
    placed = components.join(ids, components["node"] == ids["row"]).select("row", "component", "id")
    least_ids = placed.groupBy("component").agg(F.min("id").alias("least"))
    grouped = placed.join(least_ids, "component").select("row", "least")
    found = ids.join(signed.select("row", "n_shingles"), "row").join(grouped, "row", "left")
    component = F.coalesce("least", "id")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        (F.col("id").isNull() | (component == F.col("id"))).alias("kept"),
    )


def _hub_links(nodes, members, buckets, content, shingle, percent, least) -> DataFrame:
    """Confirmed links (a, b) of members with the smallest id of a bucket."""
    pairs = members.join(buckets, "bucket").where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    pairs = pairs.distinct()
    signs = nodes.select("doc_id", "bits")
    likely = (
        pairs.join(signs.select(F.col("doc_id").alias("a"), F.col("bits").alias("bits_a")), "a")
        .join(signs.select(F.col("doc_id").alias("b"), F.col("bits").alias("bits_b")), "b")
        .where(matches("bits_a", "bits_b") >= least)
        .select("a", "b")
    )
    likely = stage_table(likely, "near-pairs")
    left = content.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = content.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    left, right = likely_in(left, "a", likely.select("a")), likely_in(right, "b", likely.select("b"))
    texts = likely.join(left, "a").join(right, "b")

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        held, set_held = None, None
        for a, b, text_a, text_b in incoming:
            if text_a != held or set_held is None:
                held, set_held = text_a, shingle_set(text_a, shingle)
            if _linked(set_held, shingle_set(text_b, shingle), percent):
                yield a, b

    return map_rows(texts.select("a", "b", "text_a", "text_b"), rows, "a long, b long").distinct()


def _rest_links(nodes, members, buckets, first, content, shingle, percent, least) -> DataFrame | None:
    """Links between members of a bucket that aren't its hub and aren't connected yet; None if there are no such members."""
    names = first.withColumnRenamed("node", "doc_id")
    placed = (
        members.join(buckets, "bucket")
        .where("doc_id <> hub")
        .join(names, "doc_id", "left")
        .join(nodes.select("doc_id", "n_shingles"), "doc_id")
        .select("bucket", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    )
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    mixed_buckets = placed.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), blocks.alias("blocks")
    )
    mixed_buckets = stage_table(mixed_buckets.where("low < high").select("bucket", "blocks"), "near-mixed")
    if mixed_buckets.isEmpty():
        return None
    # Large buckets are dealt into blocks; a member goes to one group with each block, so that all blocks meet.
    signs = nodes.select("doc_id", "bits", "bands")
    dealt = placed.join(mixed_buckets, "bucket").join(signs, "doc_id")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = dealt.select(
        F.col("bucket").alias("bucket"),
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "own", "doc_id", "component", "bits", "bands",
    )
    keys = ["bucket", "i", "j"]
    kind = "bucket long, i int, j int, own int, doc_id long, component long"
    likely = stage_table(_by_group(grouped, keys, _likely_members(least), kind), "near-likely")
    texts = likely_in(content, "doc_id", likely.select("doc_id"))
    full = likely.join(texts, "doc_id").join(signs, "doc_id")
    full = full.select(*keys, "own", "doc_id", "component", "bits", "bands", "text")
    return _by_group(full, keys, _confirmed(shingle, percent, least), "a long, b long").distinct()


def _by_group(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(function, schema)


def _pairs_of(table: pa.Table, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a group the later rows it is to be compared with here.

    Those of the other block (or of the same one, if the group has one), of another component, whose first common
    band is this bucket, and whose bits agree often enough.
    """
    bucket, i, j = (table.column(c)[0].as_py() for c in ("bucket", "i", "j"))
    own = table.column("own").to_numpy()
    component = table.column("component").to_numpy()
    n = len(own)
    bits = table.column("bits").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1)
    bands = table.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    here = int(np.flatnonzero(bands[0] == bucket)[0])
    for x in range(n - 1):
        y = np.arange(x + 1, n)
        y = y[component[y] != component[x]]
        if i != j:
            y = y[own[y] != own[x]]
        if len(y):
            y = y[~(bands[y, :here] == bands[x, :here]).any(axis=1)]
        if len(y):
            d = bits[y] ^ bits[x]
            differs = (d | (d >> np.uint64(1))) & np.uint64(_LOW)
            y = y[HASHES - np.bitwise_count(differs).sum(axis=1) >= least]
        if len(y):
            yield x, y


def _likely_members(least: int):
    def likely(table: pa.Table) -> pa.Table:
        hit = np.zeros(table.num_rows, bool)
        for x, y in _pairs_of(table, least):
            hit[x] = True
            hit[y] = True
        return table.select(["bucket", "i", "j", "own", "doc_id", "component"]).filter(pa.array(hit))

    return likely


def _confirmed(shingle: int, percent: int, least: int):
    def confirmed(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        sets = [shingle_set(t, shingle) for t in table.column("text").to_pylist()]
        root = {int(c): int(c) for c in table.column("component").to_numpy()}
        component = table.column("component").to_numpy()

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        links = []
        for x, partners in _pairs_of(table, least):
            for y in partners:
                a, b = find(int(component[x])), find(int(component[y]))
                if a != b and _linked(sets[x], sets[y], percent):  # pairs connected meanwhile need no link
                    root[max(a, b)] = min(a, b)
                    links.append((int(ids[x]), int(ids[y])))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return confirmed
