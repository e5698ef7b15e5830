"""Exact top-k by inner product, with the kth score of every query located by refined histograms.

Vectors are packed into blocks of queries and blocks of candidates, and every pair of blocks is scored by one matrix
product in a task. The first pass counts the scores of each query in equal bins between the least and the greatest
score that the lengths of the vectors allow; counts are added over all tasks, and the bin that holds the kth score is
divided again, until bins are one integer wide. A last pass scores everything once more and keeps the scores from the
kth value on: those above it are fewer than k, and of those equal to it a task keeps the k with the smallest ids, which
are enough to break ties between tasks.

No task or table holds more than a block of scores. Histograms are as large as the queries need: at most ``BINS`` rows
for each query and task in a pass, added up by Spark.

Defined results: a vector that is null, or holds a null or a component that is not finite, takes no part, nor does one
without an id. Missing trailing components count as 0. Rows with the query's id are never its candidates, so repeated
rows don't find themselves; a repeated query row gives its rows once for each repetition. Fewer than k candidates are
all returned. Other columns of the input are ignored.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forewarn.llm.common import map_rows, stage_table

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
BINS = 256
SCALE = 256.0


def _whole(scale: float) -> Column:
    """Components as integers: floor(scale * x)."""
    return F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))


def integer_vectors(vectors: DataFrame, scale: float = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The usable rows as (vec_id, v array<bigint>)."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    largest = 1e300  # also keeps infinities out
    usable = F.forall("embedding", lambda x: F.coalesce((F.abs(x.cast("double")) < largest) & ~F.isnan(x), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable).select(
        "vec_id", _whole(scale).alias("v")
    )


def _blocks(vectors: DataFrame, rows_per_block: int, width: int, name: str) -> DataFrame:
    """Pack rows into (block, ids, matrix) with at most ``rows_per_block`` rows each."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        ids, parts = [], []

        def packed() -> tuple:
            matrix = np.zeros((len(parts), width), np.int64)
            for i, part in enumerate(parts):
                matrix[i, : len(part)] = part
            return np.asarray(ids, "<i8").tobytes(), matrix.astype("<i8").tobytes(), len(ids)

        for vec_id, v in incoming:
            ids.append(vec_id)
            parts.append(v)
            if len(ids) == rows_per_block:
                yield packed()
                ids, parts = [], []
        if ids:
            yield packed()

    blocks = map_rows(vectors, rows, "ids binary, matrix binary, n int")
    return stage_table(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), name)


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floating point only where every partial sum is exact in it."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if bound < 2.0**53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return queries @ candidates.T


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = SCALE,
) -> DataFrame:
    """For each query row its ``k`` best other rows: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on ``vec_id``. Scores must fit into 64 bits.
    """
    spark = vectors.sparkSession
    whole = stage_table(integer_vectors(vectors, scale), "topk-vectors")
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    shape = whole.agg(F.max(F.size("v")).alias("width"), F.max(size).alias("most")).first()
    width, longest = max(shape["width"] or 1, 1), float(shape["most"] or 0.0) ** 0.5
    candidates = _blocks(whole, CANDIDATE_BLOCK, width, "topk-candidates")
    queries = _blocks(whole.where(is_query), QUERY_BLOCK, width, "topk-queries")

    # The range a query's scores can have, from its own length and the longest of all.
    def first_range(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for block, ids, matrix, n in incoming:
            m = np.frombuffer(matrix, "<i8").reshape(n, width).astype(np.float64)
            bound = np.floor(np.sqrt((m * m).sum(axis=1)) * longest * (1 + 1e-9)) + 1
            for place, b in enumerate(bound):
                yield block, place, -int(b), max(1, -(-(2 * int(b) + 1) // BINS)), k

    state = map_rows(queries, first_range, "block long, place int, low long, step long, wanted long")
    while True:
        state = stage_table(state, "topk-state")
        counted = _histograms(candidates, queries, state, width)
        state = stage_table(_refined(state, counted), "topk-state")
        if state.where(F.col("step") > 0).isEmpty():
            break
    best = _kept(candidates, queries, state, width, k)
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _pairs(candidates: DataFrame, queries: DataFrame, state: DataFrame) -> DataFrame:
    """Every block of queries, with where its rows stand, next to every block of candidates."""
    where = state.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "low", "step"))).alias("state"))
    left = queries.select("block", "ids", "matrix", "n").join(where, "block")
    right = candidates.select(F.col("ids").alias("ids_c"), F.col("matrix").alias("matrix_c"), F.col("n").alias("n_c"))
    return right.crossJoin(left).select("block", "ids", "matrix", "n", "state", "ids_c", "matrix_c", "n_c")


def _open(row: tuple, width: int):
    block, ids, matrix, n, state, ids_c, matrix_c, n_c = row
    query_ids, candidate_ids = np.frombuffer(ids, "<i8"), np.frombuffer(ids_c, "<i8")
    q = np.frombuffer(matrix, "<i8").reshape(n, width)
    c = np.frombuffer(matrix_c, "<i8").reshape(n_c, width)
    low = np.array([s["low"] for s in state], np.int64)
    step = np.array([s["step"] for s in state], np.int64)
    return block, query_ids, candidate_ids, _scores(q, c), low, step, query_ids[:, None] != candidate_ids[None, :]


def _histograms(candidates: DataFrame, queries: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """Counts of scores by (query row, bin), and of those above all bins (bin ``BINS``)."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        held, counts = None, None

        def out() -> Iterator[tuple]:
            for place, bin_ in zip(*np.nonzero(counts)):
                yield held, int(place), int(bin_), int(counts[place, bin_])

        for row in incoming:
            block, query_ids, _, scores, low, step, other = _open(row, width)
            if held != block:
                if held is not None:
                    yield from out()
                held, counts = block, np.zeros((len(query_ids), BINS + 1), np.int64)
            # A query that is settled (step 0) asks nothing more.
            bins = np.minimum((scores - low[:, None]) // np.maximum(step, 1)[:, None], BINS)
            wanted = other & (bins >= 0) & (step > 0)[:, None]
            places = np.broadcast_to(np.arange(len(query_ids))[:, None], bins.shape)
            flat = places[wanted] * (BINS + 1) + bins[wanted]
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        if held is not None:
            yield from out()

    counted = map_rows(_pairs(candidates, queries, state), rows, "block long, place int, bin int, n long")
    return counted.groupBy("block", "place", "bin").agg(F.sum("n").alias("n"))


def _refined(state: DataFrame, counted: DataFrame) -> DataFrame:
    """Narrow each query to the bin that holds its kth score; ``step`` 0 with ``low`` = kth score ends it.

    The count of scores above the old range is in the last bin, so bins from the top down reach ``wanted``
    in the bin sought. If all scores together don't, every score is kept.
    """
    down = Window.partitionBy("block", "place").orderBy(F.desc("bin"))  # BINS + 1 rows at most
    sums = counted.withColumn("upto", F.sum("n").over(down))
    joined = sums.join(state.where(F.col("step") > 0), ["block", "place"])
    hit = joined.where(F.col("upto") >= F.col("wanted")).groupBy("block", "place").agg(F.max("bin").alias("hit"))
    found = state.join(hit, ["block", "place"], "left")
    low = F.col("low") + F.col("hit") * F.col("step")
    narrow = F.greatest(F.lit(1), F.ceil(F.col("step") / BINS)).cast("long")
    return found.select(
        "block",
        "place",
        F.when(F.col("step") == 0, F.col("low"))
        .when(F.col("hit").isNull(), F.lit(-(2**62)))
        .otherwise(low)
        .cast("long")
        .alias("low"),
        F.when(F.col("hit").isNull() | (F.col("step") <= 1), F.lit(0)).otherwise(narrow).cast("long").alias("step"),
        "wanted",
    )


def _kept(candidates: DataFrame, queries: DataFrame, state: DataFrame, width: int, k: int) -> DataFrame:
    """Scores from the kth value on; a task keeps its k best of each query, smaller ids first among equals."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for row in incoming:
            block, query_ids, candidate_ids, scores, low, _, other = _open(row, width)
            for place in np.flatnonzero((other & (scores >= low[:, None])).any(axis=1)):
                at = np.flatnonzero(other[place] & (scores[place] >= low[place]))
                at = at[np.lexsort((candidate_ids[at], -scores[place][at]))[:k]]
                for i in at:
                    yield block, int(place), int(query_ids[place]), int(candidate_ids[i]), int(scores[place, i])

    schema = "block long, place int, query_id long, vec_id long, score long"
    return map_rows(_pairs(candidates, queries, state), rows, schema)
