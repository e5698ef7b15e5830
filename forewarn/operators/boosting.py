"""Gradient-boosted trees on histograms, many fits in each pass over the rows.

Features are cut at quantiles of a part's training rows. A pass over the binned rows adds first and second derivatives
of the logistic loss by (fit, node, feature, bin); the driver gets these sums, whose size depends on parameters alone,
and picks splits by gain with L2 on leaves and a least child weight. All fits that share rows (horizons, seeds) take
part in each pass, so a round of the whole grid costs as many passes as trees are deep.

Derivatives are added as whole multiples of 2^-24: sums don't depend on how rows are dealt to tasks, and neither do
trees. Margins are written with the rows every ``block`` rounds; between, tasks add the few trees grown since. The
average precision of the validation rows after every round of a block is computed when the block is done, and rounds
past the stop are discarded, so the result is that of a stop looked for after each round.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any, Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.functions.workers import lists, matrix, ship
from forewarn.operators.metrics import ranking_scores
from forewarn.sources.sinks import stage_table

_SCALE = float(1 << 24)
_LEAST_HESSIAN = 1e-16
# Partial histograms that one task adds up.
_FAN_IN = 64


@dataclass(frozen=True)
class BoostParameters:
    """Settings of the boosted trees (fixed values of the study's tree model; bins, block and rows are our own)."""

    max_rounds: int = 500
    step: float = 0.05
    max_depth: int = 3
    min_child_weight: float = 3.0
    subsample: float = 0.8
    feature_share: float = 0.8
    l2: float = 1.0
    patience: int = 30
    max_bins: int = 64
    block: int = 15
    rows_per_task: int = 200_000


@dataclass(frozen=True)
class Fit:
    """One model to fit: on which part's rows, to which of the labels, with which seed; ``rounds`` None may stop early."""

    part: str
    target: int
    seed: int
    rounds: int | None = None


@dataclass
class Tree:
    """A tree in heap order: node i has children 2i and 2i + 1, ``feature`` is -1 where nothing is split."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        size = 2 << depth
        whole, real = (lambda: np.full(size, -1, dtype=np.int32)), (lambda: np.zeros(size))
        return Tree(whole(), whole(), real(), np.zeros(size, dtype=bool), real(), real())

    def _descend(self, rows: int, levels: int, goes_left: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        at = np.ones(rows, dtype=np.int32)
        for _ in range(levels):
            split = np.flatnonzero(self.feature[at] >= 0)
            if split.size:
                node = at[split]
                at[split] = 2 * node + ~goes_left(split, node)
        return at

    def nodes(self, bins: np.ndarray, missing: int, levels: int) -> np.ndarray:
        """Where binned rows stand after so many levels."""

        def goes_left(rows: np.ndarray, node: np.ndarray) -> np.ndarray:
            own = bins[rows, self.feature[node]]
            return np.where(own == missing, self.missing_left[node], own <= self.bin[node])

        return self._descend(len(bins), levels, goes_left)

    def values(self, features: np.ndarray, levels: int) -> np.ndarray:
        """What the tree adds to the margins of rows with these feature values."""

        def goes_left(rows: np.ndarray, node: np.ndarray) -> np.ndarray:
            own = features[rows, self.feature[node]]
            return np.where(np.isnan(own), self.missing_left[node], own < self.threshold[node])

        return self.value[self._descend(len(features), levels, goes_left)]


@dataclass
class BoostedModel:
    """A fitted model; ``history`` has the validation rows' average precision after each round that was grown."""

    trees: list[Tree]
    depth: int
    width: int
    history: list[float] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return sum(1 + int((tree.feature >= 0).sum()) for tree in self.trees)

    def probability(self, features: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(features))
        for tree in self.trees:
            margin += tree.values(features, self.depth)
        return _sigmoid(margin)

    def importances(self) -> np.ndarray:
        """Average gain of the splits on each feature, as shares of their sum."""
        gain, used = np.zeros(self.width), np.zeros(self.width)
        for tree in self.trees:
            split = tree.feature >= 0
            np.add.at(gain, tree.feature[split], tree.gain[split])
            np.add.at(used, tree.feature[split], 1)
        mean = np.divide(gain, used, out=np.zeros(self.width), where=used > 0)
        return mean / mean.sum() if mean.sum() else mean

    def transform(self, df: DataFrame) -> DataFrame:
        """Attach ``probability`` as a vector of both classes' shares."""
        score = probabilities(df, [self])[0]
        return df.withColumn("probability", array_to_vector(F.array(1 - score, score)))


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


def feature_array(df: DataFrame, column: str = "features") -> Column:
    """A vector or array column as an array of doubles."""
    if isinstance(df.schema[column].dataType, VectorUDT):
        return vector_to_array(column)
    return F.col(column)


def probabilities(df: DataFrame, models: Sequence[Any]) -> Column:
    """An array column with each model's probability for the row's ``features``.

    A model has ``width`` and ``probability`` of a matrix of rows.
    """
    ship(df.sparkSession)
    width = models[0].width
    kept = list(models)

    @F.pandas_udf("array<double>")
    def score(features):
        import pandas as pd

        rows = np.array(features.tolist(), dtype=np.float64).reshape(len(features), width)
        columns = np.column_stack([model.probability(rows) for model in kept])
        return pd.Series(list(columns))

    return score(feature_array(df))


# Bins.


def cut_points(rows: DataFrame, width: int, max_bins: int) -> dict[str, list[np.ndarray]]:
    """Ascending cuts of each feature, from quantiles of each part's training rows.

    A value's bin is the number of cuts at or below it. The driver reads at most ``max_bins`` numbers a feature.
    """
    shares = [i / max_bins for i in range(max_bins)]
    known = [F.when(~F.isnan(F.col("features")[i]), F.col("features")[i]) for i in range(width)]
    wanted = [F.percentile_approx(value, shares, 100 * max_bins).alias(f"q{i}") for i, value in enumerate(known)]
    found = rows.where(~F.col("is_validation")).groupBy("part").agg(*wanted).collect()
    # The least value needs no cut below it.
    return {r["part"]: [np.unique(np.array(r[f"q{i}"] or [], dtype=np.float64))[1:] for i in range(width)] for r in found}


def _binned(features: np.ndarray, cuts: list[np.ndarray], missing: int) -> np.ndarray:
    out = np.empty(features.shape, dtype=np.uint8)
    for i, cut in enumerate(cuts):
        own = features[:, i]
        out[:, i] = np.where(np.isnan(own), missing, np.searchsorted(cut, own, side="right"))
    return out


# Passes over the rows.


@dataclass(frozen=True)
class _Job:
    """What a task needs to know of one fit: its place among its part's margins, its trees since the last block."""

    number: int
    fit: Fit
    place: int
    scale: float
    recent: tuple[Tree, ...]
    tree: Tree | None = None
    round: int = 0
    columns: tuple[int, ...] = ()


def _uniform(keys: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """A number from 0 to 1 for each row, the same wherever the row is read (splitmix64)."""
    mixed = keys.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + round_ * 0xD1B54A32D192ED03) & (2**64 - 1))
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


class _Rows:
    """Columns of one part's rows in an Arrow batch."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.bins = np.frombuffer(b"".join(batch["bins"].to_pylist()), dtype=np.uint8).reshape(batch.num_rows, width)
        self.labels = matrix(batch["labels"], len(batch["labels"][0]))
        self.margins = matrix(batch["margins"], len(batch["margins"][0]))
        self.validation = batch["is_validation"].to_numpy(zero_copy_only=False)
        self.keys = batch["key"].to_numpy()

    def margin(self, job: _Job, missing: int, depth: int, after: int | None = None) -> np.ndarray:
        margin = self.margins[:, job.place]
        for tree in job.recent[:after]:
            margin = margin + tree.value[tree.nodes(self.bins, missing, depth)]
        return margin


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    for part in batch["part"].unique().to_pylist():
        yield part, batch.filter(pc.equal(batch["part"], part))


def _histograms(
    rows: DataFrame, jobs: Sequence[_Job], level: int, p: BoostParameters, width: int, tasks: int
) -> dict[tuple[int, int], np.ndarray]:
    """Sums of derivatives as (feature, bin, 2) for each fit and each node of a level that can still be split."""
    size = p.max_bins + 1
    by_part: dict[str, list[_Job]] = {}
    for job in jobs:
        by_part.setdefault(job.fit.part, []).append(job)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, own in _parts(batch):
                held = _Rows(own, width)
                for job in by_part.get(part, ()):
                    _add_derivatives(sums, held, job, level, p, size)
        keys = sorted(sums)
        if keys:
            yield pa.record_batch(
                [
                    pa.array([k[0] for k in keys], pa.int32()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([sums[k].tobytes() for k in keys], pa.binary()),
                ],
                names=["fit", "node", "sums"],
            )

    def total(table: pa.Table) -> pa.Table:
        added = sum(np.frombuffer(one, dtype=np.int64) for one in table["sums"].to_pylist())
        return table.slice(0, 1).set_column(
            table.schema.get_field_index("sums"), "sums", pa.array([added.tobytes()], pa.binary())
        )

    schema = "fit int, node int, sums binary"
    partial = rows.mapInArrow(add, schema)
    if tasks > _FAN_IN:
        slot = F.pmod(F.spark_partition_id(), F.lit(-(-tasks // _FAN_IN)))
        slotted = partial.withColumn("slot", slot).groupBy("fit", "node", "slot")
        partial = slotted.applyInArrow(total, f"{schema}, slot int").drop("slot")
    if tasks > 1:
        partial = partial.groupBy("fit", "node").applyInArrow(total, schema)
    found: dict[tuple[int, int], np.ndarray] = {}
    for r in partial.collect():
        key = r["fit"], r["node"]
        found[key] = found.get(key, 0) + np.frombuffer(bytes(r["sums"]), dtype=np.int64)
    return {key: sums.reshape(width, size, 2) / _SCALE for key, sums in found.items()}


def _add_derivatives(sums: dict, rows: _Rows, job: _Job, level: int, p: BoostParameters, size: int) -> None:
    taken = ~rows.validation & (_uniform(rows.keys, job.fit.seed, job.round) < p.subsample)
    node = job.tree.nodes(rows.bins, p.max_bins, level)
    taken &= node >= 1 << level
    if not taken.any():
        return
    label = rows.labels[taken, job.fit.target]
    chance = _sigmoid(rows.margin(job, p.max_bins, p.max_depth)[taken])
    weight = np.where(label == 1, job.scale, 1.0) * _SCALE
    first = np.rint(weight * (chance - label))
    second = np.rint(weight * np.maximum(chance * (1 - chance), _LEAST_HESSIAN))
    node, bins = node[taken] - (1 << level), rows.bins[taken]
    nodes = 1 << level
    known = np.unique(node).tolist()
    for i in known:
        if (job.number, i + nodes) not in sums:
            sums[job.number, i + nodes] = np.zeros((rows.bins.shape[1], size, 2), dtype=np.int64)
    for column in job.columns:
        at = node * size + bins[:, column]
        for kind, values in enumerate((first, second)):
            counted = np.bincount(at, weights=values, minlength=nodes * size).astype(np.int64).reshape(nodes, size)
            for i in known:
                sums[job.number, i + nodes][column, :, kind] += counted[i]


def best_split(sums: np.ndarray, columns: Sequence[int], p: BoostParameters) -> tuple | None:
    """(gain, feature, bin, missing goes left, left sums, right sums) of the best split of a node.

    ``sums`` is (feature, bin, 2), the last bin for missing values. Ties go to the first feature, the lower bin, and
    to missing values on the right.
    """
    total = sums[columns[0]].sum(axis=0)
    whole = total[0] ** 2 / (total[1] + p.l2)
    best = None
    for column in columns:
        left = np.cumsum(sums[column, :-1], axis=0)[:-1]
        for missing_left in (False, True):
            low = left + sums[column, -1] if missing_left else left
            high = total - low
            fits = (low[:, 1] >= p.min_child_weight) & (high[:, 1] >= p.min_child_weight)
            gains = low[:, 0] ** 2 / (low[:, 1] + p.l2) + high[:, 0] ** 2 / (high[:, 1] + p.l2) - whole
            gains = np.where(fits, gains, -np.inf)
            at = int(np.argmax(gains))
            if gains[at] > max(1e-9, best[0] if best else 0.0):
                best = (float(gains[at]), column, at, missing_left, low[at], high[at])
    return best


def _grow(tree: Tree, node: int, sums: np.ndarray, job: _Job, cuts: list[np.ndarray], p: BoostParameters) -> None:
    def leaf(of: np.ndarray) -> float:
        return float(-p.step * of[0] / (of[1] + p.l2))

    if node == 1:
        tree.value[1] = leaf(sums[job.columns[0]].sum(axis=0))
    found = best_split(sums, job.columns, p)
    if found is None:
        return
    tree.gain[node], tree.feature[node], tree.bin[node], tree.missing_left[node], low, high = found
    cut = cuts[tree.feature[node]]
    # A split above the last cut only parts known values from missing ones.
    tree.threshold[node] = cut[tree.bin[node]] if tree.bin[node] < len(cut) else np.inf
    tree.value[2 * node], tree.value[2 * node + 1] = leaf(low), leaf(high)


def _block_scores(rows: DataFrame, jobs: Sequence[_Job], p: BoostParameters, width: int) -> dict[tuple[int, int], float]:
    """Average precision of the validation rows for each fit after each of the block's rounds."""
    by_part: dict[str, list[_Job]] = {}
    for job in jobs:
        by_part.setdefault(job.fit.part, []).append(job)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in _parts(batch):
                held = _Rows(own, width)
                for job in by_part.get(part, ()):
                    margin = held.margins[:, job.place]
                    for done, tree in enumerate(job.recent, 1):
                        margin = margin + tree.value[tree.nodes(held.bins, p.max_bins, p.max_depth)]
                        n = len(margin)
                        yield pa.record_batch(
                            [
                                pa.array(np.full(n, job.number, np.int32)),
                                pa.array(np.full(n, done, np.int32)),
                                pa.array(_sigmoid(margin)),
                                pa.array(held.labels[:, job.fit.target].astype(np.int32)),
                            ],
                            names=["fit", "done", "probability", "true_label"],
                        )

    scored = rows.where("is_validation").mapInArrow(score, "fit int, done int, probability double, true_label int")
    found = ranking_scores(scored, ["fit", "done"]).select("fit", "done", "average_precision").collect()
    return {(r["fit"], r["done"]): r["average_precision"] for r in found if r["average_precision"] is not None}


def _with_margins(rows: DataFrame, jobs: Sequence[_Job], p: BoostParameters, width: int) -> DataFrame:
    """The rows with the block's trees added to their margins, written."""
    by_part: dict[str, list[_Job]] = {}
    for job in jobs:
        by_part.setdefault(job.fit.part, []).append(job)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in _parts(batch):
                held = _Rows(own, width)
                margins = held.margins.copy()
                for job in by_part.get(part, ()):
                    margins[:, job.place] = held.margin(job, p.max_bins, p.max_depth)
                yield own.set_column(own.schema.get_field_index("margins"), "margins", lists(margins))

    return stage_table(rows.mapInArrow(add, rows.schema), "boost-rows")


def fit_boosted(rows: DataFrame, fits: Sequence[Fit], p: BoostParameters = BoostParameters()) -> list[BoostedModel]:
    """Fit all models together.

    ``rows`` has ``part``, ``features`` (vector or array), ``labels`` (an array, 0 or 1 for each target), ``key`` (a
    long that rows are sampled by) and ``is_validation``. Validation rows only decide when to stop. Positives weigh as
    many times more as there are negatives for each positive among a part's training rows.
    """
    spark = rows.sparkSession
    ship(spark)
    if p.max_bins > 255:
        raise ValueError("Bins are bytes, one of them for missing values")
    rows = rows.select("part", feature_array(rows).alias("features"), "labels", "key", "is_validation")
    train = rows.where(~F.col("is_validation"))
    counted = train.select("part", F.size("features").alias("width"), F.posexplode("labels").alias("target", "label"))
    classes = {
        (r["part"], r["target"]): r
        for r in counted.groupBy("part", "target")
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), F.max("width").alias("width"))
        .collect()
    }
    for fit in fits:
        found = classes.get((fit.part, fit.target))
        if not found or not found["pos"] or not found["neg"]:
            raise ValueError(f"Training rows of {fit.part} need both classes")
    width = max(r["width"] for r in classes.values())
    cuts = cut_points(rows, width, p.max_bins)
    places = {part: [f for f in fits if f.part == part] for part in {fit.part for fit in fits}}
    jobs = []
    for number, fit in enumerate(fits):
        r = classes[fit.part, fit.target]
        jobs.append(_Job(number, fit, places[fit.part].index(fit), r["neg"] / r["pos"], ()))
    tasks = max(1, -(-sum(r["pos"] + r["neg"] for key, r in classes.items() if key[1] == 0) // p.rows_per_task))
    held = _binned_rows(rows.where(F.col("part").isin(*places)), cuts, {k: len(v) for k, v in places.items()}, p, width, tasks)

    models = [BoostedModel([], p.max_depth, width) for _ in fits]
    best: dict[int, int] = {}
    running = list(jobs)
    grown = 0
    while running:
        growing = list(running)
        for _ in range(min(p.block, max(_left(job, grown, p) for job in running))):
            growing = [job for job in growing if _left(job, grown, p) > 0]
            growing = [_begin(job, grown, p, width) for job in growing]
            for level in range(p.max_depth):
                for (number, node), sums in _histograms(held, growing, level, p, width, tasks).items():
                    job = next(j for j in growing if j.number == number)
                    _grow(job.tree, node, sums, job, cuts[job.fit.part], p)
            grown += 1
            growing = [replace(job, recent=(*job.recent, job.tree), tree=None) for job in growing]
            done = {job.number: job for job in growing}
            running = [done.get(job.number, job) for job in running]
        stopping = [job for job in running if job.fit.rounds is None]
        scores = _block_scores(held, stopping, p, width) if stopping else {}
        held = _with_margins(held, running, p, width)
        for job in running:
            model = models[job.number]
            model.trees.extend(job.recent)
            if job.fit.rounds is None:
                model.history.extend(scores.get((job.number, n), 0.0) for n in range(1, len(job.recent) + 1))
                best[job.number] = _stop(model.history, p.patience)
        running = [
            replace(job, recent=())
            for job in running
            if _left(job, grown, p) > 0
            and (job.fit.rounds is not None or best[job.number] + p.patience > len(models[job.number].history))
        ]
    for job in jobs:
        if job.number in best:
            models[job.number].trees = models[job.number].trees[: best[job.number]]
    return models


def _left(job: _Job, grown: int, p: BoostParameters) -> int:
    return (job.fit.rounds or p.max_rounds) - grown


def _begin(job: _Job, grown: int, p: BoostParameters, width: int) -> _Job:
    """The job with an empty tree and the features that the tree may use."""
    draw = np.random.default_rng([job.fit.seed, grown])
    columns = sorted(draw.permutation(width)[: max(1, int(p.feature_share * width))].tolist())
    return replace(job, tree=Tree.empty(p.max_depth), round=grown, columns=tuple(columns))


def _stop(history: Sequence[float], patience: int) -> int:
    """Rounds up to the best one, looking no further than ``patience`` rounds past it."""
    best = 0
    for at, score in enumerate(history):
        if at - best >= patience:
            break
        if score > history[best]:
            best = at
    return best + 1


def _binned_rows(
    rows: DataFrame, cuts: dict[str, list[np.ndarray]], fits: dict[str, int], p: BoostParameters, width: int, tasks: int
) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in _parts(batch):
                bins = _binned(matrix(own["features"], width), cuts[part], p.max_bins)
                yield pa.record_batch(
                    [
                        own["part"],
                        pa.array([row.tobytes() for row in bins], pa.binary()),
                        own["labels"],
                        own["key"],
                        own["is_validation"],
                        lists(np.zeros((own.num_rows, fits[part]))),
                    ],
                    names=["part", "bins", "labels", "key", "is_validation", "margins"],
                )

    schema = "part string, bins binary, labels array<double>, key long, is_validation boolean, margins array<double>"
    return stage_table(rows.repartition(tasks).mapInArrow(cut, schema), "boost-rows")


def boosted_trainer(p: BoostParameters = BoostParameters(), seed: int = 42) -> Callable[[DataFrame, "int | None"], tuple[Any, int]]:
    """A trainer for one cell at a time: ``(train, rounds or None) -> (model, rounds used)``.

    ``train`` has ``features``, ``label``, ``window_id`` and ``is_validation``; a fit with given rounds leaves
    validation rows out.
    """

    def fit(train: DataFrame, rounds: int | None) -> tuple[Any, int]:
        rows = train.select(
            F.lit("train").alias("part"),
            "features",
            F.array(F.col("label").cast("double")).alias("labels"),
            F.xxhash64("window_id").alias("key"),
            "is_validation",
        )
        if rounds is not None:
            rows = rows.where(~F.col("is_validation"))
        model = fit_boosted(rows, [Fit("train", 0, seed, rounds)], p)[0]
        return model, len(model.trees)

    return fit
