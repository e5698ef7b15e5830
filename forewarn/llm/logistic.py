"""Logistic regression over wide hashed features, of which the driver's JVM holds no vectors.

MLlib's optimiser keeps some dozens of vectors of all weights in the driver's heap and makes about as many anew in every
round. Here Spark adds up loss and slopes over the rows in each pass, tasks send one vector each, and limited-memory
BFGS moves the weights in place on the driver. The aim is MLlib's without standardisation: the weighted mean of the log
losses and half of ``penalty`` times the squared weights, with a free bias.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from forewarn.llm.common import enter, ship

MEMORY = 10
#: Least share of the loss that a round has to gain, and most halvings of a step.
TOLERANCE = 1e-6
HALVINGS = 30
#: Parts of the training rows: each sends a vector of all weights in every pass.
PARTS = 4


def _residuals(margins: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss of rows that count ``up`` for the class 1 and ``down`` for 0, and its slope by their margins."""
    loss = float(up @ np.logaddexp(0, -margins) + down @ np.logaddexp(0, margins))
    return loss, (up + down) / (1 + np.exp(-np.clip(margins, -500, 500))) - up


def _counts(margins: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[float, np.ndarray]:
    return float(up.sum()), up + down


def _totals(rows: DataFrame, weights: np.ndarray, of_rows: Callable) -> tuple[float, np.ndarray]:
    """Over rows (places, up, down): the sum of what ``of_rows`` gives first, and for each place, and last for the bias,
    the sum of what it gives second."""
    held = rows.sparkSession.sparkContext.broadcast(weights)
    width = len(weights) - 1

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("logistic.totals")
        weights, first, sums = held.value, 0.0, np.zeros(width + 1)
        for batch in batches:
            places = batch.column(0)
            flat, lengths = places.flatten().to_numpy(), np.diff(places.offsets.to_numpy())
            row = np.repeat(np.arange(len(lengths)), lengths)
            margins = np.bincount(row, weights[flat], len(lengths)) + weights[-1]
            more, values = of_rows(margins, batch.column(1).to_numpy(), batch.column(2).to_numpy())
            first += more
            sums[:-1] += np.bincount(flat, values[row], width)
            sums[-1] += values.sum()
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([sums.tobytes()], pa.binary())], names=["first", "sums"])

    found = rows.mapInArrow(added, "first double, sums binary").toArrow()
    held.destroy()
    total = np.zeros(width + 1)
    for part in found.column("sums"):
        total += np.frombuffer(part.as_buffer())
    return sum(found.column("first").to_pylist()), total


def minimised(value_and_slope: Callable, at: np.ndarray, rounds: int) -> np.ndarray:
    """Limited-memory BFGS with halved steps, for a strictly convex function; ``at`` is overwritten."""
    value, slope = value_and_slope(at)
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, shares = -slope, []
        for step, change, product in reversed(history):
            shares.append(float(step @ way) / product)
            way -= shares[-1] * change
        if history:
            step, change, product = history[-1]
            way *= product / float(change @ change)
        else:
            way /= max(1.0, float(np.linalg.norm(way)))
        for (step, change, product), share in zip(history, reversed(shares)):
            way += (share - float(change @ way) / product) * step
        down = float(slope @ way)
        for _ in range(HALVINGS):
            at += way
            after, slope_after = value_and_slope(at)
            if after <= value + 1e-4 * down:
                break
            at -= way
            way /= 2
            down /= 2
        else:
            return at
        change = slope_after - slope
        product = float(way @ change)
        if product > 0:
            history = [*history, (way, change, product)][-MEMORY:]
        gained, value, slope = value - after, after, slope_after
        if gained <= TOLERANCE * abs(value):
            break
    return at


def fit(rows: DataFrame, width: int, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias for rows (places array<int>, up double, down double): distinct places under ``width`` that
    are 1 in the row, and what it counts for each class."""
    ship(rows.sparkSession)
    rows = rows.select("places", "up", "down").coalesce(PARTS)
    up, counts = _totals(rows, np.zeros(width + 1), _counts)
    total = counts[-1]
    if not 0 < up < total:  # one class
        return np.zeros(width), 0.0 if not total else float(np.copysign(np.inf, up - total / 2))
    share = up / total
    bend = share * (1 - share)
    # Each weight in units in which the function bends about equally, each place less its mean: without these, 40 rounds
    # end well above the least value.
    means = counts[:-1] / total
    scale = 1 / np.sqrt(np.append(np.maximum(means * (1 - means), 0) * bend + penalty, bend))

    def placed(at: np.ndarray) -> np.ndarray:
        weights = at * scale
        weights[-1] -= means @ weights[:-1]
        return weights

    def value_and_slope(at: np.ndarray) -> tuple[float, np.ndarray]:
        weights = placed(at)
        loss, slope = _totals(rows, weights, _residuals)
        slope /= total
        slope[:-1] += penalty * weights[:-1] - slope[-1] * means
        slope *= scale
        return loss / total + penalty / 2 * float(weights[:-1] @ weights[:-1]), slope

    start = np.zeros(width + 1)
    start[-1] = np.log(share / (1 - share)) / scale[-1]
    weights = placed(minimised(value_and_slope, start, rounds))
    return weights[:-1], float(weights[-1])
