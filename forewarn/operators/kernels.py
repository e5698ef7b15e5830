"""Features of fixed-step sequences that don't depend on where in the window a shape stands.

A bank of random dilated kernels, drawn from a seed, slides over each sequence; a kernel leaves the largest response
and the share of positive ones. A linear classifier over these sees order and shape, which one over the flattened
sequence cannot follow through a shift in time. Tasks read Arrow batches; a window's sequence is all they hold of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forewarn.functions.workers import lists, ship

LENGTHS = (3, 5, 7, 9)
# Windows that are convolved together.
_ROWS = 512
# Numbers in the matrix that stands for a whole bank; longer sequences go kernel by kernel.
_DENSE = 1 << 20


@dataclass(frozen=True)
class Kernel:
    weights: np.ndarray  # (length, channels used)
    channels: np.ndarray
    bias: float
    dilation: int
    padded: bool


def kernel_bank(seed: int, steps: int, channels: int, kernels: int = 128) -> list[Kernel]:
    """Random kernels: centred normal weights, dilations up to the sequence's length, every second one padded."""
    draw = np.random.default_rng([seed, steps, channels])
    lengths = [length for length in LENGTHS if length <= steps] or [1]
    bank = []
    for number in range(kernels):
        length = int(draw.choice(lengths))
        used = draw.permutation(channels)[: int(draw.integers(1, channels + 1))]
        weights = draw.normal(size=(length, len(used)))
        widest = np.log2(max(1.0, (steps - 1) / max(1, length - 1)))
        bank.append(
            Kernel(
                weights - weights.mean(axis=0),
                np.sort(used),
                float(draw.uniform(-1, 1)),
                int(2 ** draw.uniform(0, widest)),
                bool(number % 2),
            )
        )
    return bank


def responses(sequences: np.ndarray, kernel: Kernel) -> np.ndarray:
    """Responses of (windows, steps, channels) to a kernel, as (windows, places)."""
    length = len(kernel.weights)
    reach = (length - 1) * kernel.dilation
    own = sequences[:, :, kernel.channels]
    if kernel.padded:
        own = np.pad(own, ((0, 0), (reach // 2, reach - reach // 2), (0, 0)))
    places = np.arange(own.shape[1] - reach)[:, None] + np.arange(length) * kernel.dilation
    return np.tensordot(own[:, places], kernel.weights, axes=([2, 3], [0, 1])) + kernel.bias


@dataclass(frozen=True)
class BankMatrix:
    """All kernels at all of their places as columns over the flattened sequence; ``starts`` has each kernel's first."""

    weights: np.ndarray  # (steps * channels, places of all kernels)
    biases: np.ndarray
    starts: np.ndarray
    places: np.ndarray


def bank_matrix(bank: Sequence[Kernel], steps: int, channels: int) -> BankMatrix | None:
    """The bank as one matrix, or None where that would be large."""
    reaches = [(len(kernel.weights) - 1) * kernel.dilation for kernel in bank]
    places = np.array([steps if kernel.padded else steps - reach for kernel, reach in zip(bank, reaches)])
    if steps * channels * int(places.sum()) > _DENSE:
        return None
    starts = np.concatenate(([0], np.cumsum(places)[:-1]))
    weights = np.zeros((steps, channels, int(places.sum())))
    for kernel, reach, start, n in zip(bank, reaches, starts, places):
        at = np.arange(n)
        for tap, of_tap in enumerate(kernel.weights):
            step = at + tap * kernel.dilation - (reach // 2 if kernel.padded else 0)
            inside = (step >= 0) & (step < steps)
            weights[step[inside][:, None], kernel.channels, start + at[inside][:, None]] = of_tap
    biases = np.repeat([kernel.bias for kernel in bank], places)
    return BankMatrix(weights.reshape(steps * channels, -1), biases, starts, places)


def bank_features(sequences: np.ndarray, bank: Sequence[Kernel], whole: BankMatrix | None = None) -> np.ndarray:
    """The largest response and the share of positive ones, for each kernel; ``whole`` is the bank as one matrix."""
    found = np.empty((len(sequences), 2 * len(bank)))
    # A missing number must reach only the places that read it.
    if whole is not None and np.isfinite(sequences).all():
        out = sequences.reshape(len(sequences), -1) @ whole.weights + whole.biases
        found[:, ::2] = np.maximum.reduceat(out, whole.starts, axis=1)
        found[:, 1::2] = np.add.reduceat((out > 0).astype(np.float64), whole.starts, axis=1) / whole.places
        return found
    for i, kernel in enumerate(bank):
        out = responses(sequences, kernel)
        found[:, 2 * i], found[:, 2 * i + 1] = out.max(axis=1), (out > 0).mean(axis=1)
    return found


def kernel_features(packed: DataFrame, seeds: Sequence[int], kernels: int = 128) -> DataFrame:
    """``window_id``, ``seed`` and ``features`` (a vector) of each packed sequence, one row for each seed."""
    ship(packed.sparkSession)
    wanted = [int(seed) for seed in seeds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        banks: dict[tuple[int, int, int], tuple[list[Kernel], BankMatrix | None]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                inner = part["sequence"].flatten()
                steps, channels = len(inner) // part.num_rows, len(inner.flatten()) // len(inner)
                values = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                sequences = values.reshape(part.num_rows, steps, channels)
                for seed in wanted:
                    key = seed, steps, channels
                    if key not in banks:
                        bank = kernel_bank(*key, kernels)
                        banks[key] = bank, bank_matrix(bank, steps, channels)
                    yield pa.record_batch(
                        [
                            part["window_id"],
                            pa.array(np.full(part.num_rows, seed, np.int32)),
                            lists(bank_features(sequences, *banks[key])),
                        ],
                        names=["window_id", "seed", "features"],
                    )

    rows = packed.select("window_id", "sequence")
    found = rows.mapInArrow(run, "window_id string, seed int, features array<double>")
    return found.withColumn("features", array_to_vector("features"))
