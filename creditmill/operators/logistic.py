"""Logistic models of several overlapping parts of the same rows, fitted side by side.

Rows are turned into blocks of numbers once and kept by Spark; every pass over the blocks gives the losses and gradients of
all models. The objective, the scaling and the rules to stop are those of MLlib's ``LogisticRegression`` without penalty.
A model's numbers do not depend on which others are fitted beside it.
"""

from __future__ import annotations

import pickle
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.functions.names import col

# --- fixed values: those of MLlib and Breeze -----------------------------------------------------
TOLERANCE = 1e-6
STEPS_KEPT = 10
LOSSES_KEPT = 20
# -------------------------------------------------------------------------------------------------
BLOCK_ROWS = 256  # with 768 values each a block is 1.5 MB, so that all models use it while it is in the processor's cache
SCORED_ROWS = 1024
DRIVER_PARTS = 64  # sums of more partitions than this meet in tasks before they reach the driver


@dataclass(frozen=True)
class Part:
    """Median of every value, and the positions of those that get a 0/1 flag where they are missing."""

    medians: Sequence[float]
    flagged: Sequence[int]


def _numbers(values) -> tuple[np.ndarray, np.ndarray]:
    """A row of an array column each, and where it is NULL."""
    flat, shape = values.flatten(), (len(values), -1)
    return flat.to_numpy(zero_copy_only=False).reshape(shape), flat.is_null().to_numpy(zero_copy_only=False).reshape(shape)


def _blocks(batches: Iterator, centre: np.ndarray) -> Iterator:
    """Per block: the label, the parts a row is in, the values less their centre, and which are missing.

    Columns of zeros are left out, and of columns that are missing in the same rows one is kept.
    """
    import pyarrow as pa

    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            y, inside, values = batch.slice(start, BLOCK_ROWS).columns
            size = len(y)
            given, missing = _numbers(values)
            table = np.where(missing, 0.0, given - centre).T
            used = np.flatnonzero(table.any(axis=1))
            different, which = np.unique(np.packbits(missing.T, axis=1), axis=0, return_inverse=True)
            block = {
                "y": y.to_numpy(zero_copy_only=False).astype(bool),
                "inside": inside.flatten().to_numpy(zero_copy_only=False).reshape(size, -1).T.copy(),
                "used": used, "table": pa.compress(np.ascontiguousarray(table[used]).tobytes(), "lz4", asbytes=True),
                "missing": np.unpackbits(different, axis=1, count=size), "which": which.ravel().astype(np.int32)}
            yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(block)], pa.binary())})


def _opened(blob: bytes) -> tuple[dict, np.ndarray, np.ndarray]:
    """A block, its values (a row each) and its kinds of missing rows (a row each)."""
    import pyarrow as pa

    block = pickle.loads(blob)
    shape = (len(block["used"]), len(block["y"]))
    table = np.frombuffer(pa.decompress(block["table"], 8 * shape[0] * shape[1], "lz4"), dtype=float).reshape(shape)
    return block, table, block["missing"].astype(float)


@dataclass(frozen=True)
class _Scale:
    """Weights of the two classes in one part, and mean and reciprocal deviation of its inputs, the values' less the centre."""

    weights: tuple[float, float]
    total: float
    shift: np.ndarray  # from the centre to the part's median, which stands for a missing value
    flagged: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Weights of the values and of their being missing, and the constant, of scaled coefficients with the intercept."""
        w = x[:-1] * self.scale
        n = len(self.shift)
        missing = w[:n] * self.shift
        missing[self.flagged] += w[n:]
        return w[:n], missing, x[-1] - float(w @ self.mean)

    def joined(self, values: np.ndarray, missing: np.ndarray, total: float) -> np.ndarray:
        """The gradient for the same coefficients from that for the weights of ``split``."""
        w = np.concatenate([values + self.shift * missing, missing[self.flagged]])
        return np.append((w - self.mean * total) * self.scale, total)


def _row_weights(block: dict, part: int, weights: tuple[float, float]) -> np.ndarray:
    return np.where(block["y"], weights[1], weights[0]) * block["inside"][part]


def _moments(blobs: Iterator[bytes], weights: dict[int, tuple[float, float]], width: int) -> Iterator[np.ndarray]:
    """Per part the weighted sums of the values, of their squares and of their being missing."""
    sums = np.zeros((len(weights), 3, width))
    for blob in blobs:
        block, table, missing = _opened(blob)
        squares = table * table
        for i, (part, w) in enumerate(weights.items()):
            rows = _row_weights(block, part, w)
            sums[i, 0, block["used"]] += table @ rows
            sums[i, 1, block["used"]] += squares @ rows
            sums[i, 2] += (missing @ rows)[block["which"]]
    yield sums


def _losses(blobs: Iterator[bytes], points: list[tuple], width: int) -> Iterator[np.ndarray]:
    """Per point (part, class weights, split coefficients) the loss, the sum of residuals, and both gradients."""
    sums = np.zeros((len(points), 2 + 2 * width))
    for blob in blobs:
        block, table, missing = _opened(blob)
        used, which, y = block["used"], block["which"], block["y"]
        for i, (part, weights, (values, absent, constant)) in enumerate(points):
            kinds = np.bincount(which, weights=absent, minlength=len(missing))
            margin = values[used] @ table + kinds @ missing + constant
            rows = _row_weights(block, part, weights)
            small = np.exp(-np.abs(margin))
            residual = rows * (np.where(margin >= 0, 1.0, small) / (1.0 + small) - y)
            sums[i, 0] += rows @ (np.log1p(small) + np.maximum(margin, 0.0) - y * margin)
            sums[i, 1] += residual.sum()
            sums[i, 2 + used] += table @ residual
            sums[i, 2 + width:] += (missing @ residual)[which]
    yield sums


def minimise(x: np.ndarray, most: int, tolerance: float = TOLERANCE) -> Generator:
    """L-BFGS as a dialogue: yields points, is sent their (loss, gradient), returns the best point."""
    loss, gradient = yield x
    first, window, steps = loss, [loss], []
    for _ in range(most):
        if np.linalg.norm(gradient) <= max(tolerance * loss, 1e-8):
            break
        direction = -gradient
        factors = []
        for s, g, rho in reversed(steps):
            factors.append(rho * (s @ direction))
            direction = direction - factors[-1] * g
        if steps:
            s, g, _ = steps[-1]
            direction = direction * (s @ g) / (g @ g)
        for (s, g, rho), factor in zip(steps, reversed(factors)):
            direction = direction + (factor - rho * (g @ direction)) * s
        slope = direction @ gradient
        if slope >= 0:
            direction, steps = -gradient, []
            slope = direction @ gradient
        step, low, high = 1.0 if steps else min(1.0, 1.0 / np.linalg.norm(gradient)), 0.0, np.inf
        for _ in range(40):  # until the step lowers the loss enough (Armijo) and flattens the slope (Wolfe)
            there = x + step * direction
            new_loss, new_gradient = yield there
            if not new_loss <= loss + 1e-4 * step * slope:
                high = step
            elif new_gradient @ direction < 0.9 * slope:
                low = step
            else:
                break
            step = 2 * step if high == np.inf else (low + high) / 2
        if not new_loss < loss:
            break  # no further step is found
        moved, turned = there - x, new_gradient - gradient
        if moved @ turned > 0:
            steps = [*steps, (moved, turned, 1.0 / (moved @ turned))][-STEPS_KEPT:]
        x, loss, gradient = there, new_loss, new_gradient
        window = [*window, loss][-LOSSES_KEPT:]
        if max(window) - loss <= tolerance * first:
            break
    return x


def fit_together(rows: DataFrame, label: str, values: str, members: Sequence[Column], parts: Sequence[Part],
                 centre: Sequence[float], most: int) -> list[tuple[np.ndarray, float]]:
    """Coefficients (values, then flags) and intercept of a model with balanced class weights for each part.

    ``members`` says which rows are in which part; ``values`` is an array of doubles, missing ones NULL, kept as distances
    from ``centre``. Blocks of rows are
    kept by Spark, compressed, and go to disk where memory ends. The driver holds a few vectors of a model's length.
    """
    width = len(parts[0].medians)
    centre = np.array(centre, dtype=float)
    read = rows.select(col(label).cast("double").alias("y"), F.array(*[m.cast("double") for m in members]).alias("inside"),
                       col(values).alias("values"))
    ones = [F.count_if(m & (F.col(label) == 1)) for m in members]
    zeros = [F.count_if(m & (F.col(label) == 0)) for m in members]
    counts = rows.agg(F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))), *ones, *zeros).first()
    if counts[0]:
        raise ValueError(f"{counts[0]} rows without a label of 0 or 1")
    ones, zeros = counts[1:1 + len(parts)], counts[1 + len(parts):]
    if not all(ones) or not all(zeros):
        raise ValueError("a part has rows of one class only")
    weights = {i: ((a + b) / (2 * a), (a + b) / (2 * b)) for i, (a, b) in enumerate(zip(zeros, ones))}

    kept = read.mapInArrow(lambda batches: _blocks(batches, centre), "block binary").rdd.map(lambda r: bytes(r[0]))
    kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
    depth = 1 if kept.getNumPartitions() <= DRIVER_PARTS else 2
    try:
        sums = kept.mapPartitions(lambda blobs: _moments(blobs, weights, width)).treeReduce(np.add, depth)
        scales = [_scaled(part, weights[i], float(zeros[i] + ones[i]), centre, sums[i]) for i, part in enumerate(parts)]
        talks = [minimise(np.zeros(len(s.mean) + 1), most) for s in scales]
        asked = {i: next(talk) for i, talk in enumerate(talks)}
        found = {}
        while asked:
            points = [(i, scales[i].weights, scales[i].split(x)) for i, x in asked.items()]
            sums = kept.mapPartitions(lambda blobs: _losses(blobs, points, width)).treeReduce(np.add, depth)
            for i, row in zip(list(asked), sums):
                row = row / scales[i].total
                try:
                    asked[i] = talks[i].send((row[0], scales[i].joined(row[2:2 + width], row[2 + width:], row[1])))
                except StopIteration as end:
                    found[i] = end.value
                    del asked[i]
    finally:
        kept.unpersist()
    return [_unscaled(scales[i], found[i], centre) for i in range(len(parts))]


def _scaled(part: Part, weights: tuple[float, float], total: float, centre: np.ndarray, sums: np.ndarray) -> _Scale:
    """The scale of a part. As values are 0 where missing, no sum of products of the two is needed."""
    shift, flagged = np.array(part.medians, dtype=float) - centre, np.array(part.flagged, dtype=int)
    means = np.concatenate([sums[0] + shift * sums[2], sums[2][flagged]]) / total
    squares = np.concatenate([sums[1] + shift * shift * sums[2], sums[2][flagged]]) / total
    variance = squares - means * means
    # an input that is the same in all rows gets no coefficient
    scale = np.where(variance > 1e-12 * squares, 1.0 / np.sqrt(np.where(variance > 0, variance, 1.0)), 0.0)
    return _Scale(weights, total, shift, flagged, means, scale)


def _unscaled(scale: _Scale, x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, float]:
    coefficients = x[:-1] * scale.scale
    origin = scale.mean + np.concatenate([centre, np.zeros(len(scale.flagged))])
    return coefficients, float(x[-1] - coefficients @ origin)


def chances(rows: DataFrame, values: str, part: Part, coefficients: Sequence[float], intercept: float, name: str) -> DataFrame:
    """``rows`` with ``name``, the chance of class 1, in place of ``values``. A row's chance does not depend on other rows."""
    medians, flagged = np.array(part.medians, dtype=float), np.array(part.flagged, dtype=int)
    of_values, of_flags = np.split(np.array(coefficients, dtype=float), [len(medians)])
    kept = [c for c in rows.columns if c != values]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [np.empty(0)]
            for start in range(0, batch.num_rows, SCORED_ROWS):
                given, missing = _numbers(batch.column(values).slice(start, SCORED_ROWS))
                margin = (np.where(missing, medians, given) * of_values).sum(axis=1)
                margin += np.where(missing[:, flagged], of_flags, 0.0).sum(axis=1) + intercept
                small = np.exp(-np.abs(margin))
                found.append(np.where(margin >= 0, 1.0, small) / (1.0 + small))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(np.concatenate(found))], [*kept, name])

    plain = rows.select(*[col(c) for c in [*kept, values]])
    return plain.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField(name, T.DoubleType())]))
