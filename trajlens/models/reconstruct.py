"""Reconstruction models fitted on window tables.

A model is any picklable object with ``reconstruct(batch[n, size, features])``.
Fitting is a Spark job over the window table; only quantities whose size depends
on the window shape, never on the number of windows, reach the driver.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlens.models.batches import window_batch
from trajlens.operators.ordering import checkpointed, local_table, once

# Training defaults.
EPOCHS = 20
BATCH_SIZE = 128
LEARNING_RATE = 1e-3
PATIENCE = 5
LATENT_DIM = 64
HIDDEN_DIM = 128
# Windows with more cells get their main directions without a covariance matrix.
DENSE_CELLS = 1_000
EXTRA_DIRECTIONS, PCA_TOLERANCE, PCA_PASSES = 10, 1e-9, 200
SUM_CHUNK = 1 << 16
# Optimiser states that are trained side by side, and mini-batches among which windows are mixed.
BUCKETS = 16
MIXED_BATCHES = 32

WEIGHT_SCHEMA = "kind string, name string, shape array<int>, values array<double>"


@runtime_checkable
class Reconstructor(Protocol):
    def reconstruct(self, batch: np.ndarray) -> np.ndarray: ...


def _describe(windows: DataFrame) -> tuple[int, int, np.ndarray]:
    """Window size, feature count and mean of the flattened windows, in one job.

    Every task sends one partial vector.
    """
    rows = windows.select(
        F.size("X").alias("size"),
        F.size(F.get("X", F.lit(0))).alias("width"),
        array_to_vector(F.flatten("X")).alias("cells"),
    )
    shapes = rows.groupBy("size", "width").agg(Summarizer.mean(rows["cells"]).alias("mean")).limit(2).collect()
    if not shapes or shapes[0]["size"] <= 0 or shapes[0]["width"] <= 0:
        raise ValueError("the window table is empty")
    if len(shapes) > 1:
        raise ValueError("windows of unequal shape in one table")
    return shapes[0]["size"], shapes[0]["width"], np.asarray(shapes[0]["mean"].toArray())


def _around(batch: np.ndarray) -> np.ndarray:
    """Every step with its zero-padded neighbours, ``[n, size, 3 * features]``."""
    n, size, width = batch.shape
    padded = np.zeros((n, size + 2, width))
    padded[:, 1:-1] = batch
    return np.concatenate([padded[:, :-2], padded[:, 1:-1], padded[:, 2:]], axis=2)


def whole_windows(batch: np.ndarray) -> np.ndarray:
    return batch.reshape(len(batch), -1)


def neighbourhoods(batch: np.ndarray) -> np.ndarray:
    return _around(batch).reshape(-1, 3 * batch.shape[2])


def _summed(windows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """Sum over all windows of a vector that ``partial`` makes of each batch.

    A task adds up its batches and sends the sum in chunks; chunks are summed by
    Spark, so the driver gets one vector, however many tasks there are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            x = window_batch(batch)
            if len(x):
                total += partial(x)
        for at in range(0, length, SUM_CHUNK):
            part = pa.array([total[at : at + SUM_CHUNK]], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([at // SUM_CHUNK], pa.int32()), part], names=["chunk", "part"])

    parts = windows.select("X").mapInArrow(work, "chunk int, part array<double>").withColumn("part", array_to_vector("part"))
    sums = parts.groupBy("chunk").agg(Summarizer.sum(parts["part"]).alias("total")).collect()
    if not sums:
        return np.zeros(length)
    return np.concatenate([r["total"].toArray() for r in sorted(sums, key=lambda r: r["chunk"])])


def principal_directions(
    windows: DataFrame,
    rows_of: Callable[[np.ndarray], np.ndarray],
    mean: np.ndarray,
    k: int,
    extra: int = EXTRA_DIRECTIONS,
    tolerance: float = PCA_TOLERANCE,
    most_passes: int = PCA_PASSES,
    seed: int = 42,
) -> np.ndarray:
    """The ``k`` main directions ``[cells, k]`` of the rows that ``rows_of`` makes of a batch, by block power iteration.

    Each pass over the windows multiplies ``k + extra`` orthonormal directions by
    the scatter matrix, which is never built: tasks and driver hold cells x
    (k + extra) numbers. It ends when the residual of the main ``k`` is below
    ``tolerance`` times the largest eigenvalue, and warns if it isn't after ``most_passes``.
    """
    cells = len(mean)
    k, block = min(k, cells), min(k + extra, cells)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((cells, block)))[0]
    residual = float("inf")
    for _ in range(most_passes):

        def product(x: np.ndarray, basis: np.ndarray = basis) -> np.ndarray:
            rows = rows_of(x) - mean
            return (rows.T @ (rows @ basis)).ravel()

        image = _summed(windows, product, cells * block).reshape(cells, block)
        values, turn = np.linalg.eigh(basis.T @ image)
        turn = turn[:, ::-1][:, :k]
        found, values = basis @ turn, values[::-1][:k]
        residual = float(np.linalg.norm(image @ turn - found * values)) / max(float(values[0]), np.finfo(float).tiny)
        if residual <= tolerance:
            break
        basis = np.linalg.qr(image)[0]
    else:
        warnings.warn(f"main directions after {most_passes} passes: relative residual {residual:.1e}", stacklevel=3)
    return found


def dense_directions(
    windows: DataFrame, rows_of: Callable[[np.ndarray], np.ndarray], mean: np.ndarray, k: int
) -> np.ndarray:
    """The ``k`` main directions ``[cells, k]``, from the scatter matrix that one pass over the windows adds up in the tasks."""
    cells = len(mean)

    def scatter(x: np.ndarray) -> np.ndarray:
        rows = rows_of(x) - mean
        return (rows.T @ rows).ravel()

    _, found = np.linalg.eigh(_summed(windows, scatter, cells * cells).reshape(cells, cells))
    return found[:, ::-1][:, : min(k, cells)]


@dataclass(frozen=True)
class MeanProfile:
    """Rebuilds every window by the training mean of each (position, feature)."""

    mean: np.ndarray
    kind = "mean_profile"

    @classmethod
    def fit(cls, windows: DataFrame) -> "MeanProfile":
        size, width, mean = _describe(windows)
        return cls(mean.reshape(size, width))

    def reconstruct(self, batch: np.ndarray) -> np.ndarray:
        return np.broadcast_to(self.mean, batch.shape)

    def weights(self) -> dict[str, np.ndarray]:
        return {"mean": self.mean}

    @classmethod
    def from_weights(cls, weights: dict[str, np.ndarray]) -> "MeanProfile":
        return cls(weights["mean"])


@dataclass(frozen=True)
class PcaWindow:
    """Projects the whole window on its k main directions and back."""

    mean: np.ndarray
    directions: np.ndarray
    kind = "pca_window"

    @classmethod
    def fit(cls, windows: DataFrame, k: int = 8) -> "PcaWindow":
        windows = once(windows.select("X"))
        _, _, mean = _describe(windows)
        if len(mean) > DENSE_CELLS:
            return cls(mean, principal_directions(windows, whole_windows, mean, k))
        return cls(mean, dense_directions(windows, whole_windows, mean, k))

    def reconstruct(self, batch: np.ndarray) -> np.ndarray:
        centred = batch.reshape(len(batch), -1) - self.mean
        return (centred @ self.directions @ self.directions.T + self.mean).reshape(batch.shape)

    def weights(self) -> dict[str, np.ndarray]:
        return {"mean": self.mean, "directions": self.directions}

    @classmethod
    def from_weights(cls, weights: dict[str, np.ndarray]) -> "PcaWindow":
        return cls(weights["mean"], weights["directions"])


@dataclass(frozen=True)
class PcaLocal:
    """Rebuilds each step from its zero-padded neighbourhood of three steps."""

    mean: np.ndarray
    directions: np.ndarray
    kind = "pca_local"

    @classmethod
    def fit(cls, windows: DataFrame, k: int = 4) -> "PcaLocal":
        windows = once(windows.select("X"))
        size, width, whole = _describe(windows)
        # The mean of the neighbourhoods follows from the mean window.
        mean = neighbourhoods(whole.reshape(1, size, width)).mean(axis=0)
        if 3 * width > DENSE_CELLS:
            return cls(mean, principal_directions(windows, neighbourhoods, mean, k))
        return cls(mean, dense_directions(windows, neighbourhoods, mean, k))

    def reconstruct(self, batch: np.ndarray) -> np.ndarray:
        width = batch.shape[2]
        around = _around(batch) - self.mean
        centre = slice(width, 2 * width)
        return around @ self.directions @ self.directions[centre].T + self.mean[centre]

    def weights(self) -> dict[str, np.ndarray]:
        return {"mean": self.mean, "directions": self.directions}

    @classmethod
    def from_weights(cls, weights: dict[str, np.ndarray]) -> "PcaLocal":
        return cls(weights["mean"], weights["directions"])


# --- non-linear bottleneck -------------------------------------------------


def _layer_shapes(cells: int, hidden: int, latent: int) -> list[tuple[int, int]]:
    return [(cells, hidden), (hidden, latent), (latent, hidden), (hidden, cells)]


def _split(flat: np.ndarray, shapes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for rows, cols in shapes:
        weight = flat[at : at + rows * cols].reshape(rows, cols)
        at += rows * cols
        layers.append((weight, flat[at : at + cols]))
        at += cols
    return layers


def _forward(x: np.ndarray, layers) -> list[np.ndarray]:
    """Outputs of every layer; ReLU after the two hidden layers."""
    outputs = [x]
    for number, (weight, bias) in enumerate(layers):
        x = x @ weight + bias
        if number in (0, 2):
            x = np.maximum(x, 0.0)
        outputs.append(x)
    return outputs


def _gradient(x: np.ndarray, flat: np.ndarray, shapes) -> tuple[float, np.ndarray]:
    layers = _split(flat, shapes)
    outputs = _forward(x, layers)
    difference = outputs[-1] - x
    delta = 2.0 * difference / difference.size
    pieces = []
    for number in range(len(layers) - 1, -1, -1):
        if number in (0, 2):
            delta = delta * (outputs[number + 1] > 0)
        pieces.append(np.concatenate([(outputs[number].T @ delta).ravel(), delta.sum(axis=0)]))
        delta = delta @ layers[number][0].T
    return float((difference**2).mean()), np.concatenate(pieces[::-1])


@dataclass(frozen=True)
class DenseAutoencoder:
    """Bottleneck network trained by parallel mini-batch Adam with averaging after each epoch.

    Windows are dealt to ``buckets`` by the hash of their entity and sorted inside
    by window id. Every bucket starts an epoch from the same weights and Adam
    moments, runs its own mini-batches, and the results are averaged by row count
    in the order of the buckets. So the weights depend on the windows and the
    settings, not on files, partitions or tasks. This replaces the single global
    step per batch of one-machine training.
    """

    flat: np.ndarray
    cells: int
    hidden: int
    latent: int
    train_loss: tuple[float, ...] = field(default=())
    val_loss: tuple[float, ...] = field(default=())
    training_seconds: float = 0.0
    kind = "dense_ae"

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        validation: DataFrame | None = None,
        hidden: int = HIDDEN_DIM,
        latent: int = LATENT_DIM,
        epochs: int = EPOCHS,
        batch_size: int = BATCH_SIZE,
        learning_rate: float = LEARNING_RATE,
        patience: int = PATIENCE,
        seed: int = 42,
        entity: str | None = None,
        buckets: int = BUCKETS,
    ) -> "DenseAutoencoder":
        """``entity`` names the column that is dealt to buckets; without it each window is dealt by its own key."""
        start = time.time()
        train = training_buckets(train, entity, buckets)
        validation = None if validation is None else once(validation.select("X"))
        size, width, _ = _describe(train)
        shapes = _layer_shapes(size * width, hidden, latent)
        rng = np.random.default_rng(seed)
        flat = np.concatenate(
            [
                np.concatenate([rng.uniform(-1, 1, rows * cols) / np.sqrt(rows), np.zeros(cols)])
                for rows, cols in shapes
            ]
        )
        state = np.concatenate([flat, np.zeros_like(flat), np.zeros_like(flat)])
        steps, train_loss, val_loss = 0, [], []
        best, best_loss, waited = None, float("inf"), 0
        for epoch in range(epochs):
            state, steps, epoch_loss = _run_epoch(
                train, state, steps, shapes, batch_size, learning_rate, (seed, epoch)
            )
            train_loss.append(epoch_loss)
            if validation is None:
                continue
            current = cls(state[: len(flat)], size * width, hidden, latent)
            val_loss.append(loss(validation, current))
            if val_loss[-1] < best_loss:
                best, best_loss, waited = current.flat, val_loss[-1], 0
            else:
                waited += 1
            if waited >= patience:
                break
        chosen = best if best is not None else state[: len(flat)]
        return cls(
            chosen, size * width, hidden, latent, tuple(train_loss), tuple(val_loss), round(time.time() - start, 3)
        )

    def reconstruct(self, batch: np.ndarray) -> np.ndarray:
        layers = _split(self.flat, _layer_shapes(self.cells, self.hidden, self.latent))
        return _forward(batch.reshape(len(batch), -1), layers)[-1].reshape(batch.shape)

    def history(self, spark: SparkSession) -> DataFrame:
        """``(epoch, train_loss, val_loss, best, waited)``, one row per epoch that was run."""
        rows = [
            (i + 1, t, self.val_loss[i] if i < len(self.val_loss) else None) for i, t in enumerate(self.train_loss)
        ]
        return with_best_epoch(local_table(spark, rows, "epoch int, train_loss double, val_loss double"))

    def weights(self) -> dict[str, np.ndarray]:
        return {
            "flat": self.flat,
            "dims": np.array([self.cells, self.hidden, self.latent], dtype=float),
            "train_loss": np.asarray(self.train_loss),
            "val_loss": np.asarray(self.val_loss),
            "training_seconds": np.array([self.training_seconds]),
        }

    @classmethod
    def from_weights(cls, weights: dict[str, np.ndarray]) -> "DenseAutoencoder":
        cells, hidden, latent = (int(v) for v in weights["dims"])
        return cls(
            weights["flat"],
            cells,
            hidden,
            latent,
            tuple(weights["train_loss"]),
            tuple(weights["val_loss"]),
            float(weights["training_seconds"][0]),
        )


def with_best_epoch(history: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mark the epoch with the lowest validation (else last) loss and count epochs without progress."""
    upto = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    sofar = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    ranked = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("val_loss"), _tie_break(history))
    better = F.col("val_loss") < F.coalesce(F.min("val_loss").over(upto), F.lit(float("inf")))
    marked = history.withColumn("_better", better).withColumn(
        "_last_better", F.max(F.when(F.col("_better"), F.col("epoch"))).over(sofar)
    )
    return marked.select(
        *history.columns,
        (F.row_number().over(ranked) == 1).alias("best"),
        (F.col("epoch") - F.coalesce("_last_better", F.lit(0))).alias("waited"),
    )


def _tie_break(history: DataFrame):
    """First epoch among equal losses; the last epoch when there is no validation loss."""
    return F.when(F.col("val_loss").isNull(), -F.col("epoch")).otherwise(F.col("epoch"))


def training_buckets(windows: DataFrame, entity: str | None, buckets: int) -> DataFrame:
    """``(bucket, X)`` with whole buckets as partitions, in a fixed order inside; stored once for all epochs.

    Windows are known by ``window_id``, or by their values if there is none.
    """
    known = F.col("window_id").cast("string") if "window_id" in windows.columns else F.xxhash64("X").cast("string")
    dealt = F.pmod(F.xxhash64(entity) if entity else F.xxhash64(known), F.lit(buckets)).cast("int")
    keyed = windows.select(dealt.alias("bucket"), known.alias("_key"), F.xxhash64("X").alias("_tie"), "X")
    ordered = keyed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "_key", "_tie")
    return checkpointed(ordered.select("bucket", "X"))


def _run_epoch(train, state, steps, shapes, batch_size, learning_rate, seed) -> tuple[np.ndarray, int, float]:
    """One pass of every bucket over its windows, then the row-weighted average in bucket order."""
    mixed = batch_size * MIXED_BATCHES

    class Run:
        """The optimiser of one bucket."""

        def __init__(self, bucket: int):
            self.bucket, self.rng = bucket, np.random.default_rng([*seed, bucket])
            self.flat, self.first, self.second = (part.copy() for part in np.split(state, 3))
            self.step, self.rows, self.total, self.waiting = steps, 0, 0.0, []

        def add(self, x: np.ndarray, last: bool = False) -> None:
            """Train on every full stretch of windows, and at the end on what is left."""
            self.waiting.append(x)
            if not last and sum(map(len, self.waiting)) < mixed:
                return
            x = np.concatenate(self.waiting)
            stop = len(x) if last else len(x) // mixed * mixed
            for begin in range(0, stop, mixed):
                self.train(x[begin : min(begin + mixed, stop)])
            self.waiting = [x[stop:]]

        def train(self, x: np.ndarray) -> None:
            x = x[self.rng.permutation(len(x))]
            for at in range(0, len(x), batch_size):
                part = x[at : at + batch_size]
                value, gradient = _gradient(part, self.flat, shapes)
                self.step += 1
                self.first = 0.9 * self.first + 0.1 * gradient
                self.second = 0.999 * self.second + 0.001 * gradient**2
                scale = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
                self.flat = self.flat - learning_rate * scale * self.first / (np.sqrt(self.second) + 1e-8)
                self.rows += len(part)
                self.total += value * len(part)

        def result(self) -> pa.RecordBatch:
            self.add(self.waiting[0][:0], last=True)
            merged = pa.array([np.concatenate([self.flat, self.first, self.second])], type=pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([self.bucket], pa.int32()), *[pa.array([v]) for v in (self.rows, self.step - steps, self.total)], merged],
                names=["bucket", "rows", "steps", "total", "state"],
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = None
        for batch in batches:
            bucket, x = batch.column(0).to_numpy(), window_batch(batch)
            x = x.reshape(len(x), -1)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for number, part in zip(bucket[np.append([0], cuts)] if len(bucket) else [], np.split(x, cuts)):
                if run is None or run.bucket != number:
                    if run is not None:
                        yield run.result()
                    run = Run(int(number))
                run.add(part)
        if run is not None:
            yield run.result()

    schema = "bucket int, rows long, steps long, total double, state array<double>"
    # The driver holds one state per bucket, as Arrow numbers.
    done = train.mapInArrow(work, schema).toArrow()
    if not done.num_rows:
        raise ValueError("the window table is empty")
    counts, moved, totals = (done.column(c).to_numpy() for c in ("rows", "steps", "total"))
    averaged, states = np.zeros(len(state)), done.column("state")
    for i in np.argsort(done.column("bucket").to_numpy()):
        averaged += states[int(i)].values.to_numpy() * counts[i]
    rows, most, total = int(counts.sum()), int(moved.max()), float(np.sort(totals).sum())
    return averaged / rows, steps + most, total / rows


# --- loss and storage ------------------------------------------------------


def loss(windows: DataFrame, model: Reconstructor) -> float:
    """Sum of squared errors over the number of cells of the whole table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squared, cells = 0.0, 0
        for batch in batches:
            x = window_batch(batch)
            if len(x):
                squared += float(((x - model.reconstruct(x)) ** 2).sum())
                cells += x.size
        yield pa.RecordBatch.from_arrays([pa.array([squared]), pa.array([cells])], names=["squared", "cells"])

    parts = windows.select("X").mapInArrow(work, "squared double, cells long")
    row = parts.agg(F.sum("squared").alias("squared"), F.sum("cells").alias("cells")).first()
    return (row["squared"] or 0.0) / max(row["cells"] or 0, 1)


KINDS = {cls.kind: cls for cls in (MeanProfile, PcaWindow, PcaLocal, DenseAutoencoder)}


def save(model, spark: SparkSession, path: str, name: str) -> None:
    """Write the weights as rows of a table partitioned by model name."""
    rows = [
        (model.kind, key, list(np.shape(value)), np.asarray(value, dtype=float).ravel().tolist())
        for key, value in model.weights().items()
    ]
    table = spark.createDataFrame(rows, WEIGHT_SCHEMA).coalesce(1)
    table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/model={name}")


def load(spark: SparkSession, path: str, name: str):
    rows = spark.read.parquet(path).where(F.col("model") == name).collect()
    if not rows:
        raise FileNotFoundError(f"no model {name!r} under {path}")
    weights = {r["name"]: np.array(r["values"], dtype=float).reshape(r["shape"]) for r in rows}
    return KINDS[rows[0]["kind"]].from_weights(weights)
