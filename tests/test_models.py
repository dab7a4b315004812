from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from checks import rows
from pyspark.sql import functions as F

from trajlens.models.batches import window_batch
from trajlens.models import DenseAutoencoder, MeanProfile, PcaLocal, PcaWindow, Reconstructor, load, loss, save
from trajlens.models import reconstruct
from trajlens.models.reconstruct import _gradient, _layer_shapes
from trajlens.operators import scoring


@pytest.fixture(scope="module")
def windows(spark):
    """200 windows of 6 steps and 2 features with a common shape and noise."""
    rng = np.random.default_rng(3)
    base = np.sin(np.arange(6))[:, None] * np.array([1.0, -2.0])
    data = base + rng.normal(size=(200, 1, 1)) * np.array([0.5, 1.0]) + 0.1 * rng.normal(size=(200, 6, 2))
    table = [(f"w{i}", i % 9, 0, 5, (None if i % 2 else 1), m.tolist()) for i, m in enumerate(data)]
    schema = "window_id string, vehicle_id int, start_time_step int, end_time_step int, y_true int, X array<array<double>>"
    return spark.createDataFrame(table, schema).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def matrix(windows):
    return np.array([r["X"] for r in windows.orderBy("window_id").collect()])


def test_mean_profile(windows, matrix):
    model = MeanProfile.fit(windows)
    assert isinstance(model, Reconstructor)
    assert np.allclose(model.mean, matrix.mean(axis=0))
    scored = scoring.score_windows(windows, model, "vehicle_id").orderBy("window_id").collect()
    assert [r["outlier_score"] for r in scored] == pytest.approx(((matrix - matrix.mean(0)) ** 2).mean(axis=(1, 2)))
    assert {r["y_true"] for r in scored} == {1, -1}
    assert loss(windows, model) == pytest.approx(((matrix - matrix.mean(0)) ** 2).mean())


def test_pca_window_equals_svd(windows, matrix):
    flat = matrix.reshape(len(matrix), -1)
    centred = flat - flat.mean(0)
    top = np.linalg.svd(centred, full_matrices=False)[2][:3]
    expected = (centred @ top.T @ top + flat.mean(0)).reshape(matrix.shape)
    assert np.allclose(PcaWindow.fit(windows, k=3).reconstruct(matrix), expected, atol=1e-8)


def test_pca_local_equals_svd(windows, matrix):
    padded = np.pad(matrix, ((0, 0), (1, 1), (0, 0)))
    around = np.concatenate([padded[:, :-2], padded[:, 1:-1], padded[:, 2:]], axis=2).reshape(-1, 6)
    mean = around.mean(0)
    top = np.linalg.svd(around - mean, full_matrices=False)[2][:2]
    expected = ((around - mean) @ top.T @ top + mean)[:, 2:4].reshape(matrix.shape)
    assert np.allclose(PcaLocal.fit(windows, k=2).reconstruct(matrix), expected, atol=1e-8)


def low_rank_windows(spark, n, size, width, rank=6, parts=5):
    """Windows with ``rank`` main directions and noise, made in tasks; and a function of their numbers that gives the matrix."""
    shapes = np.random.default_rng(1).standard_normal((rank, size * width)) * 2.0 ** -np.arange(rank)[:, None]

    def matrix(numbers):
        rows = [np.random.default_rng(int(i)) for i in numbers]
        return np.array([r.standard_normal(rank) @ shapes + 0.05 * r.standard_normal(size * width) + 1.0 for r in rows])

    def make(batches):
        for batch in batches:
            x = matrix(batch.column(0).to_pylist())
            ends = lambda step, count: pa.array(np.arange(count + 1) * step, pa.int32())
            steps = pa.ListArray.from_arrays(ends(width, len(x) * size), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends(size, len(x)), steps)], names=["X"])

    return spark.range(0, n, 1, parts).mapInArrow(make, "X array<array<double>>"), matrix(range(n))


def subspace_angle(a, b):
    """Sine of the largest angle between the spans of two orthonormal bases."""
    return np.linalg.norm(a - b @ (b.T @ a), 2)


def test_block_power_iteration_equals_svd(spark):
    windows, x = low_rank_windows(spark, 300, 6, 20)
    mean = x.mean(axis=0)
    found = reconstruct.principal_directions(windows, reconstruct.whole_windows, mean, 4)
    expected = np.linalg.svd(x - mean, full_matrices=False)[2][:4].T
    assert found.shape == (120, 4) and subspace_angle(found, expected) < 1e-6
    assert np.allclose(found.T @ found, np.eye(4), atol=1e-10)


def test_pca_of_wide_windows(spark, monkeypatch):
    """5,000 cells a window: no matrix of 5,000 x 5,000 anywhere."""
    windows, x = low_rank_windows(spark, 120, 10, 500)
    model = PcaWindow.fit(windows, k=5)
    expected = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:5].T
    assert subspace_angle(model.directions, expected) < 1e-6
    small, _ = low_rank_windows(spark, 100, 6, 5)
    plain = PcaLocal.fit(small, k=3)
    monkeypatch.setattr(reconstruct, "DENSE_CELLS", 10)
    assert subspace_angle(PcaLocal.fit(small, k=3).directions, plain.directions) < 1e-6


def test_power_iteration_that_does_not_settle_warns(spark):
    windows, x = low_rank_windows(spark, 60, 4, 10)
    with pytest.warns(UserWarning, match="after 1 passes"):
        reconstruct.principal_directions(windows, reconstruct.whole_windows, x.mean(axis=0), 4, most_passes=1)


def test_training_does_not_depend_on_files(windows, spark, tmp_path):
    args = dict(hidden=6, latent=2, epochs=3, batch_size=8, learning_rate=0.01, entity="vehicle_id", buckets=4)
    fitted = []
    for files in (2, 7, 40):
        path = str(tmp_path / f"files{files}")
        windows.withColumn("_r", F.rand(files)).orderBy("_r").drop("_r").repartition(files).write.parquet(path)
        fitted.append(DenseAutoencoder.fit(spark.read.parquet(path), spark.read.parquet(path), **args))
    assert len(list((tmp_path / "files40").glob("*.parquet"))) == 40
    for other in fitted[1:]:
        assert np.array_equal(fitted[0].flat, other.flat) and fitted[0].train_loss == other.train_loss
    # Nor on how many windows travel in one batch.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = DenseAutoencoder.fit(windows, windows, **args)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.array_equal(fitted[0].flat, again.flat)


def test_a_lazy_input_is_trained_from_one_evaluation(windows, spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    lazy = windows.mapInArrow(count, windows.schema)
    DenseAutoencoder.fit(lazy, None, hidden=4, latent=2, epochs=3)
    assert seen.value == 200
    PcaWindow.fit(lazy, k=2)
    PcaLocal.fit(lazy, k=2)
    assert seen.value == 600


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    shapes = _layer_shapes(4, 3, 2)
    flat = rng.normal(size=sum(a * b + b for a, b in shapes))
    x = rng.normal(size=(5, 4))
    _, gradient = _gradient(x, flat, shapes)
    for i in range(0, len(flat), 5):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        slope = (_gradient(x, flat + step, shapes)[0] - _gradient(x, flat - step, shapes)[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, abs=1e-6)


def test_autoencoder_learns_and_repeats(windows, spark):
    args = dict(hidden=12, latent=3, epochs=8, batch_size=16, learning_rate=0.01, buckets=2)
    first = DenseAutoencoder.fit(windows, windows, **args)
    assert first.val_loss[-1] < 0.7 * first.val_loss[0] and len(first.train_loss) == 8
    second = DenseAutoencoder.fit(windows, windows, **args)
    assert first.train_loss == pytest.approx(second.train_loss, rel=1e-6)
    assert loss(windows, first) == pytest.approx(min(first.val_loss), rel=1e-9)
    marked = rows(first.history(spark).where("best").select("epoch"))
    assert marked == [(int(np.argmin(first.val_loss)) + 1,)]


def test_autoencoder_stops_early(windows):
    model = DenseAutoencoder.fit(windows, windows.where("false").union(windows.limit(5)), hidden=4, latent=1, epochs=30, learning_rate=5.0, patience=2, buckets=2)
    assert len(model.val_loss) < 30
    best = int(np.argmin(model.val_loss))
    assert len(model.val_loss) - 1 - best == 2


def test_without_validation_the_last_weights_are_kept(windows, matrix):
    model = DenseAutoencoder.fit(windows, None, hidden=8, latent=2, epochs=5, batch_size=16, learning_rate=0.01, buckets=2)
    assert model.val_loss == ()
    assert ((matrix - model.reconstruct(matrix)) ** 2).mean() < model.train_loss[0]


@pytest.mark.parametrize("kind", [MeanProfile, PcaWindow, PcaLocal])
def test_save_and_load(spark, windows, matrix, tmp_path, kind):
    model = kind.fit(windows)
    save(model, spark, str(tmp_path), "one")
    save(MeanProfile.fit(windows), spark, str(tmp_path), "two")
    again = load(spark, str(tmp_path), "one")
    assert type(again) is kind and np.array_equal(again.reconstruct(matrix), model.reconstruct(matrix))
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path), "three")


def test_save_and_load_autoencoder(spark, windows, matrix, tmp_path):
    model = DenseAutoencoder.fit(windows, windows, hidden=4, latent=2, epochs=2)
    save(model, spark, str(tmp_path), "ae")
    again = load(spark, str(tmp_path), "ae")
    assert np.array_equal(again.flat, model.flat) and again.val_loss == model.val_loss


def test_empty_window_table(windows):
    with pytest.raises(ValueError, match="empty"):
        MeanProfile.fit(windows.where("false"))


@pytest.mark.parametrize(
    "windows",
    [
        [[[1.0]] * 29, [[2.0]] * 31],
        [[[1.0, 2.0], [3.0]], [[4.0], [5.0, 6.0]]],
        [[[1.0]], None],
        [[[1.0], None]],
        [[[1.0], [None]]],
    ],
)
def test_uneven_batches_are_refused(windows):
    batch = pa.RecordBatch.from_arrays([pa.array(windows, pa.list_(pa.list_(pa.float64())))], names=["X"])
    with pytest.raises(ValueError):
        window_batch(batch)


def test_a_sliced_batch_keeps_its_windows():
    batch = pa.RecordBatch.from_arrays([pa.array([[[1.0], [2.0]], [[3.0], [4.0]], [[5.0], [6.0]]])], names=["X"])
    assert window_batch(batch.slice(1, 2)).tolist() == [[[3.0], [4.0]], [[5.0], [6.0]]]


def test_ragged_windows_are_refused(windows, spark):
    ragged = windows.withColumn("X", F.when(F.col("vehicle_id") == 1, F.slice("X", 1, 3)).otherwise(F.col("X")))
    model = MeanProfile(np.zeros((6, 2)))
    with pytest.raises(Exception, match="unequal shape"):
        scoring.score_windows(ragged.coalesce(1), model, "vehicle_id").collect()


def test_directions_come_from_whole_windows(spark, monkeypatch):
    """Scatter matrices are added up in the tasks; no window is cut into rows for MLlib. Directions as by a dense solver."""
    monkeypatch.setattr("pyspark.ml.feature.PCA.fit", lambda *a: pytest.fail("rows of steps were made"))
    x = np.random.default_rng(3).standard_normal((200, 6, 2)) * [1.0, 3.0]
    windows = spark.createDataFrame([(w.tolist(),) for w in x], "X array<array<double>>").repartition(5)
    for model, rows_of, k in ((PcaLocal.fit(windows, k=2), reconstruct.neighbourhoods, 2), (PcaWindow.fit(windows, k=3), reconstruct.whole_windows, 3)):
        cells = rows_of(x)
        mine = model.directions @ model.directions.T
        found = np.linalg.svd(cells - cells.mean(axis=0), full_matrices=False)[2][:k].T
        assert np.allclose(mine, found @ found.T, atol=1e-9) and np.allclose(model.mean, cells.mean(axis=0))
