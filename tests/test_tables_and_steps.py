from __future__ import annotations

import hashlib
import json
import os
import subprocess
import sys

import numpy as np
import pytest
from checks import rows
from pyspark.sql import functions as F

from trajlens.models import MeanProfile, PcaWindow
from trajlens.operators import compare, lineage, windows
from trajlens.plans import PrepareConfig, evaluate, fit_and_threshold, prepare, profile
from trajlens.queries import QUERIES
from trajlens.roles import Roles
from trajlens.sources import TableSet, read_table
from trajlens.sources.metric_files import read_metrics
from trajlens.sources.sinks import append_rows, union_reports, write_report


# --- sources and sinks -----------------------------------------------------


def test_csv_is_read_with_header_and_types(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("vehicle_id,time_step,x\n1,1,0.5\n2,3,\n")
    assert read_table(spark, str(path)).dtypes == [("vehicle_id", "int"), ("time_step", "int"), ("x", "double")]
    given = read_table(spark, str(path), schema="vehicle_id string, time_step long, x float")
    assert rows(given) == [("1", 1, 0.5), ("2", 3, None)]


def test_table_set(spark, tmp_path):
    first, second = tmp_path / "raw", tmp_path / "other"
    first.mkdir(), second.mkdir()
    (first / "a.csv").write_text("vehicle_id,time_step\n1,1\n")
    (second / "b.csv").write_text("vehicle_id,time_step\n2,1\n")
    tables = TableSet(spark, {"train": "a.csv", "test": "b.csv", "labels": "c.csv"}, [str(first), str(second)])
    assert [(r[0], r[2]) for r in rows(tables.check(), "alias")] == [("labels", "MISSING"), ("test", "ALT"), ("train", "OK")]
    assert tables.missing() == {"labels": "c.csv"}
    assert tables.missing(allow_alternative=False) == {"test": "b.csv", "labels": "c.csv"}
    with pytest.raises(FileNotFoundError, match="c.csv"):
        tables.validate()
    assert sorted(tables.read_available()) == ["test", "train"]
    assert rows(tables.read("test")) == [(2, 1)] and rows(tables.read("a.csv")) == [(1, 1)]
    with pytest.raises(FileNotFoundError, match="labels|c.csv"):
        tables.read("labels")
    TableSet(spark, {"train": "a.csv"}, [str(first)]).validate()


def test_reports(spark, tmp_path):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, "z")], "x int, w string")
    assert union_reports([a, b]).columns == ["x", "y", "w"]
    write_report([a, b], str(tmp_path / "report"))
    assert rows(read_table(spark, str(tmp_path / "report")), "x") == [(1, 2, None), (3, None, "z")]
    append_rows(a, str(tmp_path / "results"))
    append_rows(a, str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 2


def test_metric_files(spark, tmp_path):
    def put(run, name, text):
        folder = tmp_path / "runs" / run / "metrics"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    def record(model, ap, level="vehicle"):
        return json.dumps({"model": model, "split": "test", "level": level, "pr_auc": ap, "f1_score": ap, "extra": 1}, indent=2)

    put("debug_025", "a_test_vehicle_metrics.json", record("a", 0.5))
    put("debug_025", "b_test_vehicle_metrics.json", record("b", 0.6))
    put("full", "a_test_vehicle_metrics.json", record("a", 0.9))
    put("full", "b_test_vehicle_metrics.json", "{ broken")
    put("full", "w_metrics.json", record("w", 1.0, level="window_descriptive"))
    found = read_metrics(spark, str(tmp_path / "runs"))
    assert rows(found.select("run_name", "model", "debug_entities", "pr_auc"), "run_name", "model") == [
        ("debug_025", "a", 25, 0.5), ("debug_025", "b", 25, 0.6), ("full", "a", None, 0.9)
    ]
    assert [r[2] for r in rows(compare.study_summary(found))] == ["b", "a"]
    assert {tuple(r["other_keys"].items()) for r in found.collect()} == {(("extra", "1"),)}


# --- lineage ---------------------------------------------------------------


def test_inventory_and_hashes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.PNG").write_bytes(b"abc")
    (tmp_path / "b.json").write_bytes(b"{}")
    files = lineage.inventory(spark, str(tmp_path))
    assert rows(files, "relative_path") == [("b.json", "", 2, ".json"), ("sub/A.PNG", "sub", 3, ".png")]
    assert rows(lineage.inventory_counts(files), "folder") == [("", ".json", 1, 2), ("sub", ".png", 1, 3)]
    hashes = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in lineage.file_hashes(spark, str(tmp_path)).collect()}
    assert hashes["A.PNG"] == hashlib.sha256(b"abc").hexdigest()


def test_tables_of_part_files_count_once(spark, tmp_path):
    """Part files of two tables with one name and size are no pair, and a table of several files is one table."""
    for name in ("a.parquet", "b.parquet"):
        (tmp_path / name).mkdir()
        for part in ("part-0.parquet", "part-1.parquet"):
            (tmp_path / name / part).write_bytes(b"same")
    (tmp_path / "c.parquet").write_bytes(b"other")
    assert rows(QUERIES["file_sizes_and_kinds"](spark, str(tmp_path))) == [(".parquet", 3)]


def test_tables_count_by_the_digests_of_their_files(spark, tmp_path, monkeypatch):
    """Contents are read, as rows and streamed, and a table with a file without a digest of its own bytes is left out."""
    (tmp_path / "a.parquet").mkdir()
    for path in ("a.parquet/part-0.parquet", "a.parquet/part-1.parquet", "b.parquet", "c.csv"):
        (tmp_path / path).write_bytes(path.encode())
    found, name = QUERIES["file_sizes_and_kinds"], "spark.sql.sources.binaryFile.maxLength"
    whole = [(".csv", 1), (".parquet", 2)]
    assert rows(found(spark, str(tmp_path)), "suffix") == whole
    spark.conf.set(name, "4")
    try:
        with pytest.raises(Exception, match="FAILED_READ_FILE"):
            found(spark, str(tmp_path)).collect()
        with monkeypatch.context() as patch:
            patch.setattr(lineage, "MAX_FILE_BYTES", 3)
            assert rows(found(spark, str(tmp_path)), "suffix") == whole
    finally:
        spark.conf.unset(name)
    hashes, last = lineage.file_hashes, F.col("path").endswith("part-1.parquet")
    for digest in (F.lit(None).cast("string"), F.lit("0" * 63), F.lit(hashlib.sha256(b"").hexdigest())):
        monkeypatch.setattr(lineage, "file_hashes", lambda *of: hashes(*of).withColumn("sha256", F.when(last, digest).otherwise(F.col("sha256"))))
        assert rows(found(spark, str(tmp_path)), "suffix") == [(".csv", 1), (".parquet", 1)]
    for changed in (lambda h: h.where(~last), lambda h: h.union(h.where(last))):
        monkeypatch.setattr(lineage, "file_hashes", lambda *of: changed(hashes(*of)))
        assert rows(found(spark, str(tmp_path)), "suffix") == [(".csv", 1), (".parquet", 1)]


def test_large_files_are_streamed(spark, tmp_path, monkeypatch):
    """Files above the limit, one of them sparse and above 2 GB, give the same digests as ``hashlib``."""
    data = {"a.bin": b"12345" * 1000, "b 1.bin": b"ab"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    size = (2 << 30) + 17
    with open(tmp_path / "sparse.bin", "wb") as out:
        out.truncate(size)
    monkeypatch.setattr(lineage, "MAX_FILE_BYTES", 3)
    found = {r["path"].rsplit("/", 1)[1].replace("%20", " "): (r["size_bytes"], r["sha256"]) for r in lineage.file_hashes(spark, str(tmp_path)).collect()}
    digest, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        digest.update(block)
    digest.update(bytes(size % (1 << 20)))
    assert found == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items()} | {"sparse.bin": (size, digest.hexdigest())}


def test_an_unchanged_table_is_verified_without_reading_it(spark, tmp_path, monkeypatch):
    path, manifest, settings = str(tmp_path / "t"), str(tmp_path / "m"), {"a": 1}
    spark.range(100).withColumn("v", F.col("id") * 2).repartition(4).write.parquet(path)
    written = lineage.write_preparation(spark.read.parquet(path), manifest, "full", "t", settings)
    with monkeypatch.context() as patch:
        patch.setattr(lineage, "content_hash", lambda df: pytest.fail("the table was read"))
        assert lineage.validate_preparation(spark.read.parquet(path), manifest, "full", "t", settings) == written
        with pytest.raises(RuntimeError, match="prepared for this run"):
            lineage.validate_preparation(spark.read.parquet(path), manifest, "full", "t", {"a": 2})
    # A filter on the files is another table, and is read.
    with pytest.raises(RuntimeError):
        lineage.validate_preparation(spark.read.parquet(path).where("id < 50"), manifest, "full", "t", settings)
    # New times and the same content: hashed once, then known again.
    files = sorted(p for p in os.listdir(path) if p.endswith(".parquet"))
    os.utime(f"{path}/{files[1]}", (1, 1))
    assert lineage.validate_preparation(spark.read.parquet(path), manifest, "full", "t", settings) == written
    with monkeypatch.context() as patch:
        patch.setattr(lineage, "content_hash", lambda df: pytest.fail("the table was read"))
        assert lineage.validate_preparation(spark.read.parquet(path), manifest, "full", "t", settings) == written
    # One file with other rows is found and named.
    spark.range(7).withColumn("v", F.col("id")).coalesce(1).write.parquet(str(tmp_path / "other"))
    (other,) = (p for p in os.listdir(tmp_path / "other") if p.endswith(".parquet"))
    os.remove(f"{path}/.{files[2]}.crc")
    with open(tmp_path / "other" / other, "rb") as new, open(f"{path}/{files[2]}", "wb") as out:
        out.write(new.read())
    with pytest.raises(RuntimeError) as error:
        lineage.validate_preparation(spark.read.parquet(path), manifest, "full", "t", settings)
    assert [f for f in files if f in str(error.value)] == [files[2]] and "changed: " in str(error.value)


def test_window_facts_come_from_the_write(spark, tmp_path, monkeypatch):
    """One job writes the table; its summary and fingerprint start no other that reads it."""
    rows_ = spark.range(400).selectExpr("CAST(id % 7 AS INT) AS e", "CAST(id / 7 AS INT) AS t", "sin(id) AS f", "cos(id) AS g")
    built = windows.build_windows(rows_, ["f", "g"], "e", "t", size=10, stride=3)
    path, manifest = str(tmp_path / "w"), str(tmp_path / "m")
    monkeypatch.setattr(windows, "read_windows", lambda *a: pytest.fail("the table was read back"))
    stored = windows.store_windows(built, path, "e", files=3)
    again = spark.read.parquet(path)
    assert (stored.n_windows, stored.content_hash) == tuple(lineage.content_hash(again).first())
    assert (stored.n_entities, stored.window_size, stored.n_features) == (again.select("e").distinct().count(), 10, 2)
    with monkeypatch.context() as patch:
        patch.setattr(lineage, "content_hash", lambda df: pytest.fail("the table was read"))
        written = lineage.write_preparation(again, manifest, "full", "w", {}, (stored.n_windows, stored.content_hash))
        assert lineage.validate_preparation(again, manifest, "full", "w", {}) == written


def test_no_task_writes_a_share_that_grows(spark, tmp_path):
    """Shares above Spark's advisory size are split, so that two wanted files become several; rows and facts stay."""
    rows_ = spark.range(0, 20_000, 1, 8).selectExpr("CAST(id % 70 AS INT) AS e", "id AS t", "sin(id) AS f")
    built = windows.build_windows(rows_, ["f"], "e", "t", size=30, stride=2)
    plain = windows.store_windows(built.repartition(16), str(tmp_path / "plain"), "e")
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, "64KB")
    try:
        stored = windows.store_windows(built.repartition(16), str(tmp_path / "w"), "e", files=2)
    finally:
        spark.conf.unset(name)
    assert sum(p.endswith(".parquet") for p in os.listdir(tmp_path / "w")) > 2
    assert (stored.n_windows, stored.n_entities, stored.content_hash) == (plain.n_windows, 70, plain.content_hash)


def test_repeated_appends_change_nothing(spark, tmp_path):
    first = spark.createDataFrame([("r1", "a", 1.0), ("r1", "b", 2.0)], "run_name string, model string, f1 double")
    other = spark.createDataFrame([("r2", "a", 3.0)], first.schema)
    for arguments in ({"partition_by": ["run_name"]}, {"key": ["run_name", "model"]}):
        path = str(tmp_path / next(iter(arguments)))
        for df in (first, other, first, other, first):
            append_rows(df, path, **arguments)
        found = spark.read.parquet(path).select("run_name", "model", "f1")
        assert rows(found, "run_name", "model") == [("r1", "a", 1.0), ("r1", "b", 2.0), ("r2", "a", 3.0)]
    append_rows(first.withColumn("f1", F.lit(9.0)), str(tmp_path / "partition_by"), partition_by=["run_name"])
    assert spark.read.parquet(str(tmp_path / "partition_by")).agg(F.sum("f1")).first()[0] == 21.0


def test_fingerprint_follows_content_and_settings(spark):
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    base = {"max_entities": 25, "window_size": 30}
    def digest(df, run="debug_025", settings=base):
        return lineage.fingerprint(df, run, "windows", settings).first()["fingerprint"]
    assert digest(df) == digest(df.repartition(7).select("v", "id"))
    assert digest(df) != digest(df, settings={**base, "max_entities": 50})
    assert digest(df) != digest(df, run="debug_050")
    assert digest(df) != digest(df.union(df.limit(1)))
    assert lineage.settings_digest({"b": 1, "a": 2}) == lineage.settings_digest({"a": 2, "b": 1})


def test_no_row_holds_a_large_file(spark, tmp_path):
    """Files of a mounted folder are streamed from 64 MB on; Spark may not read contents above that here."""
    size, name = (64 << 20) + 5, "spark.sql.sources.binaryFile.maxLength"
    with open(tmp_path / "sparse.bin", "wb") as out:
        out.truncate(size)
    (tmp_path / "small.bin").write_bytes(b"abc")
    spark.conf.set(name, str(64 << 20))
    try:
        found = {r["size_bytes"]: r["sha256"] for r in lineage.file_hashes(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(name)
    assert found == {size: hashlib.sha256(bytes(size)).hexdigest(), 3: hashlib.sha256(b"abc").hexdigest()}


def test_preparation_is_checked(spark, tmp_path):
    df, settings = spark.range(5), {"max_entities": 25}
    manifest = str(tmp_path / "manifest")
    with pytest.raises(FileNotFoundError):
        lineage.validate_preparation(df, manifest, "debug_025", "windows", settings)
    written = lineage.write_preparation(df, manifest, "debug_025", "windows", settings)
    assert lineage.validate_preparation(df, manifest, "debug_025", "windows", settings) == written
    with pytest.raises(RuntimeError, match="debug_050"):
        lineage.validate_preparation(df, manifest, "debug_050", "windows", settings)
    with pytest.raises(RuntimeError, match=written):
        lineage.validate_preparation(spark.range(6), manifest, "debug_025", "windows", settings)
    with pytest.raises(FileNotFoundError):
        lineage.validate_preparation(df, manifest, "debug_025", "other", settings)


# --- steps -----------------------------------------------------------------


@pytest.fixture(scope="module")
def study(spark):
    """Entities 0..29 with 20 steps; every third one drifts, and it is labelled so."""
    steps = spark.range(30 * 20).select(
        (F.col("id") % 30).cast("int").alias("vehicle_id"), F.floor(F.col("id") / 30).cast("int").alias("time_step")
    )
    drift = F.when(F.col("vehicle_id") % 3 == 0, F.col("time_step") * 0.5).otherwise(0.0)
    wave = F.sin(F.col("time_step") + F.col("vehicle_id"))
    readouts = steps.withColumn("a", wave + drift).withColumn("b", F.when(F.col("time_step") % 7 != 0, -wave)).withColumn("c", F.lit(1.0))
    ids = spark.range(30).select(F.col("id").cast("int").alias("vehicle_id"))
    tte = ids.withColumn("in_study_repair", (F.col("vehicle_id") % 3 == 0).cast("int"))
    known = ids.withColumn("class_label", F.when(F.col("vehicle_id") % 3 == 0, 4).otherwise(0))
    return readouts.checkpoint(), tte, known


CONFIG = PrepareConfig(window_size=8, stride=4)


def test_whole_study(spark, study, tmp_path):
    readouts, tte, known = study
    out = str(tmp_path / "out")
    prepared = prepare(readouts, readouts, readouts, tte, known, known, Roles(), CONFIG, out, "debug_030")
    assert prepared.fitted.source_columns == ["a", "b"]
    assert rows(prepared.summary("vehicle_id"), "split") == [("test", 120, 30), ("train", 80, 20), ("validation", 120, 30)]
    from dataclasses import asdict

    lineage.validate_preparation(
        prepared.windows["train"], f"{out}/manifest", "debug_030", "windows/train", asdict(CONFIG)
    )
    models, limits = fit_and_threshold(
        {"mean_profile": MeanProfile.fit, "pca_window": lambda w: PcaWindow.fit(w, 3)},
        prepared.windows["validation"], "vehicle_id", train_windows=prepared.windows["train"], out_dir=out,
        manifest=prepared.manifest,
    )
    with pytest.raises(RuntimeError, match="was not prepared for this run"):
        evaluate(models, limits, prepared.windows["train"], "vehicle_id", manifest=prepared.manifest)
    assert limits.columns == ["model", "threshold", "score_col", "selection_split", "selection_level", "training_time_seconds"]
    result = evaluate(models, limits, prepared.windows["test"], "vehicle_id", out_dir=out, manifest=prepared.manifest)
    measured = {r["model"]: r for r in result.metrics.collect()}
    assert measured["mean_profile"]["f1_score"] == 1.0 and measured["mean_profile"]["roc_auc"] == 1.0
    assert all(m["inference_time_seconds"] >= 0 for m in measured.values()) and measured["pca_window"]["split"] == "test"
    assert result.window_predictions.count() == 240 and result.entity_predictions.count() == 60
    assert rows(result.window_summary.select("model", "n_windows", "n_entities"), "model") == [("mean_profile", 120, 30), ("pca_window", 120, 30)]
    compared = compare.run_comparison(result.metrics, limits.select("model"))
    assert compared.where("best_by_pr_auc").count() == 1


def test_three_models_are_scored_in_one_pass(spark, study, tmp_path):
    """The windows are evaluated once, whatever the number of models, and each model has its time."""
    seen = spark.sparkContext.accumulator(0)
    built = windows.build_windows(study[0].select("vehicle_id", "time_step", "a"), ["a"], "vehicle_id", "time_step", size=8, stride=4)
    built = built.withColumn("y_true", (F.col("vehicle_id") % 3 == 0).cast("int"))

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    models = {f"m{i}": MeanProfile(np.full((8, 1), float(i))) for i in range(3)}
    limits = spark.createDataFrame([(m, 1.0, 0.5) for m in models], "model string, threshold double, training_time_seconds double")
    result = evaluate(models, limits, built.mapInArrow(count, built.schema), "vehicle_id")
    assert result.metrics.count() == 3 and seen.value == built.count()
    assert result.metrics.where("inference_time_seconds IS NULL").isEmpty()


def test_sized_study_keeps_the_lowest_ids(study):
    readouts, tte, known = study
    prepared = prepare(
        readouts, readouts, readouts, tte, known, known, Roles(), PrepareConfig(max_entities=6, window_size=8, stride=4)
    )
    ids = {s: sorted({r[0] for r in rows(w.select("vehicle_id"))}) for s, w in prepared.windows.items()}
    assert ids["train"] == [1, 2, 4, 5, 7, 8]
    assert ids["validation"] == ids["test"] == [0, 1, 2, 3, 4, 5]


def test_undefined_score_is_refused(study):
    with pytest.raises(ValueError, match="undefined"):
        fit_and_threshold({}, study[0], "vehicle_id", score_col="outlier_window_ratio")


def test_profile_reports(study):
    readouts, tte, known = study
    tables = {"train": readouts, "tte": tte, "labels": known}
    label_tables = {"tte": "in_study_repair", "labels": "class_label"}
    full = profile(tables, Roles(), ["train"], label_tables, feature_table="train", exact=True)
    assert set(full) == {
        "schema", "shape", "missing", "gaps", "lengths", "classes", "binary", "label_summary",
        "histograms", "boxplots", "correlation", "records_per_entity",
    }
    assert rows(full["lengths"].select("source", "n_entities", "mean_records")) == [("train", 30, 20.0)]
    assert rows(full["classes"], "class_label") == [("labels", 0, 20), ("labels", 4, 10)]
    cheap = profile(tables, Roles(), ["train"], label_tables, cheap=True)
    assert "gaps" not in cheap and {r["source"] for r in cheap["missing"].collect()} == {"tte", "labels"}


def test_entry_runs_from_an_empty_folder_without_a_path(tmp_path):
    """Workers must not need to import the package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import importlib.util as u, pyspark.sql as s;"
        f"m = u.spec_from_file_location('entry', {root + '/__spark_entry__.py'!r}); e = u.module_from_spec(m); m.loader.exec_module(e);"
        "spark = s.SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate();"
        "print('ROWS', e.entry(spark).count())"
    )
    environment = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert "ROWS 10" in done.stdout, done.stderr[-2000:]
