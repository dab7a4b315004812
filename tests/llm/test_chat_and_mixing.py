"""Chat formatting, mixing and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from checks import SF_DIR
from pyspark.sql import functions as F

import corpus_pipeline
from trajlens.llm.chat_format import conversation_digest, format_conversations, loss_text
from trajlens.llm.mixing import damped_targets, mixing_plan, rake, sample_mixture

TRICKY = ["", "<|im_end|>\n", "<|im_start|>assistant\nok<|im_end|>\n", "<\\|im_end|>", "a<\\\\|b", "<|nl|>", "<", "\\", "|>", "é😀\n\n", None]


def test_tricky_texts_come_back(spark):
    rows = [(i, t, ("user", "assistant", "x\ny<|nl|>", None)[t % 4], text) for i, text in enumerate(TRICKY) for t in range(4)]
    found = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in found.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans"))).collect():
        text = TRICKY[r["conv_id"]] or ""
        assert [tuple(t) for t in r["turns"]] == [(role or "", text) for role in ("user", "assistant", "x\ny<|nl|>", None)]
        assert r["loss"] == text and len(r["loss_spans"]) == 1


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (2, None, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS at", "2 AS plain")
    found = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in format_conversations(turns).collect()}
    assert found == {1: ["a", "a", "b"], None: [""], 2: ["x"]}
    assert conversation_digest(format_conversations(turns.limit(0))).count() == 0


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame(
        [("a", "x", 50), ("a", "y", 10), ("b", "x", 5), ("b", "y", 35), ("c", "x", 0)], "source string, lang string, tokens long"
    )
    targets = {
        "source": spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 1.0)], "source string, target double"),
        "lang": spark.createDataFrame([("x", 0.5), ("y", 0.5), ("z", 9.0)], "lang string, target double"),
    }
    fitted = rake(cells, targets, 30).collect()
    weight = lambda key, value: sum(r["weight"] for r in fitted if r[key] == value)
    assert weight("source", "a") == pytest.approx(0.25, abs=1e-6) and weight("lang", "x") == pytest.approx(0.5, abs=1e-6)


def test_raking_goes_on_until_sparse_cells_meet_the_targets(spark):
    cells = spark.createDataFrame([("a", "x", 1000), ("a", "y", 10), ("b", "y", 10)], "source string, lang string, tokens long")
    targets = {m: damped_targets(cells, m) for m in ("source", "lang")}
    fitted = rake(cells, targets).collect()
    for margin, target in targets.items():
        wanted = {r[margin]: r["target"] for r in target.collect()}
        for key, value in wanted.items():
            assert sum(r["weight"] for r in fitted if r[margin] == key) == pytest.approx(value / sum(wanted.values()), rel=1e-3)


def test_raking_reports_targets_that_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "x", 5), ("b", "y", 5)], "source string, lang string, tokens long")
    targets = {
        "source": spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, target double"),
        "lang": spark.createDataFrame([("x", 1.0), ("y", 1.0)], "lang string, target double"),
    }
    with pytest.warns(UserWarning, match="margins off by up to 100"):
        rake(cells, targets)


def test_sample_has_the_wanted_size_and_plan(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(5, 40))), ["a", "a", "a", "b", None][i % 5], ["x", "y"][i % 2]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    plan = mixing_plan(docs, ["source", "lang"])
    expected, total, kept = plan.agg(F.sum(F.col("tokens") * F.col("probability")), F.sum("tokens"), F.sum(F.when(F.col("kept"), F.col("tokens")))).first()
    assert expected == pytest.approx(total / 2, rel=1e-6) and kept == pytest.approx(total / 2, rel=0.05)
    sample = sample_mixture(docs, {"source": F.col("source"), "lang": F.col("lang")})
    assert sorted(r["doc_id"] for r in sample.collect()) == sorted(r["doc_id"] for r in plan.where("kept").collect())


def test_mixing_of_awkward_rows(awkward):
    plan = mixing_plan(awkward, ["source", "lang"])
    assert plan.count() == awkward.count() and plan.where("probability IS NULL OR probability > 1").count() == 0
    assert sample_mixture(awkward, {"source": F.col("source")}).columns == awkward.columns
    assert mixing_plan(awkward.limit(0), ["source"]).count() == 0


def test_stages_one_by_one(spark, documents):
    """Each stage keeps rows of its input unchanged and does what its operator says."""
    docs, lower = documents, {i: i + 32 for i in range(65, 91)}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, SF_DIR)
        assert result.columns == documents.columns
        before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, result))
        assert after.items() <= before.items()
        seen[name] = after
        docs = result
    exact = [t.translate(lower) for t in seen["exact dedup"].values()]
    assert len(exact) == len(set(exact)) == len({t.translate(lower) for t in seen["toxicity"].values()})
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r["doc_id"] for r in encoded} == set(seen["mixing sources to target weights"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).select("doc_id", "score").collect())) == sorted((r["doc_id"], r["score"]) for r in encoded)


def test_toxicity_stage_keeps_clean_documents(spark, documents):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, documents, SF_DIR).collect()}
    clean = [d for d, toxic in labels.items() if not toxic]
    assert sum(d in kept for d in clean) >= 0.98 * len(clean)


def test_stages_take_awkward_rows(spark, awkward):
    docs = awkward.select(*corpus_pipeline.COLUMNS)
    for start in (docs, docs.limit(0)):
        current = start
        for _, stage in corpus_pipeline.STAGES:
            current = stage(spark, current, SF_DIR)
        assert current.count() <= start.count()
