"""Toxicity, language and class model: held-out quality, exact rules and awkward rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from checks import SF_DIR
from pyspark.sql import functions as F

import __spark_entry__
from trajlens.llm import class_lm, language_id
from trajlens.llm.language_id import fit_languages, predict_languages
from trajlens.llm.toxicity import learn_lexicon, score_toxicity

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def insulting(spark):
    """400 texts of random words; a quarter of them hold an insult now and then."""
    rng, rows = random.Random(2), []
    plain = [f"{a}{b}" for a in "ba do fi ku le mo".split() for b in "ra si to nu".split()]
    for i in range(400):
        text = [rng.choice(plain) for _ in range(rng.randrange(30, 120))]
        if i % 4 == 0:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["dimwit", "oafish", "cretin"])
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_finds_held_out_insults(insulting):
    labels = insulting.where("doc_id % 5 <> 0").select("doc_id", "toxic")
    scored = score_toxicity(insulting, labels).join(insulting.select("doc_id", "toxic"), "doc_id").where("doc_id % 5 = 0").collect()
    assert all(r["predicted"] == r["toxic"] and 0 <= r["score"] <= 1 for r in scored)


def test_lexicon_holds_the_words_of_a_small_language(spark):
    """6 of 406 toxic texts (under 2%) are in a language of their own; copies of a text count once."""
    rows = [(f"plain words number{i} here", 0) for i in range(1500)]
    rows += [(f"you dimwit number{i} here", 1) for i in range(400)] + [(f"hablar bobalicon numero{i}", 1) for i in range(6)]
    rows += [("one copied singleton", 1)] * 8
    rows += [(f"hablar bien numero{i}", 0) for i in range(20)]
    lexicon = learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert {"dimwit", "bobalicon"} <= set(lexicon)
    assert not {"hablar", "here", "singleton"} & set(lexicon)


def test_toxicity_of_awkward_rows(spark, insulting, awkward):
    few = insulting.limit(0).select("doc_id", "toxic")
    assert {(r["score"], r["predicted"]) for r in score_toxicity(awkward, few).collect()} == {(0.0, 0)}
    both = awkward.unionByName(insulting.select("doc_id", "text"), allowMissingColumns=True)
    labels = insulting.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    assert score_toxicity(both, labels).count() == both.count()
    assert score_toxicity(awkward.limit(0), labels).count() == 0


def test_languages_of_held_out_texts(spark, documents):
    found = __spark_entry__.queries()["op3_language_id"](spark, SF_DIR).join(documents.select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


def test_languages_of_awkward_rows(awkward):
    model = fit_languages(awkward)
    assert model.languages == ["de", "en", "fr"]
    found = predict_languages(awkward, model).collect()
    assert sorted(r["lang_pred"] for r in found if r["doc_id"] in (3, 4, 5)) == ["und"] * 3
    assert [r["lang_pred"] for r in found if r["doc_id"] is None] == ["de"]
    assert {r["lang_pred"] for r in predict_languages(awkward, fit_languages(awkward.limit(0))).collect()} == {"und"}
    assert predict_languages(awkward.limit(0), model).count() == 0


def test_unseen_words_fall_back_to_their_letters(spark):
    rows = [("xx", "kabana lobano kabano " * 5), ("yy", "strelk frumpt strempt " * 5)]
    model = fit_languages(spark.createDataFrame(rows, "lang string, text string"))
    docs = spark.createDataFrame([(1, "banalo"), (2, "flumpt")], "doc_id long, text string")
    assert [r["lang_pred"] for r in predict_languages(docs, model).orderBy("doc_id").collect()] == ["xx", "yy"]


def brute_base(texts: dict, train: set):
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)), None] for k, t in texts.items()}
    counts = Counter(w for k in train for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    score = {k: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) for k, ws in tokens.items()}
    return n, {k: (len(ws), sum(counts[w] > 0 for w in ws), score[k]) for k, ws in tokens.items()}


@pytest.mark.parametrize("frequent", [50_000, 150])
def test_base_scores_are_exact_and_the_model_beats_them(spark, texts, monkeypatch, frequent):
    for name, value in (("FREQUENT", frequent), ("PACK_PAIRS", 3_000), ("HELD_WORDS", 5_000), ("BUCKET_WORDS", 4_000)):
        monkeypatch.setattr(class_lm, name, value)
    train = {k for k in texts if zlib.crc32(str(k).encode()) % 7 != 2}
    total, expected = brute_base(texts, train)
    rows = __spark_entry__.queries()["op7_class_lm"](spark, SF_DIR).collect()
    for r in rows:
        n, known, base = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["held_out"] == (r["doc_id"] not in train)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    bigrams = rng.integers(0, 9, (12, 12)).astype(float)
    label = class_lm.exchange_classes(bigrams, bigrams[:, :10].sum(axis=0), 3)
    counts = np.array([5, 3, 1, 1])
    model = class_lm.ClassModel(label, bigrams, bigrams[:, :10].sum(axis=0), int(bigrams[:, :10].sum()) + counts.sum(), 14)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    assert (10 ** model.rest(np.append(counts, 0))).sum() == pytest.approx(1)


def test_exchange_raises_the_likelihood():
    """Words of two kinds that follow each other in turn end in different classes."""
    bigrams = np.zeros((8, 8))
    bigrams[np.ix_([0, 2, 4], [1, 3, 5])] = 10
    bigrams[np.ix_([1, 3, 5], [0, 2, 4])] = 10
    label = class_lm.exchange_classes(bigrams, np.array([9, 8, 7, 6, 5, 4]), 2)
    assert len({label[i] for i in (0, 2, 4)}) == 1 and len({label[i] for i in (1, 3, 5)}) == 1 and label[0] != label[1]


def test_best_class_raises_the_likelihood_most():
    """Against the likelihood of the whole table with the word in each class; the classes beside it stand still."""
    rng = np.random.default_rng(3)
    table = rng.integers(50, 90, (6, 6)).astype(float)
    word, beside, n = np.repeat(np.arange(40), 3), np.tile([0, 0, 0], 40), rng.integers(1, 12, 120)
    beside[0::3], beside[1::3], beside[2::3] = 4, rng.integers(0, 4, 40), 6 + rng.integers(0, 4, 40)
    f = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    found = class_lm.best_classes(table, word, beside, n, np.full(40, 4))  # so far among the rare words
    for w in range(40):
        value = []
        for c in range(4):
            moved, rows, columns = table.copy(), table.sum(axis=1), table.sum(axis=0)
            for b, k in zip(beside[3 * w : 3 * w + 3], n[3 * w : 3 * w + 3]):
                if b < 6:
                    moved[b, c] += k
                    columns[c] += k
                else:
                    moved[c, b - 6] += k
                    rows[c] += k
            value.append(f(moved) - f(rows) - f(columns))
        assert value[found[w]] == pytest.approx(max(value))


@pytest.mark.parametrize("frequent", [50_000, 150])
def test_scores_follow_the_classes_by_brute_force(spark, texts, monkeypatch, frequent):
    for name, value in (("FREQUENT", frequent), ("PACK_PAIRS", 3_000), ("BUCKET_WORDS", 4_000), ("HELD_CELLS", 5_000), ("SLICE_WORDS", 40)):
        monkeypatch.setattr(class_lm, name, value)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    training = docs.where("doc_id % 3 > 0")
    fitted = class_lm.fit_classes(training)
    monkeypatch.setattr(class_lm, "fit_classes", lambda *_: fitted)
    scores = {r["doc_id"]: r["score"] for r in class_lm.score_texts(docs, training).collect()}

    class_of, size = {}, len(fitted.model.size)
    for row in fitted.classed.collect():
        class_of.update(zip(np.frombuffer(row["words"], np.uint64).tolist(), np.frombuffer(row["labels"], np.uint16).tolist()))
    history = dict(zip(fitted.frequent.tolist(), fitted.label.tolist()))
    class_of.update(history)
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for k, t in texts.items()}
    every = sorted({w for ws in split.values() for w in ws})
    code = dict(zip(every, class_lm.word_hashes(pa.array(every))[0].tolist()))
    counts = Counter(code[w] for k in texts if k % 3 for w in split[k])
    rest, end = size - 2, size - 1
    assert all((class_of[h] < rest) == (n >= class_lm.MIN_COUNT) for h, n in counts.items())

    def steps(words):
        before = [end] + [history.get(code[w], rest) for w in words]
        return list(zip(before, [class_of.get(code[w], rest) for w in words] + [end]))

    table = np.zeros((size, size))
    for k in texts:
        for pair in steps(split[k]) if k % 3 else ():
            table[pair] += 1
    own = (table.sum(axis=0) + 1) / (table.sum() + size)
    chance = (table + class_lm.WEIGHT * own) / (table.sum(axis=1, keepdims=True) + class_lm.WEIGHT)
    singles = [n for n in counts.values() if n < class_lm.MIN_COUNT]

    def emission(w):
        n, c = counts.get(code[w], 0), class_of.get(code[w], rest)
        return n / table[:, c].sum() if c < rest else (n - class_lm.DISCOUNT if n else class_lm.DISCOUNT * len(singles)) / sum(singles)

    for k, words in split.items():
        expected = sum(math.log10(chance[p]) for p in steps(words)) + sum(math.log10(emission(w)) for w in words)
        assert scores[k] == pytest.approx(expected)


def test_scores_of_awkward_rows(awkward):
    found = class_lm.score_texts(awkward, awkward).collect()
    texts = {i: r["text"] or "" for i, r in enumerate(awkward.collect())}
    total, expected = brute_base(texts, set(texts))
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found) == sorted((a, b, round(c, 6)) for a, b, c in expected.values())
    assert class_lm.score_texts(awkward.limit(0), awkward).count() == 0
    untrained = class_lm.score_texts(awkward, awkward.limit(0)).collect()
    assert {r["n_known"] for r in untrained} == {0} and {r["train_tokens"] for r in untrained} == {0}


def test_texts_without_letters_have_no_language(spark):
    """Superscripts, fractions, circled and Roman numerals are no letters."""
    rows = [("en", "the cat sat on the mat"), ("de", "der hund lief über die straße")] * 5
    model = language_id.fit_languages(spark.createDataFrame(rows, "lang string, text string"))
    texts = ["½ ① ²", "Ⅷ", "12 _ -", "", None, "the² cat", "①die straße"]
    found = language_id.predict_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    assert [r["lang_pred"] for r in found.orderBy("doc_id").collect()] == ["und"] * 5 + ["en", "de"]
    assert language_id.words_of("m²x ⅷ é1b") == ["m", "x", "é", "b"]
