"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon is learned from labelled texts: whole words and word beginnings that
occur far more often in toxic than in clean texts. Features are densities of the
lexicon, how near its words stand to a second person, rates of capitals and
punctuation, and rates of disguised words (digits and signs inside a word),
also after undoing the disguise. Trees are fitted on a part of the training rows,
the calibration on the rest.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import releasing, remainder, stored, text_key

# Bound of the fit: expected labelled rows used.
FIT_ROWS = 40_000
# An entry occurs in so many different toxic texts, however many there are, and is this many times as frequent there.
MIN_DOCS, MIN_RATIO = 5, 25.0
STEMS = (4, 5, 6)
NEAR = 5
TREES, DEPTH = 20, 4

WORDS = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"\b[^\W\d_]+(?:[0-9@$*!|.\-_]+[^\W\d_]+)+|\b[^\W\d_]*[0-9@$]+[^\W\d_]+")
REPEATED = re.compile(r"([^\W\d_])\1{2,}")
# Signs that stand for letters, and second-person words of the usual languages (fixed values).
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": "", ".": "", "-": "", "_": ""})
SECOND_PERSON = frozenset(
    "you your yours yourself ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre usted ustedes tú ti tus vos".split()
)
FEATURES = (
    "word_density stem_density weight_density hits distinct_hits second_person near_second_person capitals capital_words"
    " exclamations questions punctuation disguised disguised_hits repeated_letters words word_length"
).split()


def units_of(word: str) -> list[str]:
    """The lexicon entries a word may match: itself, and its beginnings (marked by a star)."""
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]]


def learn_lexicon(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> dict[str, float]:
    """Entries and their log odds, from the different texts in which each occurs.

    The least number of texts doesn't rise with the labels, so the words of a small
    language or of an unusual insult are learned as soon as enough texts hold them.
    """
    rows = labelled.select(F.col(text_col).cast("string"), (F.col(label_col) > 0).cast("int")).distinct()

    def count(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for unit in {u for w in set(WORDS.findall((text or "").lower())) for u in units_of(w)}:
                    found.setdefault(unit, [0, 0])[toxic] += 1
            units = list(found)
            for at in range(0, len(units), 100_000):
                part = units[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), *[pa.array([found[u][i] for u in part], pa.int64()) for i in (0, 1)]],
                    names=["unit", "clean", "toxic"],
                )

    sizes = rows.groupBy(rows.columns[1]).count().collect()
    size = {r[0]: r[1] for r in sizes}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    kept = (
        rows.mapInArrow(releasing(count), "unit string, clean long, toxic long")
        .groupBy("unit")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= MIN_DOCS)
        .where(ratio >= MIN_RATIO)
        .select("unit", F.log(ratio))
        .collect()
    )
    return {unit: weight for unit, weight in kept}


class TextFeatures:
    """The dense features of a text, given a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple[int, float]] = {}

    def _match(self, word: str) -> tuple[int, float]:
        """How a word matches (0 not, 1 by its beginning, 2 as a word) and the weight."""
        match = (0, 0.0)
        for unit in units_of(word)[::-1]:
            if unit in self.lexicon:
                match = (2 if unit == word else 1, self.lexicon[unit])
        if len(self.known) >= 300_000:
            self.known.clear()
        self.known[word] = match
        return match

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        spelled = WORDS.findall(text)
        words = [w.lower() for w in spelled]
        known = self.known
        matches = [known.get(w) or self._match(w) for w in words]
        hits = [i for i, m in enumerate(matches) if m[0]]
        n, chars = max(1, len(words)), max(1, len(raw))
        spoken = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = len(np.intersect1d(np.add.outer(spoken, np.arange(-NEAR, NEAR + 1)).ravel(), hits)) if spoken and hits else 0
        disguised = DISGUISED.findall(text)
        undone = sum(self._match(d.lower().translate(PLAIN))[0] > 0 for d in disguised)
        capitals = int(((raw >= 65) & (raw <= 90)).sum())
        signs = int(((raw > 32) & (raw < 48) | (raw > 57) & (raw < 65) | (raw > 90) & (raw < 97) | (raw > 122) & (raw < 127)).sum())
        return [
            sum(matches[i][0] == 2 for i in hits) / n,
            sum(matches[i][0] == 1 for i in hits) / n,
            sum(matches[i][1] for i in hits) / n,
            math.log1p(len(hits)),
            math.log1p(len({words[i] for i in hits})),
            len(spoken) / n,
            near / n,
            capitals / chars,
            sum(len(w) > 1 and w.isupper() for w in spelled) / n,
            text.count("!") / chars,
            text.count("?") / chars,
            signs / chars,
            len(disguised) / n,
            undone / n,
            len(REPEATED.findall(text)) / n,
            math.log1p(len(words)),
            sum(map(len, words)) / n,
        ]


def text_features(docs: DataFrame, lexicon: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, features array<double>)`` per row, over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    source = docs.select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text")
    )

    def compute(batches):
        features = TextFeatures(shared.value)
        for batch in batches:
            rows = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))],
                names=["doc_id", "text_key", "features"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(releasing(compute), f"doc_id {kind}, text_key long, features array<double>")


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """One row per input row: ``(doc_id, text_key, score, predicted)``; 1 is predicted from a score of 0.5 on.

    ``labels`` holds ``(doc_id, toxic)`` of the rows to learn from. Of these, about
    ``fit_rows`` are used, drawn by a hash of the id; ids that repeat count once, as
    toxic if any label says so, and null labels or ids are ignored. Labels decide
    what is learned and never enter a feature.

    * Null or empty text: scored like any other, on features that are all zero.
    * No labels, or labels of one kind only: every score is 0.
    * Null id and repeated rows: passed on, one result per row. Empty table: empty result. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = (
        labels.select(F.col(labels.columns[0]).alias("doc_id"), F.col(labels.columns[1]).cast("double").alias("label"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    share = min(1.0, fit_rows / max(1, known.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = known.where(drawn < share).limit(2 * fit_rows)  # so the broadcast side has a bound
    training = stored(source.join(F.broadcast(chosen), "doc_id"))
    sizes = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return source.select("doc_id", text_key(F.col("text")).alias("text_key"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    lexicon = learn_lexicon(training)
    vector = array_to_vector("features")
    fitted = stored(
        text_features(training.select("doc_id", "text"), lexicon)
        .join(training.select("doc_id", "label").distinct(), "doc_id")
        .select("doc_id", "label", "features")
    ).withColumn("features", vector)
    part = remainder(F.col("doc_id"), 7) < 2
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=3, minInstancesPerNode=3)
    to_fit = fitted.where(~part)
    if to_fit.select("label").distinct().count() < 2:
        to_fit = fitted
    model = trees.fit(to_fit)
    raw = lambda df: model.transform(df).withColumn("raw", vector_to_array("probability")[1])
    held = raw(fitted.where(part)).select("raw", "label")
    if held.select("label").distinct().count() < 2:
        held = raw(fitted).select("raw", "label")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(held)
    scored = calibration.transform(raw(text_features(source, lexicon).withColumn("features", vector)))
    score = F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", "text_key", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
