"""Language identification by words first, then by ever shorter character n-grams.

A word that was seen in training scores its log frequency in each language. An
unseen word is covered by character n-grams: at every position the longest known
one that ends there, from four characters down to one, scores its log frequency.
The language with the highest sum over the whole text wins.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import stored

# Bounds of the fitted model: expected training rows of a language, known words and n-grams per language.
ROWS_PER_LANGUAGE, WORDS_PER_LANGUAGE, GRAMS_PER_LANGUAGE = 2_000, 40_000, 40_000
LANGUAGES, LONGEST_GRAM, MIN_COUNT = 500, 4, 2
# Words that one task remembers the scores of.
REMEMBERED = 300_000

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters. Digits such as the superscript two or the Roman numeral eight are none, though the pattern takes them."""
    if not text:
        return []
    words = LETTERS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [part for word in words for part in "".join(c if c.isalpha() else " " for c in word).split()]


def grams_at(word: str, end: int):
    """The n-grams of a word (with its border marks) that end at a position, longest first."""
    return (word[end - n : end] for n in range(min(LONGEST_GRAM, end), 0, -1))


def _counts(rows: DataFrame) -> DataFrame:
    """``(lang, kind, unit, n)``: words (kind 0) and n-grams (kind = their length) of ``(lang, text)`` rows."""

    def count(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text))
            out = Counter()
            for lang, words in found.items():
                for word, n in words.items():
                    out[lang, 0, word] += n
                    edged = f" {word} "
                    for end in range(1, len(edged) + 1):
                        for gram in grams_at(edged, end):
                            out[lang, len(gram), gram] += n
            keys = list(out)
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000]
                columns = [*map(list, zip(*part)), [out[k] for k in part]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                    names=["lang", "kind", "unit", "n"],
                )

    return (
        rows.mapInArrow(count, "lang string, kind int, unit string, n long")
        .groupBy("lang", "kind", "unit")
        .agg(F.sum("n").alias("n"))
    )


class LanguageModel:
    """Log frequencies of words and n-grams, a row per unit and a column per language."""

    def __init__(self, languages: list[str], words: dict[str, int], grams: dict[str, int], table: np.ndarray):
        self.languages, self.words, self.grams, self.table = languages, words, grams, table

    def plain(self) -> tuple:
        return self.languages, self.words, self.grams, self.table

    def word_scores(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        if at is not None:
            return self.table[at]
        edged, rows = f" {word} ", []
        for end in range(1, len(edged) + 1):
            for gram in grams_at(edged, end):
                at = self.grams.get(gram)
                if at is not None:
                    rows.append(at)
                    break
        return self.table[rows].sum(axis=0)


def fit_languages(
    rows: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    seed: int = 7,
) -> LanguageModel:
    """Fit on whole texts of a bounded sample: about ``rows_per_language`` rows of each language, drawn by text hash.

    Rows without a language or text are left out. An empty table gives a model without languages.
    """
    labelled = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    sizes = labelled.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return LanguageModel([], {}, {}, np.zeros((0, 0)))
    languages = sorted(r["lang"] for r in sizes)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, rows_per_language / r["count"]))])
    drawn = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = stored(_counts(labelled.where(drawn < share[F.col("lang")])))
    totals = {(r["lang"], r["kind"]): r["total"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("total")).collect()}
    # The most frequent units of each language; the threshold count comes from how many units have each count.
    known = counts.where(F.col("n") >= MIN_COUNT)
    spread = known.groupBy("lang", F.col("kind") > 0, F.floor(F.log2("n") * 8).alias("band")).agg(
        F.count(F.lit(1)).alias("units"), F.min("n").alias("least")
    )
    limits: dict[tuple[str, bool], int] = {}
    taken: Counter = Counter()
    for lang, is_gram, _, units, least in sorted(map(tuple, spread.collect()), key=lambda r: -r[2]):
        taken[lang, is_gram] += units
        if taken[lang, is_gram] <= (GRAMS_PER_LANGUAGE if is_gram else WORDS_PER_LANGUAGE):
            limits[lang, is_gram] = least
    floor = F.create_map(*[F.lit(x) for lang in languages for g in (False, True) for x in (f"{lang}\x00{g}".lower(), limits.get((lang, g), 1 << 62))])
    key = F.lower(F.concat(F.col("lang"), F.lit("\x00"), (F.col("kind") > 0).cast("string")))
    units = known.where(F.col("n") >= floor[key]).select("kind", "unit").distinct()
    kept = counts.join(units, ["kind", "unit"]).collect()
    words, grams, column = {}, {}, {lang: i for i, lang in enumerate(languages)}
    for r in kept:
        (grams if r["kind"] else words).setdefault(r["unit"], len(words) + len(grams))
    table = np.zeros((len(words) + len(grams), len(languages)))
    kinds = np.zeros(len(table), np.int64)
    for r in kept:
        at = (grams if r["kind"] else words)[r["unit"]]
        table[at, column[r["lang"]]], kinds[at] = r["n"], r["kind"]
    size = np.array([[totals.get((lang, k), 0) for lang in languages] for k in range(LONGEST_GRAM + 1)], float)
    variety = np.bincount(kinds, minlength=LONGEST_GRAM + 1)[:, None]
    table = np.log((table + 0.5) / (size + 0.5 * variety + 0.5)[kinds])
    return LanguageModel(languages, words, grams, table)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row, over whole texts; the score is the softmax of the summed scores.

    * Null text or text without letters, or a model without languages: ``und`` with score 0.
    * Ties: the language that sorts first. Null id and repeated rows: passed on, one result per row.
    * Empty table: empty result. Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def predict(batches):
        fitted = LanguageModel(*shared.value)
        languages = fitted.languages
        at: dict[str, int] = {}
        scores = np.zeros((REMEMBERED, max(1, len(languages))))

        def row(word: str) -> int:
            known = at[word] = len(at)
            scores[known] = fitted.word_scores(word)
            return known

        for batch in batches:
            found, sure = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text) if languages else []
                total = np.zeros(scores.shape[1])
                for begin in range(0, len(words), 50_000):
                    part = words[begin : begin + 50_000]
                    if len(at) + len(part) > REMEMBERED:
                        at.clear()
                    rows = [at[w] if w in at else row(w) for w in part]
                    total += scores[rows].sum(axis=0)
                if not words:
                    found.append(UNKNOWN)
                    sure.append(0.0)
                else:
                    best = int(total.argmax())
                    found.append(languages[best])
                    sure.append(1.0 / float(np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string()), pa.array(sure, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
