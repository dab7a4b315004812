"""Token counts and piece paths against the tokenizer library and exhaustive search."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from checks import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from trajlens.llm.piece_model import load
from trajlens.llm.pieces import PieceEncoder, decode_pieces, encode_pieces
from trajlens.llm.token_counts import PrefixCounter, budget_answers, prefix_counts, tokens_of_prefix

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = load(PATH)
COUNTER, ENCODER = PrefixCounter(MODEL), PieceEncoder(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab the.,!\n\té1²▁<你😀"), max_size=40))
def test_every_prefix_has_the_library_count(text):
    counts = np.cumsum(np.frombuffer(COUNTER.changes(text), np.int8), dtype=int)
    assert [0, *counts[1:]] == [len(LIBRARY.encode(text[:i])) for i in range(len(text) + 1)]


def test_long_runs_have_the_library_count():
    for text in ("x" * 3000, " " * 500 + "a", "ab" * 700, "\n" * 90, "é" * 200):
        assert int(np.frombuffer(COUNTER.changes(text), np.int8).sum(dtype=int)) == len(LIBRARY.encode(text))


def test_query_counts_whole_texts(spark, texts):
    for r in __spark_entry__.queries()["op1_token_counts"](spark, SF_DIR).collect():
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(LIBRARY.encode(text)))
        assert r["over_limit"] == (r["n_tokens"] > 4096)


def test_budget_questions_need_no_encoding(spark):
    text = "a long enough sentence, with several words in it"
    counted = prefix_counts(spark.createDataFrame([(1, text, 9)], "doc_id int, text string, n_tokens2 int"), PATH)
    fitting = budget_answers(counted, 5).first()["fitting_chars"]
    assert len(LIBRARY.encode(text[:fitting])) <= 5
    assert all(len(LIBRARY.encode(text[:i])) > 5 for i in range(fitting + 1, len(text) + 1))
    for chars in (0, 3, 17, 10_000):
        asked = counted.selectExpr("*", f"{chars} AS chars")
        assert tokens_of_prefix(asked).first()["prefix_tokens"] == len(LIBRARY.encode(text[:chars]))


def test_counts_of_awkward_rows(spark, awkward):
    found = budget_answers(prefix_counts(awkward, PATH)).collect()
    assert len(found) == awkward.count()
    expected = sorted(len(LIBRARY.encode(r["text"] or "")) for r in awkward.collect())
    assert sorted(r["n_tokens"] for r in found) == expected
    assert prefix_counts(awkward.limit(0), PATH).count() == 0


def best_score(chunk: str) -> float:
    """The best sum of scores over all ways to cut a chunk."""
    best = {0: 0.0}
    for end in range(1, len(chunk) + 1):
        options = [best[s] + MODEL.scores[chunk[s:end]] for s in range(end) if chunk[s:end] in MODEL.scores]
        if chunk[end - 1] not in MODEL.scores:
            options.append(best[end - 1] + ENCODER.unknown)
        best[end] = max(options)
    return best[len(chunk)]


def test_paths_have_the_best_score_and_decode_to_the_text():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abehinrt the.,\n é你1") for _ in range(rng.randrange(1, 40)))
        ids, score = ENCODER.encode(text)
        assert score == pytest.approx(best_score("▁" + text.replace(" ", "▁")))
        assert LIBRARY.decode(np.frombuffer(ids, np.int32).tolist()) == text


def test_query_decodes_to_the_texts(spark, texts):
    for r in __spark_entry__.queries()["op8_pieces"](spark, SF_DIR).collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["n_pieces"] == len(r["ids"])


def test_pieces_of_awkward_rows(awkward):
    back = decode_pieces(encode_pieces(awkward, PATH), PATH).collect()
    assert sorted(r["text"] for r in back) == sorted((r["text"] or "").replace("▁", " ") for r in awkward.collect())
    assert encode_pieces(awkward.limit(0), PATH).count() == 0
