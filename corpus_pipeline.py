"""A training-data pipeline over ``documents``; each stage's result is written and read as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import stored, table, without
from trajlens.llm.exact_dedup import drop_exact_copies
from trajlens.llm.mixing import sample_mixture, topic_of
from trajlens.llm.ngram_join import keep_one_of_similar
from trajlens.llm.pieces import encode_pieces
from trajlens.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PIECE_MODEL = "piece_bpe_32k.model"


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from all labels of documents it is given."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    toxic = score_toxicity(docs, labels).where("predicted = 1")
    return without(docs, toxic, "doc_id", "text").select(*COLUMNS)


def drop_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return drop_exact_copies(docs).select(*COLUMNS)


def drop_similar(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, directly or through others, one stays."""
    return keep_one_of_similar(docs).select(*COLUMNS)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected words are spread over sources, languages and topics as wanted."""
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}
    return sample_mixture(docs, margins).select(*COLUMNS)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every text that is left."""
    return encode_pieces(docs, public_tokenizers.path(PIECE_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_similar),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", encode),
]

# Boosted trees are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
