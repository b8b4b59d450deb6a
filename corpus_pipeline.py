"""A corpus made ready for training: toxic documents go, one document of each group of near copies stays, personal
data are masked, sources are mixed to their weights, and texts become pieces. Each stage is one operator of `llm`.

Every stage but the last returns the columns of `documents`, with `n_chars` kept right.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit.llm import mixing, parity_join, pii, piece_sampling, toxicity
from aislekit.llm.base import table
from aislekit.session import written


def _counted(docs: DataFrame) -> DataFrame:
    """`n_chars` as the text now has it, in the column's own type."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 1/2; the model learns from the labelled ones among them."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one of the smallest id; five words a shingle, similarity 0.8."""
    return parity_join.without_copies(docs, words=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.masked(docs, pii.train(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, once for each pass over their source; see `mixing.mixed_texts`."""
    return _counted(mixing.mixed_texts(docs, mixing.Mixture(docs)))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, piece_ids, lossless of every text."""
    return piece_sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=[c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Trained models and pseudorandom draws have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
