"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``, whatever they are named.

Cases, for every stage: an empty table gives an empty table; null and empty texts are texts without words; columns beyond doc_id and
text may be null or extra.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from genolith.llm import decontam, mixing, simhash, tokenstore, toxicity
from genolith.llm.common import free_name, removed, shared_path, table, until_exit

#: Documents of this score or more are rejected.
TOXIC = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (trained on these documents' labels) doesn't reject: those that score below TOXIC. Equal
    rows are judged alike; rows without id are judged too; without labels none is rejected."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return toxicity.score(docs, model, name=score).filter(F.col(score) < TOXIC).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more. The least id stays; texts without
    words are one group; of rows that repeat id and text one stays; rows without id stay."""
    return simhash.drop_duplicates(docs, k=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten consecutive words of a benchmark item (or a whole shorter item) occur. Texts without words stay."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"), size=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words mixed to the sources' target weights: a row for each time that a document is taken. A null source is one of
    its own; texts without words go, as no words of theirs can be taken; repeated rows are documents of their own."""
    return mixing.mix_documents(docs, weights=(5, 2, 1), cap=3.0, block=128)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as a store of token ids, read back: doc_id, start, n_tokens, ids_crc32. Rows that repeat an id are documents of their
    own; a null id sorts first."""
    return tokenstore.stored(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, together=2_000_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Trees, fingerprints and tokenizers aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes when the next one is written, the last when the driver ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = until_exit(spark, shared_path(spark, f"stage-{name}"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            removed(spark, before)
        before = path
    return docs
