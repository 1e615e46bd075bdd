"""A training-data pipeline over `documents`: five stages, each an operator of quarry.llm at work.

Every stage takes what its predecessor kept, written as Parquet and read again, and all but the last
return the columns of `documents`. A stage that learns does so from the labels of the data folder.

Defined results: rows are judged one by one, so rows under one doc_id or a null one stay or go each by its own text; null
and empty texts score as the classifiers score empty text, are copies of each other, hold no benchmark word and have the end
id alone; of equal rows near-dedup keeps one; other columns of documents pass through; an empty table gives none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 2 scores under 0.5."""
    from quarry.llm.common import crc_mod, table
    from quarry.llm.toxicity import fit
    from quarry.llm.toxicity import toxicity as score

    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return score(docs, model, keep=lambda p: p < 0.5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 10 scores 0.7 or more."""
    from quarry.llm.common import crc_mod, table
    from quarry.llm.quality import fit
    from quarry.llm.quality import quality as score

    vectors, network = fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    return score(docs, vectors, network, keep=lambda p: p >= 0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that pairs of 0.8 or more of their 5-word shingles make.

    Pairs come from operator 5's fingerprints first, from a join of the shingle sets where these do not reach.
    """
    from quarry.llm.near import keep_one_near

    return keep_one_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which operator 4 finds no word of a benchmark window."""
    from quarry.llm.common import table
    from quarry.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token digests of operator 3."""
    import public_tokenizers

    from quarry.llm.pieces import encode_pieces

    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


STAGES = [("toxicity", toxicity), ("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("SentencePiece encoding and decoding", encode)]

#: Trained classifiers, XXH64 and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.common import leave_on_exit, shared_folder, table

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        leave_on_exit(spark, path)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
