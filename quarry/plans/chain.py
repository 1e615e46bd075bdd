"""Question answering over a batch: rewrite, expand, retrieve, fuse, rerank, answer, cite.

A language model is any function from a list of prompts to a list of texts. Rows that need no call are
split off first, since filters around a Python function don't keep it from running.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import answers, bm25, fusion, vectors
from quarry.plans import prompts
from quarry.plans.config import Config
from quarry.sources.store import Embedder, embedded

Model = Callable[[list[str]], list[str]]


def ask(model: Model):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model(texts.tolist()))

    return run


def standalone(questions: DataFrame, model: Model) -> DataFrame:
    """Adds standalone_question: the question itself without a history, else the model's rewriting."""
    fresh = F.coalesce(F.size("history"), F.lit(0)) <= 0
    first = questions.where(fresh).withColumn("standalone_question", F.col("question"))
    later = questions.where(~fresh).withColumn("standalone_question", ask(model)(prompts.rewrite(F.col("history"), F.col("question"))))
    return first.unionByName(later)


def expanded(questions: DataFrame, model: Model, n: int = 3) -> DataFrame:
    """query_id, ordinal, text: the model's lines as they are, then the question itself."""
    lines = F.filter(F.split(F.trim(ask(model)(prompts.variants(F.col("standalone_question"), n))), "\n"), lambda x: x != "")
    return questions.withColumn("_lines", lines).select("query_id", F.posexplode(F.concat("_lines", F.array("standalone_question"))).alias("ordinal", "text"))


def semantic(chunks: DataFrame, queries: DataFrame, embed: Embedder, k: int) -> DataFrame:
    """query_id, rank, chunk_id, score by vector. chunks has chunk_id and embedding."""
    asked = embedded(queries.select("query_id", "text"), embed, "text")
    return vectors.nearest(chunks, asked, k, key="chunk_id", own=True, query_key="query_id").withColumnRenamed("vec_id", "chunk_id")


def retrieve(questions: DataFrame, chunks: DataFrame, embed: Embedder, mode: str, model: Model, config: Config = Config()) -> DataFrame:
    """query_id, rank and the chunk's columns. fast: the nearest vectors; best: hybrid lists of several
    phrasings, fused, united and reranked. query_id is a long."""
    if mode == "fast":
        asked = questions.select("query_id", F.col("standalone_question").alias("text"))
        ranked = semantic(chunks, asked, embed, config.fast_top_k).select("query_id", "rank", "chunk_id")
        return ranked.join(chunks.drop("embedding"), "chunk_id")
    return _reranked(questions, hits_of_phrasings(questions, chunks, embed, model, config), chunks, model, config)


def hits_of_phrasings(questions: DataFrame, chunks: DataFrame, embed: Embedder, model: Model, config: Config = Config()) -> DataFrame:
    """query_id, ordinal, text (the phrasing), rank, chunk_id: the fused list of every phrasing of a question."""
    phrased = expanded(questions, model, config.multi_query_variants).withColumn("_q", F.concat_ws(":", "query_id", "ordinal"))
    asked = phrased.select(F.col("_q").alias("query_id"), "text")
    k = config.ensemble_top_k
    sparse = bm25.top_k(chunks.select(F.col("chunk_id").alias("doc_id"), F.col("page_content").alias("text")), asked, k).withColumnRenamed("doc_id", "chunk_id")
    dense = semantic(chunks, asked, embed, k)
    fused = fusion.fuse([(sparse, config.bm25_weight), (dense, config.vector_weight)], key="chunk_id")
    return fused.withColumnRenamed("query_id", "_q").join(phrased, "_q").select("query_id", "ordinal", "text", "rank", "chunk_id")


def _reranked(questions: DataFrame, hits: DataFrame, chunks: DataFrame, model: Model, config: Config) -> DataFrame:
    united = fusion.union_of_queries(hits, "chunk_id").join(chunks.drop("embedding"), "chunk_id")
    doc = F.struct("rank", *[c for c in united.columns if c not in ("query_id", "rank")])
    lists = united.groupBy("query_id").agg(F.array_sort(F.collect_list(doc)).alias("docs")).join(questions.select("query_id", "standalone_question"), "query_id")  # at most variants * 2k chunks each
    prompt = prompts.rerank(answers.rerank_prompt(F.col("docs")), F.col("standalone_question"))
    ids = F.transform(F.regexp_extract_all(F.coalesce(ask(model)(prompt), F.lit("")), F.lit(r"-?\d+"), 0), lambda x: x.try_cast("int"))
    top = lists.withColumn("_ids", ids).select("query_id", F.posexplode(fusion.reranked(F.col("docs"), F.col("_ids"), config.rerank_top_n)).alias("_r", "d"))
    return top.select("query_id", (F.col("_r") + 1).alias("rank"), *[F.col(f"d.{c}").alias(c) for c in united.columns if c not in ("query_id", "rank")])


def answered(questions: DataFrame, chunks: DataFrame, embed: Embedder, fast: Model, model: Model, mode: str = "best", config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(questions with standalone_question, context and answer; retrieved chunks). The answer is to the
    question as asked, the context to the one as rewritten."""
    stated = standalone(questions, fast)
    found = retrieve(stated, chunks, embed, mode, fast, config)
    with_context = stated.join(answers.context_text(found), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return with_context.withColumn("answer", ask(model)(prompts.answer(F.col("context"), F.col("history"), F.col("question")))), found
