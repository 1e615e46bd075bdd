"""Okapi BM25 over batches of queries: an inverted index as tables, and scoring by joins.

The idf of a term is ln(N - df + 0.5) - ln(df + 0.5); a negative one becomes a quarter of the mean idf
of the whole vocabulary. A query's repeated tokens count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import sparse_bag
from quarry.operators.layout import spread

K1, B, EPSILON = 1.5, 0.75, 0.25


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: Callable[[Column], Column] = sparse_bag) -> DataFrame:
    """doc_id, tokens of every document; only key and text are read."""
    return spread(docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))).select("doc_id", tokens(F.col("text")).alias("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """doc_id, term, tf, dl: one row for each document and term. Counts combine before the shuffle."""
    return tokens.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    """term, df."""
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus(tokens: DataFrame) -> DataFrame:
    """One row: n documents, avgdl."""
    return tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def idf(frequency: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf with the floor for negative values."""
    raw = frequency.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # stats is one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "text", tokens: Callable[[Column], Column] = sparse_bag) -> DataFrame:
    """query_id, term, qtf."""
    return queries.select(F.col(key).alias("query_id"), F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def contributions(docs: DataFrame, queries: DataFrame, tokens: Callable[[Column], Column] = sparse_bag, kept: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, part: what each term that a query shares with a document adds.

    Postings are made for the queries' terms only (the semi join stands before the aggregation), so
    what is shuffled follows the terms asked for. kept: tokenised(docs), if it is at hand.
    """
    own = kept if kept is not None else tokenised(docs, tokens=tokens)
    asked = query_terms(queries, tokens=tokens)
    stats = corpus(own)
    weights = idf(document_frequency(own), stats).join(asked, "term")
    terms = asked.select("term").distinct()
    some = own.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(terms, "term", "left_semi").groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))
    one = F.col("idf") * F.col("qtf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return some.join(weights, "term").crossJoin(F.broadcast(stats.select("avgdl"))).select("query_id", "doc_id", one.alias("part"))


def scores(docs: DataFrame, queries: DataFrame, tokens: Callable[[Column], Column] = sparse_bag, kept: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score of every document that shares a term with the query."""
    return contributions(docs, queries, tokens, kept).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def top_k(docs: DataFrame, queries: DataFrame, k: int = 5, tokens: Callable[[Column], Column] = sparse_bag, pad: bool = True, kept: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_id, score; ties go to the smaller doc_id. With pad, queries with fewer than k
    matches are filled up with the first documents, at score 0: those add nothing to every query, so no
    query needs to be looked at twice."""
    parts = contributions(docs, queries, tokens, kept)
    if pad:
        first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
        parts = parts.unionByName(queries.select("query_id").distinct().crossJoin(F.broadcast(first)).select("query_id", "doc_id", F.lit(0.0).alias("part")))  # 2k rows a query
    found = parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
