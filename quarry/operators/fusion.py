"""Ranked lists as tables: weighted reciprocal-rank fusion, union over queries, ordered dedupe, reranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF = 60


def fuse(lists: Sequence[tuple[DataFrame, float]], key: str = "doc_id", constant: int = RRF) -> DataFrame:
    """query_id, rank, key, score: each list (query_id, key, rank) adds weight / (rank + constant) to
    its keys; equal scores keep the order of first appearance, earlier lists first."""
    both = None
    for ordinal, (df, weight) in enumerate(lists):
        one = df.select("query_id", key, F.col("rank").cast("int").alias("rank"), F.lit(float(weight)).alias("weight"), F.lit(ordinal).alias("list"))
        both = one if both is None else both.unionByName(one)
    total = both.groupBy("query_id", key).agg(F.sum(F.col("weight") / (F.col("rank") + constant)).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first", key)
    return total.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", key, "score")


def first_of_each(ranked: DataFrame, by: Sequence[str], key: str, order: Sequence[str]) -> DataFrame:
    """The first row of every key within by, in order, with new ranks."""
    seen = Window.partitionBy(*by, key).orderBy(*order)
    kept = ranked.withColumn("_n", F.row_number().over(seen)).where("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def union_of_queries(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits (query_id, ordinal, rank, key) of several phrasings of a question as one list: phrasing by
    phrasing, each key once, where it comes first."""
    return first_of_each(hits.withColumnRenamed("rank", "in_list"), ["query_id"], key, ["ordinal", "in_list"]).select("query_id", "rank", key)


def repaired(ids: Column, n: Column) -> Column:
    """A permutation of 0..n-1 from ids that a model gave: the valid ones in its order, each once, then
    those it left out."""
    valid = F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<int>")), lambda i: i.isNotNull() & (i >= 0) & (i < n)))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(valid, F.array_except(every, valid))


def reranked(documents: Column, ids: Column, n: int) -> Column:
    """The first n of an array of documents in the repaired order."""
    order = repaired(ids, F.size(documents))
    return F.slice(F.transform(order, lambda i: F.get(documents, i)), 1, n)


def diagnostics(hits: DataFrame, final: DataFrame) -> DataFrame:
    """query_id, generated_queries, retrieved_by_query, final_reranked: traces with ranks from 1.

    hits: query_id, ordinal, query, rank, doc; final: query_id, rank, doc (doc: any struct).
    """
    of_one = hits.groupBy("query_id", "ordinal", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "doc"))).alias("results"))
    traced = of_one.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "query", "results"))).alias("t"))
    last = final.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc"))).alias("final_reranked"))
    return traced.join(last, "query_id", "full").select("query_id", F.transform("t", lambda x: x["query"]).alias("generated_queries"), F.transform("t", lambda x: F.struct(x["query"].alias("query"), x["results"].alias("results"))).alias("retrieved_by_query"), "final_reranked")
