"""Evaluation runs: what is left to do in a mode is answered, judged, scored and appended; then the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import evaluation
from quarry.operators.answers import cited_sources
from quarry.plans import chain, prompts
from quarry.plans.config import Config
from quarry.plans.replies import logged
from quarry.sources import tables
from quarry.sources.store import Embedder

MODES = ("fast", "best")


#: Cases that are answered, judged and saved together.
BATCH = 8
REF = ("chunk_id", "chunk_index", "source_url", "title", "section_title", "page_number")


def run_mode(cases: DataFrame, chunks: DataFrame, embed: Embedder, fast: chain.Model, model: chain.Model, judge: chain.Model, mode: str, path: str, config: Config = Config(), replies: str | None = None, batch: int = BATCH) -> DataFrame:
    """Answers the cases that have no saved result in this mode as they are asked now; returns the mode's results, one a case.

    Cases go `batch` at a time, in order of id, and a batch's results are saved before the next begins. Within a batch every reply of a
    model is in a log (by default beside the results) as soon as it is there, so a run that breaks asks again for nothing it was told.
    """
    spark = cases.sparkSession
    log = replies or f"{path.rstrip('/')}-replies"
    fast, model, judge = (logged(m, log, f"{mode}/{n}") for m, n in ((fast, "fast"), (model, "answer"), (judge, "judge")))
    left = evaluation.todo(cases, saved_of(spark, path, mode))
    ids = sorted(r["id"] for r in left.select("id").collect())  # the cases of a control file
    for at in range(0, len(ids), batch):
        some = left.where(F.col("id").isin(ids[at : at + batch]))
        tables.append_results(_judged(some, chunks, embed, fast, model, judge, mode, config), path, mode)
    return evaluation.latest_saved(cases, saved_of(spark, path, mode))


def _judged(cases: DataFrame, chunks: DataFrame, embed: Embedder, fast: chain.Model, model: chain.Model, judge: chain.Model, mode: str, config: Config) -> DataFrame:
    """Scored results of cases, with their traces."""
    history = F.array().cast("array<struct<role:string,content:string>>")
    asked = cases.select(F.col("id").cast("long").alias("query_id"), "*", history.alias("history"))
    done, found = chain.answered(asked, chunks, embed, fast, model, mode, config)
    listed = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_url"))), lambda x: x["source_url"]).alias("retrieved_urls"))
    one = F.struct("rank", F.struct("url", "title", "category", "doc_type").alias("s"))
    cited = cited_sources(found).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("sources"))
    rows = done.join(listed, "query_id", "left").join(cited, "query_id", "left").join(_traces(done, found, chunks, embed, fast, mode, config), "query_id", "left")
    rows = rows.withColumns({"retrieved_urls": F.coalesce("retrieved_urls", F.array().cast("array<string>")), "source_urls": F.coalesce(F.transform("sources", lambda s: s["url"]), F.array().cast("array<string>"))})
    judged = rows.withColumns({"faithful": chain.ask(judge)(prompts.faithful(F.col("context"), F.col("answer"))), "relevant": chain.ask(judge)(prompts.relevant(F.col("question"), F.col("answer")))})
    return evaluation.scored(judged)


def _traces(done: DataFrame, found: DataFrame, chunks: DataFrame, embed: Embedder, fast: chain.Model, mode: str, config: Config) -> DataFrame:
    """query_id, retrieval_diagnostics: the question as asked and as rewritten, its phrasings, the list of each, the final one."""
    ref = lambda df: F.struct("rank", *[c for c in REF if c in df.columns])
    final = found.groupBy("query_id").agg(F.array_sort(F.collect_list(ref(found))).alias("final_reranked"))
    base = done.select("query_id", F.col("question").alias("original_query"), F.col("standalone_question").alias("standalone_query"))
    if mode == "fast":
        lists = base.select("query_id", F.array().cast("array<string>").alias("generated_queries"), F.array().cast("array<string>").alias("retrieved_by_query"))
    else:
        hits = chain.hits_of_phrasings(done.select("query_id", "standalone_question"), chunks, embed, fast, config).join(chunks.drop("embedding", "text"), "chunk_id")
        each = hits.groupBy("query_id", "ordinal", "text").agg(F.array_sort(F.collect_list(ref(hits))).alias("results"))
        in_order = F.array_sort(F.collect_list(F.struct("ordinal", F.struct(F.col("text").alias("query"), "results").alias("list"))))
        lists = each.groupBy("query_id").agg(F.transform(in_order, lambda x: x["list"]).alias("retrieved_by_query")).withColumn("generated_queries", F.transform("retrieved_by_query", lambda x: x["query"]))
    whole = base.join(lists, "query_id", "left").join(final, "query_id", "left")
    trace = F.struct("original_query", "standalone_query", *[F.col(c) for c in ("generated_queries", "retrieved_by_query", "final_reranked")])
    return whole.select("query_id", F.to_json(trace, {"ignoreNullFields": "false"}).alias("retrieval_diagnostics"))


def saved_of(spark: SparkSession, path: str, mode: str) -> DataFrame:
    return tables.read_results(spark, path).where(F.col("mode") == mode)


def run(cases: DataFrame, chunks: DataFrame, embed: Embedder, fast: chain.Model, model: chain.Model, judge: chain.Model, path: str, when: str, modes: tuple[str, ...] = MODES, commit: str = "unknown", config: Config = Config()) -> str:
    """The report over all modes: those named are run, each resumed where it was left; of the others what is saved counts."""
    results = None
    for mode in dict.fromkeys((*MODES, *modes)):
        if mode in modes:
            one = run_mode(cases, chunks, embed, fast, model, judge, mode, path, config)
        else:
            one = evaluation.latest_saved(cases, saved_of(cases.sparkSession, path, mode))
        results = one if results is None else results.unionByName(one)
    return evaluation.report(results, when, commit)
