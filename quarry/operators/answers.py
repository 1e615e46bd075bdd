"""From ranked chunks to a prompt's context, its citations and a conversation's history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import or_untitled
from quarry.operators.fusion import first_of_each

RULE = "\n\n---\n\n"


def context_text(ranked: DataFrame) -> DataFrame:
    """query_id, context: `[i] title (url)` and the content of each, in rank order, ruled off."""
    title, url, body = (F.coalesce(c, F.lit("")) for c in ("title", "source_url", "page_content"))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), title, F.lit(" ("), url, F.lit(")\n"), body)
    held = F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("block"))))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(held, lambda x: x["block"]), RULE).alias("context"))


def cited_sources(ranked: DataFrame) -> DataFrame:
    """query_id, rank, url, title, category, doc_type: the first chunk of every URL; none without a URL."""
    some = ranked.where(F.coalesce("source_url", F.lit("")) != "").withColumnRenamed("rank", "in_list")
    kept = first_of_each(some, ["query_id"], "source_url", ["in_list"])
    return kept.select("query_id", "rank", F.col("source_url").alias("url"), F.coalesce("title", "source_url").alias("title"), "category", "doc_type")


def rerank_prompt(documents: Column) -> Column:
    """Numbered blocks of an array of (title, section_title, source_url, page_content), and their range."""

    def block(d: Column, i: Column) -> Column:
        title = or_untitled(d["title"])
        section = F.coalesce(F.nullif(d["section_title"], F.lit("")), title)
        lines = [F.concat(F.lit("Document ID: "), i.cast("string")), F.concat(F.lit("Title: "), title), F.concat(F.lit("Section: "), section), F.concat(F.lit("URL: "), F.coalesce(d["source_url"], F.lit(""))), F.lit("Content:"), F.concat(F.lit("```"), F.coalesce(d["page_content"], F.lit("")), F.lit("```"))]
        return F.concat_ws("\n", *lines)

    n = F.size(documents)
    span = F.when(n > 0, F.concat(F.lit("Document ID: 0, ..., Document ID: "), (n - 1).cast("string"))).otherwise("empty list")
    return F.concat_ws("\n\n", F.transform(documents, block), F.concat(F.lit("Documents = ["), span, F.lit("]")))


def chat_history(turns: DataFrame, roles: Sequence[str] = ("user", "assistant")) -> DataFrame:
    """conv_id, turn, question, history of every user turn: the earlier messages of the given roles."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    message = F.when(F.col("role").isin(*roles), F.struct(F.col("role"), F.col("text").alias("content")))
    return turns.withColumn("history", F.collect_list(message).over(before)).where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), "history")
