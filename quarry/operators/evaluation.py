"""Evaluation: metrics with three-valued logic, resuming, summary and failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases by which an answer declines.
REFUSALS = (
    "i'm not sure", "i'm sorry", "i am sorry", "please check hdb.gov.sg", "can't help", "cannot help", "can only provide information",
    "can only assist", "unrelated", "outside the scope", "not within", "i don't have",
)
METRICS = ("retrieval", "faithfulness", "relevance", "citation", "refusal")
SIGNATURE = ("question", "category", "expected_behavior")
SHOWN = 200


def url_hit(urls: Column, needles: Column) -> Column:
    """Whether some URL has some needle in it, case aside. Null URLs have none."""
    return F.coalesce(F.exists(urls, lambda u: F.exists(needles, lambda n: F.contains(F.lower(F.coalesce(u, F.lit(""))), F.lower(n)))), F.lit(False))


def refused(answer: Column, phrases: Sequence[str] = REFUSALS) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def says_yes(verdict: Column) -> Column:
    return F.startswith(F.upper(F.trim(F.coalesce(verdict, F.lit("")))), F.lit("YES"))


def scored(results: DataFrame, phrases: Sequence[str] = REFUSALS) -> DataFrame:
    """Adds the five *_pass columns to results with expected_behavior, must_cite_url_contains, answer,
    retrieved_urls, source_urls, faithful and relevant (a judge's words). Null: does not apply."""
    needles = F.col("must_cite_url_contains")
    asked = F.coalesce(F.size(needles) > 0, F.lit(False))
    answer = F.col("expected_behavior") == "answer"
    return results.withColumns(
        {
            "retrieval_pass": F.when(asked, url_hit(F.col("retrieved_urls"), needles)),
            "faithfulness_pass": F.when(answer & (F.size("retrieved_urls") > 0), says_yes(F.col("faithful"))),
            "relevance_pass": F.when(answer, says_yes(F.col("relevant"))),
            "citation_pass": F.when(asked, url_hit(F.col("source_urls"), needles)),
            "refusal_pass": refused(F.col("answer"), phrases) == (F.col("expected_behavior") == "refuse"),
        }
    )


def latest_saved(cases: DataFrame, saved: DataFrame, order: str = "line_no") -> DataFrame:
    """Saved results whose case still stands as it was asked; the last one of an id."""
    same = saved.join(cases.select("id", *SIGNATURE), ["id", *SIGNATURE], "left_semi")
    last = Window.partitionBy("id").orderBy(F.desc(order))
    return same.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def todo(cases: DataFrame, saved: DataFrame, order: str = "line_no") -> DataFrame:
    """Cases without such a result."""
    return cases.join(latest_saved(cases, saved, order), "id", "left_anti")


def percent(passed: Column, of: Column) -> Column:
    """Whole per cent, halves to even; a dash where nothing applies."""
    return F.when(of > 0, F.concat(F.bround(100.0 * passed / of).cast("int").cast("string"), F.lit("%"))).otherwise("—")


def summary(results: DataFrame, by: str = "mode") -> DataFrame:
    """For each mode the share of passes of every metric, nulls left out."""
    return results.groupBy(by).agg(*(percent(F.count_if(F.col(f"{m}_pass")), F.count(f"{m}_pass")).alias(m) for m in METRICS))


def failures(results: DataFrame) -> DataFrame:
    """Results that fail some metric (null is no failure): failed, in fixed order, and a shortened answer."""
    flags = F.array_compact(F.array(*(F.when(~F.col(f"{m}_pass"), F.lit(m)) for m in METRICS)))
    return results.withColumn("failed", F.array_join(flags, ", ")).where("failed <> ''").withColumn("shown", F.concat(F.left(F.coalesce("answer", F.lit("")), F.lit(SHOWN)), F.lit("…")))


def report(results: DataFrame, when: str, commit: str = "unknown", primary: str = "best") -> str:
    """Markdown of the summary and the primary mode's failures (a report's few rows reach the driver)."""
    rows = sorted(summary(results).collect(), key=lambda r: r["mode"])
    modes = [r["mode"] for r in rows]
    main = primary if primary in modes else (modes[0] if modes else primary)
    lines = [f"# Eval Report — {when[:10]} (commit `{commit}`)", "", "## Summary", "", "| Mode | Retrieval@5 | Faithfulness | Relevance | Citation | Refusal |", "|---|---|---|---|---|---|"]
    lines += ["| " + " | ".join([r["mode"], *(r[m] for m in METRICS)]) + " |" for r in rows]
    lines += ["", f"## Failures ({main} mode)", ""]
    bad = failures(results.where(F.col("mode") == main)).orderBy("id").collect()
    lines += [f"- **#{r['id']}** ({r['category']}, failed: {r['failed']}): _{r['question']}_\n  > {r['shown']}" for r in bad] or ["_No failures._"]
    return "\n".join(lines) + "\n"
