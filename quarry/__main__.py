"""Command lines: discover a site's pages, ingest sources, evaluate. Run `python -m quarry COMMAND --help`."""

from __future__ import annotations

import argparse
import importlib
from datetime import UTC, datetime


def named(path: str):
    """module:attribute, for models and embedders."""
    module, _, attribute = path.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("discover", help="a sitemap's pages in scope, as a YAML list of sources")
    d.add_argument("sitemap")
    d.add_argument("--out", required=True)
    i = sub.add_parser("ingest", help="sources to a chunk cache and a vector store")
    i.add_argument("sources")
    i.add_argument("--limit", type=int)
    i.add_argument("--chunks-only", action="store_true")
    e = sub.add_parser("evaluate", help="answer and judge cases, resuming; print the report")
    e.add_argument("cases")
    e.add_argument("--mode", action="append", choices=["fast", "best"])
    e.add_argument("--results", required=True)
    e.add_argument("--commit", default="unknown")
    for k in ("fast", "model", "judge"):
        e.add_argument(f"--{k}", type=named, required=True, help="module:function from prompts to texts")
    for x in (i, e):
        x.add_argument("--folder", required=True, help="where chunks, store and marker are")
        x.add_argument("--embedder", type=named, help="module:function; the default hashes words")
    return p


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from quarry.plans import evaluate, ingest
    from quarry.plans.config import Config
    from quarry.sources import tables, web
    from quarry.sources.store import HashingEmbedder, VectorStore

    a, config, when = parser().parse_args(argv), Config.from_environment(), datetime.now(UTC).isoformat(timespec="seconds")
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    fetch = web.http_fetcher(config.user_agent)
    if a.command == "discover":
        pages = web.discover(spark, a.sitemap, fetch, config.user_agent, config.scope_paths)
        tables.write_sources(pages, a.out)
        for r in web.category_counts(pages).collect():
            print(r.category, r.n)
        return
    embed, store = a.embedder or HashingEmbedder(config.embedding_dim), VectorStore(spark, f"{a.folder}/store")
    if a.command == "ingest":
        sources = tables.read_sources(spark, a.sources)
        print(ingest.run(spark, sources, fetch, f"{a.folder}/chunks", store, embed, f"{a.folder}/marker", when, a.limit, a.chunks_only, config, errors=f"{a.folder}/errors").count(), "chunks")
    else:
        cases = tables.read_cases(spark, a.cases)
        print(evaluate.run(cases, store.rows(), embed, a.fast, a.model, a.judge, a.results, when, tuple(a.mode or evaluate.MODES), a.commit, config))


if __name__ == "__main__":
    main()
