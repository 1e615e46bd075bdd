"""Sitemaps, pages and PDFs as tables. Fetching is pluggable; nothing here needs a network by itself."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import urls as U
from quarry.functions.html import clean_html_column
from quarry.functions.text import strip

Fetcher = Callable[[str], tuple[int, str]]


def sitemap_urls(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    """url of every <loc> at any depth and in any namespace; blank ones are left out. Invalid XML is an error."""
    locs = F.xpath(F.col(xml), F.lit("//*[local-name()='loc']/text()"))
    return sitemaps.select(F.posexplode(locs).alias("ordinal", "loc")).select("ordinal", strip(F.col("loc")).alias("url")).where("url <> ''")


def classified(found: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    """URLs in scope that aren't junk, with title, doc_type and category. Repeated URLs stay."""
    url = F.col("url")
    return found.where(U.in_scope(url, scopes) & ~U.is_junk(url)).select("url", U.title(url).alias("title"), U.doc_type(url).alias("doc_type"), U.category(url).alias("category"))


def category_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("category").agg(F.count("*").alias("n")).orderBy("category")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """path, page_content of HTML files, cleaned."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", clean_html_column(F.col("value")).alias("page_content"))


def read_pdf(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """path, page_number (from 1), page_content of PDF files; blank pages are left out, numbers stay.

    pages_of takes a file's bytes to the texts of its pages; the default needs pypdf.
    """
    extract = pages_of or _pypdf_pages

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, n, s) for p, content in zip(f["path"], f["content"]) for n, text in enumerate(extract(bytes(content)), 1) if (s := (text or "").strip())]
            yield pd.DataFrame(rows, columns=["path", "page_number", "page_content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page_number int, page_content string")


def _pypdf_pages(content: bytes) -> list[str]:
    import io

    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf, or a pages_of function") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


@dataclass
class Politeness:
    """Robots rules by host, and a delay between requests of one task. A host without readable rules allows all."""

    fetch: Fetcher
    agent: str
    delay: float = 1.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    rules: dict[str, RobotFileParser] = field(default_factory=dict)
    last: float | None = None

    def allowed(self, url: str) -> bool:
        parts = urlsplit(url)
        host = f"{parts.scheme}://{parts.netloc}"
        if host not in self.rules:
            rules = self.rules[host] = RobotFileParser()
            try:
                status, text = self.fetch(f"{host}/robots.txt")
            except Exception:
                status, text = 0, ""
            if status == 200:
                rules.parse(text.splitlines())
            else:
                rules.allow_all = True
            rules.modified()
        return self.rules[host].can_fetch(self.agent, url)

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.delay:
            self.sleep(self.delay - (now - self.last))
        self.last = self.clock()


def fetched(sources: DataFrame, fetch: Fetcher, agent: str, delay: float = 1.0) -> DataFrame:
    """Adds status and body to sources; a page that robots rules deny has status null, a failed one -1.

    A host's pages are in one task, which keeps the delay between them.
    """
    columns = [f"{n} {t}" for n, t in sources.dtypes]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate = Politeness(fetch, agent, delay)
        for f in frames:
            got = []
            for url in f["url"]:
                if not gate.allowed(url):
                    got.append((None, None))
                    continue
                gate.wait()
                try:
                    got.append(fetch(url))
                except Exception as e:
                    got.append((-1, str(e)))
            yield f.assign(status=pd.array([g[0] for g in got], "Int32"), body=[g[1] for g in got])

    return sources.repartition(U.authority(F.col("url"))).mapInPandas(run, ", ".join([*columns, "status int", "body string"]))


def http_fetcher(agent: str, timeout: float = 15.0) -> Fetcher:
    """Fetches with the standard library."""

    def fetch(url: str) -> tuple[int, str]:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")

    return fetch


def pdf_fetcher(agent: str, timeout: float = 60.0) -> Callable[[str], bytes]:
    """The bytes of a file, with the standard library."""

    def fetch(url: str) -> bytes:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            return r.read()

    return fetch


def pdf_documents(sources: DataFrame, fetch: Fetcher, download: Callable[[str], bytes], agent: str, when: str, delay: float = 1.0, pages_of: Callable[[bytes], list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, one for each page with text; url and error of sources that failed or are denied) of PDF sources.

    Files are read as they come and never staged, so executors need no folder in common. fetch serves robots rules.
    """
    extract = pages_of or _pypdf_pages

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate = Politeness(fetch, agent, delay)
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                try:
                    if not gate.allowed(r.url):
                        raise PermissionError("denied by robots rules")
                    gate.wait()
                    pages = [(n, t.strip()) for n, t in enumerate(extract(download(r.url)), 1) if t and t.strip()]
                    rows += [(t, r.url, r.title, r.category, n, None) for n, t in pages]
                except Exception as e:
                    rows.append((None, r.url, r.title, r.category, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["page_content", "source_url", "title", "category", "page_number", "error"]).astype({"page_number": "Int32"})

    some = sources.where("type = 'pdf'").select("url", "title", "category").repartition(U.authority(F.col("url")))
    got = some.mapInPandas(run, "page_content string, source_url string, title string, category string, page_number int, error string").persist()
    docs = got.where("error is null").select("page_content", "source_url", "title", "category", F.lit("pdf").alias("doc_type"), "page_number", F.lit(when).alias("ingested_at"))
    return docs, got.where("error is not null").select(F.col("source_url").alias("url"), "error")


def failures(pages: DataFrame) -> DataFrame:
    """url, error of fetched sources that gave no page."""
    why = F.when(F.col("status").isNull(), "denied by robots rules").when(F.col("status") == -1, F.col("body")).otherwise(F.concat(F.lit("status "), F.col("status").cast("string")))
    return pages.where("status is null or status <> 200").select("url", why.alias("error"))


def discover(spark: SparkSession, sitemap: str, fetch: Fetcher, agent: str, scopes: tuple[str, ...]) -> DataFrame:
    """The classified URLs of a site's map. A map that robots rules deny, or that can't be had, is an error."""
    if not Politeness(fetch, agent, 0.0).allowed(sitemap):
        raise PermissionError(f"robots rules deny {sitemap}")
    status, xml = fetch(sitemap)
    if status != 200:
        raise OSError(f"{sitemap}: status {status}")
    return classified(sitemap_urls(spark.createDataFrame([(xml,)], "xml string")), scopes)


def documents(pages: DataFrame, when: str) -> DataFrame:
    """Fetched HTML sources as documents: page_content, source_url, title, category, doc_type, page_number, ingested_at. PDF sources: pdf_documents."""
    known = F.when(F.col("type").isin("html", "pdf"), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown source type: "), F.coalesce("type", F.lit("null")))))
    ok = pages.withColumn("doc_type", known).where("status = 200 and doc_type = 'html'")
    return ok.select(clean_html_column(F.col("body")).alias("page_content"), F.col("url").alias("source_url"), "title", "category", "doc_type", F.lit(None).cast("int").alias("page_number"), F.lit(when).alias("ingested_at"))
