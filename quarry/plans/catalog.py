"""Every query by name, with SQL that gives the same rows.

Queries run over whole tables. Results that hold arrays or long texts are given as joined strings or
digests, so that rows compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import urls as U
from quarry.functions.html import clean_html_column
from quarry.operators import answers, bm25, chunking, evaluation, fusion, vectors
from quarry.operators.index import Bm25Index, index_of
from quarry.operators.layout import spread
from quarry.sources import tables, web

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Scopes and categories that occur in the generated pages.
SCOPES = ("/en/", "/fr/")
SITE_CATEGORIES = (("/en/", "english"), ("/fr/", "french"), *U.CATEGORIES)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# URLs and sources

R = "'" + U.PARTS + "'"
PATH = f"regexp_extract(url, {R}, 5)"
JUNK = " or ".join(f"contains(lower({PATH}), '{x}')" for x in U.JUNK_FRAGMENTS)
IS_JUNK = f"(coalesce(url, '') = '' or lower(regexp_extract(url, {R}, 2)) in ('javascript', 'mailto', 'tel') or regexp_extract(url, {R}, 9) <> '' or (regexp_extract(url, {R}, 7) <> '' and contains(lower({PATH}), 'search')) or {JUNK})"
IN_SCOPE = "(" + " or ".join(f"starts_with({PATH}, '{s}')" for s in SCOPES) + ")"
CATEGORY = "case " + " ".join(f"when contains({PATH}, '{n}') then '{c}'" for n, c in SITE_CATEGORIES) + " else 'uncategorized' end"
DOC_TYPE = "case when ends_with(lower(url), '.pdf') then 'pdf' else 'html' end"
LAST = f"regexp_extract(regexp_replace({PATH}, '/+$', ''), '([^/]*)$', 1)"
SLUG = f"regexp_replace({LAST}, '\\.[^.]*$', '')"
WORDS = f"trim(translate({SLUG}, '-_', '  '))"
TITLE = f"case when {LAST} = '' then url when {WORDS} = '' then {SLUG} else array_to_string(list_transform(regexp_extract_all({WORDS}, '(\\p{{L}}+|\\P{{L}}+)'), lambda r: upper(left(r, 1)) || lower(substr(r, 2))), '') end"


@query(f"select page_id, lower(regexp_extract(url, {R}, 2)) as scheme, regexp_extract(url, {R}, 4) as authority, {PATH} as path, regexp_extract(url, {R}, 7) as query, regexp_extract(url, {R}, 9) as fragment from pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.scheme(url).alias("scheme"), U.authority(url).alias("authority"), U.path(url).alias("path"), U.query(url).alias("query"), U.fragment(url).alias("fragment"))


@query(f"select page_id, {IS_JUNK} as junk from pages")
def url_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.is_junk(F.col("url")).alias("junk"))


@query(f"select page_id, {IN_SCOPE} as in_scope from pages")
def url_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.in_scope(F.col("url"), SCOPES).alias("in_scope"))


@query(f"select page_id, {CATEGORY} as category from pages")
def url_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.category(F.col("url"), SITE_CATEGORIES).alias("category"))


@query(f"select page_id, {DOC_TYPE} as doc_type from pages")
def url_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.doc_type(F.col("url")).alias("doc_type"))


@query(f"select page_id, {TITLE} as title from pages")
def url_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.title(F.col("url")).alias("title"))


@query("select url from pages")
def sitemap_locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>\n '), escaped, F.lit(" </loc></url></urlset>"))
    return web.sitemap_urls(table(spark, sf_dir, "pages").select(xml.alias("xml"))).select("url")


@query(f"select url, {TITLE} as title, {DOC_TYPE} as doc_type, case when contains({PATH}, '/buying-a-flat/') then 'buying' when contains({PATH}, '/selling-a-flat/') then 'selling' when contains({PATH}, '/managing-my-home/') or contains({PATH}, '/renting-a-flat/') then 'living' else 'uncategorized' end as category from pages where {IN_SCOPE} and not {IS_JUNK}")
def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.classified(table(spark, sf_dir, "pages").select("url"), SCOPES)


@query(f"select category, count(*) as n from (select {CATEGORY} as category from pages) group by category")
def source_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.category_counts(url_category(spark, sf_dir))


@query(f"select url, {DOC_TYPE} as type, {CATEGORY} as category, {TITLE} as title from pages")
def sources_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return tables.sorted_sources(table(spark, sf_dir, "pages").select("url", U.doc_type(url).alias("doc_type"), U.category(url, SITE_CATEGORIES).alias("category"), U.title(url).alias("title")))


# Lines, headings, sections, identities

TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
BODY = f"trim(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {TRIM})"
LINES = f"""
body as (select doc_id, {BODY} as t from documents),
raw as (select doc_id, unnest(string_split(t, chr(10))) as raw, unnest(range(0, len(string_split(t, chr(10))))) as line_no from body),
placed as (select *, coalesce(sum(length(raw) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) + length(raw) - length(ltrim(raw, {TRIM})) as start, trim(raw, {TRIM}) as line from raw),
lines as (select doc_id, cast(line_no as integer) as line_no, line, cast(start as bigint) as start, cast(start + length(line) as bigint) as stop from placed where line <> '')"""
HEADING = r"(length(line) <= 90 and len(regexp_extract_all(line, '[^\s]+')) <= 12 and not regexp_matches(line, '^(\d+[.)]|[a-z][.)]|[-*•])\s+') and not regexp_matches(line, '(?i)^(https?://|www\.)') and not regexp_matches(line, '(?i)^(go to e-services|next steps|related topics|tools and resources|visit hdb flat portal)$') and not regexp_matches(line, '[.!?]$') and regexp_matches(line, '^[\p{L}\p{N}]') and regexp_matches(line, '\p{L}'))"
SECTIONS = f"""{LINES},
heads as (select doc_id, line as title, start from lines where {HEADING}),
sizes as (select doc_id, cast(length(t) as bigint) as size from body where t <> ''),
begins as (select * from heads union all select doc_id, null, 0 from sizes where doc_id not in (select doc_id from heads where start = 0)),
sections as (select doc_id, cast(row_number() over w - 1 as integer) as section_index, title, start, coalesce(lead(start) over w, size) as stop from begins join sizes using (doc_id) window w as (partition by doc_id order by start))"""


@query(f"with {LINES} select * from lines")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.lines(spread(table(spark, sf_dir, "documents"))).select("doc_id", "line_no", "line", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query(f"with {LINES} select doc_id, line_no, line from lines where {HEADING}")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.headings(spread(table(spark, sf_dir, "documents"))).select("doc_id", "line_no", "line")


@query(f"with {SECTIONS} select * from sections")
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.section_bounds(spread(table(spark, sf_dir, "documents")))


@query(f"""with {SECTIONS},
parts as (select doc_id, unnest(range(0, size, 700)) as start, size from sizes),
pieces as (select doc_id, cast(start / 700 as integer) as chunk_index, cast(start as bigint) as start, least(start + 800, size) as stop from parts),
shared as (select p.*, s.section_index, greatest(least(p.stop, s.stop) - greatest(p.start, s.start), 0) as o from pieces p join sections s using (doc_id))
select doc_id, chunk_index, start, stop, arg_max(section_index, o * 1000000 - section_index) as section_index from shared group by all""".replace("group by all", "group by doc_id, chunk_index, start, stop"))
def chunk_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", F.length(T.normalised(F.col("text"))).cast("long").alias("size")).where("size > 0")
    pieces = sized.select("doc_id", "size", F.explode(F.expr("sequence(0L, size - 1, 700L)")).alias("start")).select("doc_id", (F.col("start") / 700).cast("int").alias("chunk_index"), "start", F.least(F.col("start") + 800, "size").alias("stop"))
    return chunking.section_of_chunk(pieces, chunking.section_bounds(docs))


@query("select doc_id, substr(sha256('https://example.org/' || source || '#' || case when doc_id % 3 = 0 then 'None' else cast(doc_id % 3 as varchar) end), 1, 16) as source_doc_id from documents")
def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3)
    return table(spark, sf_dir, "documents").select("doc_id", T.source_doc_id(F.concat(F.lit("https://example.org/"), F.col("source")), page).alias("source_doc_id"))


@query("select doc_id, substr(sha256(text), 1, 16) as content_hash, substr(sha256(cast(doc_id as varchar) || ':0:' || substr(sha256(text), 1, 16)), 1, 16) as chunk_id from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = T.short_hash(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", own.alias("content_hash"), T.chunk_id(F.col("doc_id").cast("string"), F.lit(0), own).alias("chunk_id"))


def with_metadata(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").alias("page_content"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("source_url"), F.concat_ws(" ", "lang", "source").alias("title"), F.lit(None).cast("int").alias("page_number"))


@query()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(with_metadata(spread(table(spark, sf_dir, "documents"))))


@query()
def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", clean_html_column(F.col("html")).alias("page_content"))
    return cleaned.select("page_id", "page_content", F.size(F.split("page_content", "\n")).alias("n_lines"))


# Sparse retrieval


def _tokens_sql(text: str) -> str:
    raw = f"regexp_extract_all(regexp_replace(coalesce({text}, ''), '[-‐-―−]', ' ', 'g'), '[A-Za-z0-9]+')"
    listed = lambda p: "[" + ", ".join(f"'{w}'" for w in p) + "]"
    known = "case lower(t) " + " ".join(f"when '{a}' then {listed(p)}" for a, p in T.EXPANSIONS.items()) + " else cast([] as varchar[]) end"
    own = "case when length(t) > 1 and t = upper(t) and regexp_matches(t, '[A-Z]') then [t] else cast([] as varchar[]) end"
    inside = f"' ' || lower(array_to_string({raw}, ' ')) || ' '"
    found = " || ".join(f"case when contains({inside}, ' {' '.join(p)} ') then ['{a}'] else cast([] as varchar[]) end" for a, p in T.EXPANSIONS.items())
    return f"(flatten(list_transform({raw}, lambda t: [lower(t)] || {own} || {known})) || {found})"


BM25 = f"""
tokens as (select doc_id, {_tokens_sql('text')} as w from documents),
terms as (select doc_id, unnest(w) as term, len(w) as dl from tokens),
postings as (select doc_id, term, dl, count(*) as tf from terms group by doc_id, term, dl),
stats as (select count(*) as n, avg(len(w)) as avgdl from tokens),
freq as (select term, count(*) as df from postings group by term),
raw_idf as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as r from freq, stats),
idf as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw_idf) else r end as idf from raw_idf),
asked as (select item_id as query_id, unnest({_tokens_sql('text')}) as term from benchmark),
qterms as (select query_id, term, count(*) as qtf from asked group by query_id, term),
scored as (select query_id, doc_id, sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from qterms join postings using (term) join idf using (term), stats group by query_id, doc_id),
ranked as (select query_id, cast(row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as integer) as rank, doc_id, score from scored)"""


def documents_index(spark: SparkSession, sf_dir: str) -> Bm25Index:
    """Built by the first query that needs it, read by all."""
    return index_of(spark, f"{sf_dir}/documents.parquet")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"select doc_id, cast(len(w) as integer) as n_tokens, sha256(array_to_string(w, ' ')) as tokens_sha256 from (select doc_id, {_tokens_sql('text')} as w from documents)")
def bm25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bm25.tokenised(table(spark, sf_dir, "documents"), tokens=T.sparse_tokens)
    return own.select("doc_id", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join("tokens", " ").cast("binary"), 256).alias("tokens_sha256"))


@query(f"with {BM25} select doc_id, term, tf from postings")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).postings().select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


@query(f"with {BM25} select term, df from freq")
def bm25_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).terms()


@query(f"with {BM25} select term, df, round(idf, 6) as idf from idf")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).idf().select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {BM25} select query_id, doc_id, round(score, 4) as score from scored")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).scores(benchmark_queries(spark, sf_dir)).select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query(f"with {BM25} select query_id, rank, doc_id, round(score, 6) as score from ranked where rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(spark, sf_dir, 5).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(spark, sf_dir)


# Dense retrieval, fusion, reranking


def _near_sql(score: str, order: str, where: str = "q.vec_id % 50 = 0") -> str:
    return f"""
near as (select q.vec_id as query_id, v.vec_id, {score} as score from embeddings q join embeddings v on q.vec_id <> v.vec_id where {where}),
near_ranked as (select query_id, cast(row_number() over (partition by query_id order by {order}, vec_id) as integer) as rank, vec_id, score from near)"""


COSINE = "list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[]))"
L2 = "list_distance(cast(q.embedding as double[]), cast(v.embedding as double[]))"


@query(f"with {_near_sql(COSINE, 'round(score, 9) desc')} select query_id, rank, vec_id, round(score, 6) as score from near_ranked where rank <= 10")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 50 = 0"), 10).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(f"with {_near_sql(L2, 'round(score, 9)')} select query_id, rank, vec_id, round(score, 6) as score from near_ranked where rank <= 10")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 50 = 0"), 10, "l2").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query()
def knn_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the stored index of lists: nearly the rows of knn_cosine (its tests measure the recall), with exact scores."""
    index = vectors.list_index_of(spark, f"{sf_dir}/embeddings.parquet")
    return index.search(table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0"), 10).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def ranked_documents(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return documents_index(spark, sf_dir).search(benchmark_queries(spark, sf_dir), k)


HYBRID = f"""{BM25},{_near_sql(COSINE, 'round(score, 9) desc', 'q.vec_id in (select item_id from benchmark)')},
both_lists as (select query_id, doc_id, rank, 0.4 as weight, 0 as list from ranked where rank <= 10 union all select query_id, vec_id, rank, 0.6, 1 from near_ranked where rank <= 10),
fused as (select query_id, doc_id, sum(cast(weight as double) / (rank + 60)) as score, min(list * 1000 + rank) as first from both_lists group by query_id, doc_id)"""


@query(f"with {HYBRID} select query_id, cast(row_number() over (partition by query_id order by round(score, 12) desc, first, doc_id) as integer) as rank, doc_id, round(score, 9) as score from fused")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's vector is the one with its id, and a vec_id names the document of that id: a convention of this query."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    dense = vectors.nearest(rows, asked, 10).withColumnRenamed("vec_id", "doc_id")
    return fusion.fuse([(ranked_documents(spark, sf_dir, 10), 0.4), (dense, 0.6)]).select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


@query(f"""with {BM25},
phrased as (select query_id // 4 as query_id, query_id % 4 as ordinal, rank, doc_id from ranked where rank <= 10),
firsts as (select *, row_number() over (partition by query_id, doc_id order by ordinal, rank) as seen from phrased)
select query_id, cast(row_number() over (partition by query_id order by ordinal, rank) as integer) as rank, doc_id from firsts where seen = 1""")
def multi_query_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four items at a time count as phrasings of one question."""
    hits = ranked_documents(spark, sf_dir, 10).select(F.expr("query_id div 4").alias("query_id"), (F.col("query_id") % 4).alias("ordinal"), "rank", "doc_id")
    return fusion.union_of_queries(hits)


@query("""with seen as (select lang, source, doc_id, row_number() over (partition by lang, source order by doc_id) as n from documents)
select lang, source, doc_id, cast(row_number() over (partition by lang order by doc_id) as integer) as rank from seen where n = 1""")
def ranked_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.first_of_each(table(spark, sf_dir, "documents").select("lang", "source", "doc_id"), ["lang"], "source", ["doc_id"])


@query("""with given as (select vec_id, list_filter([cast(label as bigint), 99, vec_id % 7, cast(label as bigint), -1, vec_id % 13], lambda x: x >= 0 and x < vec_id % 11) as v, vec_id % 11 as n from embeddings),
firsts as (select vec_id, n, list_filter(v, lambda x, i: list_position(v, x) = i) as v from given)
select vec_id, array_to_string(v || list_filter(range(0, n), lambda x: not list_contains(v, x)), ',') as ranking from firsts""")
def rerank_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(F.col("label").cast("int"), F.lit(99), (F.col("vec_id") % 7).cast("int"), F.col("label").cast("int"), F.lit(-1), (F.col("vec_id") % 13).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(fusion.repaired(ids, (F.col("vec_id") % 11).cast("int")), lambda x: x.cast("string")), ",").alias("ranking"))


RETRIEVED = f"{BM25}, hits as (select r.query_id, r.rank, d.doc_id, d.lang || ' ' || d.source as title, 'https://example.org/' || d.source as url, d.text, d.lang from ranked r join documents d using (doc_id) where rank <= 10)"


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each item as chunks; documents of a source share its URL."""
    docs = table(spark, sf_dir, "documents")
    extra = docs.select("doc_id", F.concat_ws(" ", "lang", "source").alias("title"), F.concat(F.lit("https://example.org/"), F.col("source")).alias("source_url"), F.col("text").alias("page_content"), F.col("lang").alias("category"), F.lit("html").alias("doc_type"))
    return ranked_documents(spark, sf_dir, 10).join(extra, "doc_id")


@query(f"with {RETRIEVED} select query_id, length(c) as n_chars, sha256(c) as context_sha256 from (select query_id, string_agg('[' || rank || '] ' || title || ' (' || url || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as c from hits group by query_id)")
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.context_text(retrieved(spark, sf_dir)).select("query_id", F.length("context").cast("long").alias("n_chars"), F.sha2(F.col("context").cast("binary"), 256).alias("context_sha256"))


@query(f"""with {RETRIEVED}, seen as (select *, row_number() over (partition by query_id, url order by rank) as n from hits)
select query_id, cast(row_number() over (partition by query_id order by rank) as integer) as rank, url, title, lang as category, 'html' as doc_type from seen where n = 1""")
def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.cited_sources(retrieved(spark, sf_dir))


@query(f"""with {RETRIEVED},
blocks as (select query_id, string_agg('Document ID: ' || (rank - 1) || chr(10) || 'Title: ' || title || chr(10) || 'Section: ' || title || chr(10) || 'URL: ' || url || chr(10) || 'Content:' || chr(10) || '```' || text || '```', chr(10) || chr(10) order by rank) as b, count(*) as n from hits group by query_id)
select query_id, sha256(b || chr(10) || chr(10) || 'Documents = [Document ID: 0, ..., Document ID: ' || (n - 1) || ']') as prompt_sha256 from blocks""")
def rerank_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.struct("rank", "title", F.lit(None).cast("string").alias("section_title"), "source_url", "page_content")
    lists = retrieved(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(doc)).alias("docs"))
    return lists.select("query_id", F.sha2(answers.rerank_prompt(F.col("docs")).cast("binary"), 256).alias("prompt_sha256"))


@query(f"""with {RETRIEVED}, of_one as (select query_id // 4 as query_id, query_id % 4 as ordinal, string_agg(rank || '=' || doc_id, ',' order by rank) as r from hits group by all),
traced as (select query_id, string_agg(ordinal || ':' || r, ';' order by ordinal) as traces from of_one group by query_id)
select query_id, traces from traced""".replace("group by all", "group by query_id // 4, query_id % 4"))
def retrieval_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranked_documents(spark, sf_dir, 10).select(F.expr("query_id div 4").alias("query_id"), (F.col("query_id") % 4).alias("ordinal"), (F.col("query_id") % 4).cast("string").alias("query"), "rank", F.struct("doc_id").alias("doc"))
    trace = fusion.diagnostics(hits, hits.where("ordinal = 0").select("query_id", "rank", "doc"))
    one = F.transform("retrieved_by_query", lambda x: F.concat(x["query"], F.lit(":"), F.array_join(F.transform(x["results"], lambda y: F.concat(y["rank"].cast("string"), F.lit("="), y["doc"]["doc_id"].cast("string"))), ",")))
    return trace.select("query_id", F.array_join(one, ";").alias("traces"))


# Conversations

HISTORY = "select conv_id, turn, role, text, string_agg(role || ': ' || text, chr(10)) filter (where role in ('user', 'assistant')) over w as h, count(*) filter (where role in ('user', 'assistant')) over w as n from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)"


@query(f"select conv_id, turn, text as question, cast(n as integer) as n_messages, sha256(coalesce(h, '')) as history_sha256 from ({HISTORY}) where role = 'user'")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return answers.chat_history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "question", F.size("history").alias("n_messages"), F.sha2(talk.cast("binary"), 256).alias("history_sha256"))


@query(f"select conv_id, turn, case when n = 0 then text else 'rewritten: ' || text end as standalone_question from ({HISTORY}) where role = 'user'")
def standalone_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a stand-in for the model that repeats the question at the end of its prompt."""
    from quarry.plans import chain

    said = chain.standalone(answers.chat_history(table(spark, sf_dir, "conversations")).withColumn("query_id", F.col("conv_id")), lambda ps: ["rewritten: " + p.rsplit("user: ", 1)[1] for p in ps])
    return said.select("conv_id", "turn", "standalone_question")


# Evaluation

EXTRA_REFUSALS = (*evaluation.REFUSALS, "tion the", "in of")


@query("select conv_id, turn, " + " or ".join("contains(lower(text), '" + p.replace("'", "''") + "')" for p in EXTRA_REFUSALS) + " as refused from conversations where role = 'assistant'")
def refusal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", evaluation.refused(F.col("text"), EXTRA_REFUSALS).alias("refused"))


@query(f"with {RETRIEVED} select query_id, bool_or(contains(lower(url), '/src' || query_id % 20)) as hit from hits where rank <= 5 group by query_id")
def retrieval_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = retrieved(spark, sf_dir).where("rank <= 5").groupBy("query_id").agg(F.collect_list("source_url").alias("urls"))
    needle = F.array(F.concat(F.lit("/SRC"), (F.col("query_id") % 20).cast("string")))
    return lists.select("query_id", evaluation.url_hit(F.col("urls"), needle).alias("hit"))


@query(f"with {RETRIEVED} select query_id, bool_or(contains(lower(url), '/src' || query_id % 20)) as hit from hits group by query_id")
def citation_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = answers.cited_sources(retrieved(spark, sf_dir)).groupBy("query_id").agg(F.collect_list("url").alias("urls"))
    needle = F.array(F.concat(F.lit("/SRC"), (F.col("query_id") % 20).cast("string")))
    return lists.select("query_id", evaluation.url_hit(F.col("urls"), needle).alias("hit"))


JUDGED = """judged as (select l.doc_id as id, case when l.doc_id % 2 = 0 then 'best' else 'fast' end as mode, case when l.doc_id % 5 <> 0 then l.quality = 1 end as retrieval_pass, l.toxic = 0 as faithfulness_pass,
case when l.doc_id % 3 <> 0 then l.doc_id % 8 <> 0 end as relevance_pass, case when l.doc_id % 2 = 0 then l.quality = 1 end as citation_pass, l.doc_id % 7 <> 0 as refusal_pass, d.text as answer from labels l join documents d using (doc_id))"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose metrics follow from labels and ids."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("answer")), "doc_id")
    return rows.select(
        k.alias("id"), F.when(k % 2 == 0, "best").otherwise("fast").alias("mode"), F.when(k % 5 != 0, F.col("quality") == 1).alias("retrieval_pass"), (F.col("toxic") == 0).alias("faithfulness_pass"),
        F.when(k % 3 != 0, k % 8 != 0).alias("relevance_pass"), F.when(k % 2 == 0, F.col("quality") == 1).alias("citation_pass"), (k % 7 != 0).alias("refusal_pass"), "answer",
    )


@query("with " + JUDGED + " select mode, " + ", ".join(f"case when count({m}_pass) > 0 then cast(cast(round_even(100.0 * count(*) filter (where {m}_pass) / count({m}_pass), 0) as integer) as varchar) || '%' else '—' end as {m}" for m in evaluation.METRICS) + " from judged group by mode")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(judged(spark, sf_dir))


@query("with " + JUDGED + " select id, failed, shown from (select id, concat_ws(', ', " + ", ".join(f"case when not {m}_pass then '{m}' end" for m in evaluation.METRICS) + ") as failed, left(answer, 200) || '…' as shown from judged) where failed <> ''")
def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.failures(judged(spark, sf_dir)).select("id", "failed", "shown")


RESUME = """cases as (select item_id as id, text as question, 'c' || item_id % 3 as category, case when item_id % 5 = 0 then 'refuse' else 'answer' end as expected_behavior from benchmark),
saved as (select id, case when id % 3 = 0 then question || ' old' else question end as question, category, expected_behavior, 'first' as answer, id as line_no from cases where id % 4 <> 1
union all select id, question, category, expected_behavior, 'second', 100000 + id from cases where id % 2 = 0),
latest as (select * from (select s.*, row_number() over (partition by s.id order by line_no desc) as n from saved s join cases c on s.id = c.id and s.question = c.question and s.category = c.category and s.expected_behavior = c.expected_behavior) where n = 1)"""


def resumed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"), F.when(F.col("item_id") % 5 == 0, "refuse").otherwise("answer").alias("expected_behavior"))
    first = cases.where("id % 4 <> 1").select("id", F.when(F.col("id") % 3 == 0, F.concat("question", F.lit(" old"))).otherwise(F.col("question")).alias("question"), "category", "expected_behavior", F.lit("first").alias("answer"), F.col("id").alias("line_no"))
    second = cases.where("id % 2 = 0").select("id", "question", "category", "expected_behavior", F.lit("second").alias("answer"), (F.lit(100000) + F.col("id")).alias("line_no"))
    return cases, first.unionByName(second)


@query(f"with {RESUME} select id, answer, line_no from latest")
def eval_resume_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latest_saved(*resumed(spark, sf_dir)).select("id", "answer", "line_no")


@query(f"with {RESUME} select id, question from cases where id not in (select id from latest)")
def eval_resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.todo(*resumed(spark, sf_dir)).select("id", "question")


ANSWERS = f"""{RETRIEVED},
lists as (select query_id, bool_or(contains(lower(url), '/src' || query_id % 20)) as hit from hits group by query_id)"""


@query(f"""with {ANSWERS}
select item_id as query_id, case when item_id % 4 <> 0 then coalesce(hit, false) end as retrieval_pass, case when item_id % 5 <> 0 then hit is not null and item_id % 3 = 0 end as faithfulness_pass,
case when item_id % 5 <> 0 then item_id % 2 = 0 end as relevance_pass, case when item_id % 4 <> 0 then coalesce(hit, false) end as citation_pass, (item_id % 6 = 0) = (item_id % 5 = 0) as refusal_pass
from benchmark left join lists on item_id = query_id""".replace("hit is not null and item_id % 3 = 0", "case when hit is not null then item_id % 3 = 0 end"))
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = retrieved(spark, sf_dir).groupBy("query_id").agg(F.collect_list("source_url").alias("retrieved_urls"))
    k = F.col("query_id")
    rows = benchmark_queries(spark, sf_dir).join(lists, "query_id", "left").select(
        "query_id", F.coalesce("retrieved_urls", F.array().cast("array<string>")).alias("retrieved_urls"), F.when(k % 4 != 0, F.array(F.concat(F.lit("/src"), (k % 20).cast("string")))).alias("must_cite_url_contains"),
        F.when(k % 5 == 0, "refuse").otherwise("answer").alias("expected_behavior"), F.when(k % 6 == 0, "I'm sorry, no.").otherwise("Yes.").alias("answer"), F.when(k % 3 == 0, " yes, it is").otherwise("No").alias("faithful"), F.when(k % 2 == 0, "YES").otherwise("NO").alias("relevant"),
    ).withColumn("source_urls", F.col("retrieved_urls"))
    return evaluation.scored(rows).select("query_id", *(f"{m}_pass" for m in evaluation.METRICS))
