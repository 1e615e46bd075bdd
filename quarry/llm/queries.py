"""One query for each operator, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, leave_on_exit, shared_folder, table


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.simhash import hex_of, simhash_components

    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from quarry.llm.binary import read_tokens, write_tokens

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    leave_on_exit(spark, path)
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path)


def op1_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.lm import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 7) == 2
    return score(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import fit, toxicity

    docs, held = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontaminate import contamination

    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.licenses import license_scan

    got = license_scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.sharding import assign

    got = assign(table(spark, sf_dir, "documents"), 8)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality import fit, quality, tallied

    docs, held = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 4) == 2
    tally = tallied(docs, bags=True)
    vectors, network = fit(docs, table(spark, sf_dir, "labels"), ~held, tally=tally)
    return quality(docs, vectors, network, tally=tally).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.extract import fit, main_text

    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit(pages))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP4_SQL = r"""
with d as (select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bi as (select item_id, w, least(10, len(w)) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as k from bi),
sizes as (select distinct n from bw),
di as (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
dw as (select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as k from di),
hit as (select distinct dw.rid, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.k = bw.k),
words as (select rid, count(*) as n_hit from (select distinct rid, unnest(range(i, i + n)) as p from hit) group by rid),
items as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as listed from (select distinct rid, cast(item_id as varchar) as item_id from hit) group by rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(words.n_hit, 0) as n_hit, coalesce(items.n_items, 0) as n_items,
  sha256(coalesce(items.listed, '')) as items_sha256, coalesce(words.n_hit, 0) > 0 as contaminated
from d left join words on d.rid = words.rid left join items on d.rid = items.rid
"""
OP7_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""
OP13_SQL = """
with o as (select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
    order by turn nulls first, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as s
  from conversations where conv_id is not null group by conv_id),
bytes as (select conv_id, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint)) as b from o),
crc as (select conv_id, xor(list_reduce(list_prepend(4294967295, b), lambda c, x:
    list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 as h from bytes),
built as (select o.conv_id, list_concat(coalesce(p.s[1:crc.h], []), o.s[crc.h + 1:]) as s from o join crc on o.conv_id = crc.conv_id left join o p on p.conv_id = o.conv_id - o.conv_id % 5),
members as (select conv_id, d as depth, s[1:d] as k, len(s) = d as ends from (select *, unnest(range(0, len(s) + 1)) as d from built)),
nodes as (select k, depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256 from members group by k, depth),
kids as (select k[1:depth - 1] as k, count(*) as n from nodes where depth > 0 group by 1),
under as (select g.k[1:g.j] as k, cast(sum(case when c.n is null then 1 else 0 end) as bigint) as n_leaves,
    cast(sum((g.n_convs - 1) * case when g.depth > 0 then strlen(g.k[g.depth].t) else 0 end) as bigint) as saved_tokens
  from (select *, unnest(range(0, depth + 1)) as j from nodes) g left join kids c on g.k = c.k group by 1)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(kids.n, 0) as n_children, under.n_leaves, under.saved_tokens, n.ends_sha256
from nodes n join under on n.k = under.k left join kids on n.k = kids.k left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.k = n.k[1:n.depth - 1]
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_log_bilinear, op2_toxicity, op3_sentencepiece, op4_decontaminate, op5_simhash, op6_license_scan, op7_top_k, op8_ring_shards, op9_token_files, op10_quality, op11_html_extraction, op12_whitening, op13_prefix_trie, pipeline)
}
ORACLES: dict[str, str] = {"op4_decontaminate": OP4_SQL, "op7_top_k": OP7_SQL, "op13_prefix_trie": OP13_SQL}
