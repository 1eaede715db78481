"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embed_dedup, hmm, html, langid, minhash, pii, quality, sentencepiece, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text again."""
    docs, model = _table(spark, sf_dir, "documents"), sentencepiece.Model()
    back = sentencepiece.decode(sentencepiece.encode(docs, model), model)
    return back.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.col("text"), 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), sentencepiece.Model()).withColumnRenamed("id", "doc_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html.extract_pages(pages, carry=["url"]).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["e"] - s["s"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sensitive_spans(_table(spark, sf_dir, "documents"))
    counts = [F.size(_of_kind(kind)).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def _of_kind(kind: str):
    return F.filter("base", lambda s: s["kind"] == kind)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.similar(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_token_counts, op3_html_extraction, op4_language_id, op5_quality, op6_decontamination, op7_pii, op8_embedding_dedup, op9_minhash_dedup, op10_lm_scoring)}


# Components: what each id reaches over links (a, b) given both ways.
_REACH = "reach as (select id, id as other from ids union select reach.id, l.b from reach join links l on l.a = reach.other), parts as (select id, min(other) as component_id from reach group by id)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id::varchar as item, {_WORDS} as w from benchmark where text is not null),
win as (select distinct item, least(10, len(w)) as m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as win from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(i) where len(w) > 0),
lengths as (select distinct m from win), place as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as win from d, lengths, unnest(range(1, len(w) - m + 2)) u(i)),
hit as (select doc_id, place.m, i, item from place join win on win.m = place.m and win.win = place.win),
words as (select doc_id, count(distinct k)::bigint as n_hit from hit, unnest(range(i, i + m)) u(k) group by 1),
items as (select doc_id, count(*)::bigint as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hit) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join words using (doc_id) left join items using (doc_id)"""

EMBEDDINGS = f"""with recursive v as (select vec_id as id, embedding::double[] as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select id, v, sqrt(list_inner_product(v, v)) as n from v), links as (select x.id as a, y.id as b from u x join u y on x.id <> y.id and len(x.v) = len(y.v) where list_inner_product(x.v, y.v) / (x.n * y.n) >= 0.9),
ids as (select distinct vec_id as id from embeddings), {_REACH}
select id as vec_id, (select count(*) from links where a = id)::bigint as n_links, component_id, id = component_id as kept from parts"""

NEAR_DUPLICATES = f"""with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + least(2, len(w)) - 1], ' ') as g from d, unnest(range(1, len(w) - least(2, len(w)) + 2)) u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
common as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from common join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
ids as (select distinct doc_id as id from documents), {_REACH}
select id as doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, id = component_id as kept from parts left join n on n.doc_id = id"""


def oracle_sql() -> dict[str, str]:
    """SQL of what plain SQL can express; models, merges of pieces, markup and added spans are tested by brute force."""
    return {"op6_decontamination": DECONTAMINATION, "op8_embedding_dedup": EMBEDDINGS, "op9_minhash_dedup": NEAR_DUPLICATES}
