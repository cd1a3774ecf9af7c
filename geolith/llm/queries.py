"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, line_dedup, packing, pitman_yor, quality, simhash, toxicity, url_filter
from .common import bucket, labelled_sample

import public_tokenizers


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet").drop("locator")


OP3_SQL = """
with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return views.select("conv_id", "speaker", "part", "n_turns", "n_spoken", "rendered", spans.alias("mask_spans"))


OP4_SQL = """
with t as (
  select conv_id, case when turn is null then -1152921504606846976 else cast(floor(turn / 256.0) as bigint) end as part, turn,
         nullif(role, '') as role,
         replace(replace(translate(coalesce(nullif(role, ''), 'unknown'), chr(13) || chr(10), '  '), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') as name,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') as text
  from conversations),
s as (select distinct conv_id, role as speaker from t),
p as (select distinct conv_id, part from t),
v as (
  select s.conv_id, s.speaker, p.part, t.turn, t.role, t.text, t.role is not distinct from s.speaker as own,
         '<|im_start|>' || case when t.role is not distinct from s.speaker then 'assistant' else 'user name=' || t.name end || chr(10) as head,
         t.text || '<|im_end|>' || chr(10) as body
  from s join p on p.conv_id is not distinct from s.conv_id
  join t on t.conv_id is not distinct from p.conv_id and t.part = p.part),
o as (
  select *, sum(length(head) + length(body)) over (partition by conv_id, speaker, part order by turn nulls first, role nulls first, text rows unbounded preceding) as stop from v)
select conv_id, speaker, part, count(*) as n_turns, count(*) filter (own) as n_spoken,
       string_agg(head || body, '' order by turn nulls first, role nulls first, text) as rendered,
       coalesce(string_agg(cast(stop - length(body) as bigint) || '-' || cast(stop as bigint), ',' order by turn nulls first, role nulls first, text) filter (own), '') as mask_spans
from o group by conv_id, speaker, part
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_overlaps(docs, items)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


OP5_SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
il as (select item_id, w, least(8, len(w)) as k from iw where len(w) > 0),
iwin as (select distinct item_id, k, array_to_string(w[p : p + k - 1], ' ') as g from (select *, unnest(range(1, len(w) - k + 2)) as p from il)),
ks as (select distinct k from iwin),
dwin as (select doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from dw, ks where len(w) >= k)),
h as (select d.doc_id, d.p, d.k, i.item_id from dwin d join iwin i on i.k = d.k and i.g = d.g),
nh as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from (select distinct doc_id, p, k from h)) group by doc_id),
ni as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from h) group by doc_id)
select dw.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from dw left join nh using (doc_id) left join ni using (doc_id)
"""


def op6_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(labelled_sample(docs, labels, "toxic", 5, 0, toxicity.BOUND))
    scored = toxicity.score(docs, model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return scored.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), spans.alias("spans"))


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, *quality.fit(labelled_sample(docs, labels, "quality", 4, 2, quality.BOUND)))
    return scored.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad: a page's number in its path names the document it shows; bad is low quality or toxic, null if unlabelled."""
    _, path = url_filter.split_url(F.col("url"))
    shown = F.regexp_extract(path, r"^/[^/]+/([0-9]{1,18})", 1)
    judged = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return pages.select("url", F.when(shown != "", shown.cast("long")).alias("doc_id")).join(judged, "doc_id", "left").select("url", "bad")


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return url_filter.filter_urls(pages, page_outcomes(pages, labels)).drop("bad_rate_low")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shortest=1)
    return found.select("doc_id", "n_lines", "n_dropped", "n_links", "first_docs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_pitman_yor, op2_simhash, op3_exact_dedup, op4_chat_rotation, op5_decontamination, op6_toxicity_crf, op7_quality_ftrl, op8_packing, op9_url_reputation, op10_line_dedup)}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op4_chat_rotation": OP4_SQL, "op5_decontamination": OP5_SQL}
