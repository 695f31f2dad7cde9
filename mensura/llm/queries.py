"""Registered queries of the corpus operators, with DuckDB twins where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mensura.llm import bpe_codec, decontaminate, filter_audit, jaccard, language, lexical, lm_score, quality, sharding, simhash, token_counts, topk, warc
from mensura.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = decontaminate.phrase_blocks(table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(table(spark, sf_dir, "documents"), blocks).drop("spans")


OP2_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
starts as (
  select item_id, w, unnest(range(1, greatest(2, len(w) - 11))) as i from item_words where len(w) > 0),
phrases as (
  select distinct item_id, array_to_string(w[i : i + 12], ' ') as p, len(w[i : i + 12]) as n from starts),
places as (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
  from words, (select distinct n from phrases) where len(w) >= n),
found as (
  select doc_id, i, n, item_id from (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as p from places)
  join phrases using (p, n)),
hit as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(list, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit using (doc_id) left join items using (doc_id)
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


OP3_SQL = """
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
q as (
  select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, 1 + 5 * (i // 4), 5) as bigint)
      >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint), 1)), '') as payload_digest from p),
r as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first from q)
select page_id, payload_bytes, payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
  case when first <> page_id then first end as refers_to from r
"""


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s)
select query_id, cast(place as integer) as rank, vec_id, score from r where place <= 5
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.languages(docs, language.fit(docs))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encoded_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_texts(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end) as s
  from words where len(w) > 0),
grams as (select doc_id, len(s) as n, hash(g) as g from (select doc_id, s, unnest(s) as g from sets)),
ranked as (select doc_id, n, g, row_number() over (partition by doc_id order by df, g) as place
  from grams join (select g, count(*) as df from grams group by g) using (g)),
prefixes as (select doc_id, n, g from ranked where place <= n - cast(ceil(0.85 * n) as bigint) + 1),
pairs as (select distinct a.doc_id as a, b.doc_id as b from prefixes a join prefixes b using (g)
  where a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links as (
  select a, b from pairs join grams x on x.doc_id = a join grams y on y.doc_id = b and x.g = y.g
  group by a, b, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
edges as (select a, b from links union all select b, a from links),
reach(id, other) as (
  select doc_id, doc_id from documents union select r.id, e.b from reach r join edges e on r.other = e.a)
select d.doc_id, cast(coalesce(len(s), 0) as bigint) as n_shingles, c.component_id
from documents d left join sets using (doc_id) join (select id, min(other) as component_id from reach group by id) c on c.id = d.doc_id
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
f as (
  select doc_id, part, cast(len(ws) < 200 as int) + 2 * cast(100 * len(list_distinct(ws)) < 50 * len(ws) as int)
    + 4 * cast(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) as int)
    + 8 * cast(regexp_matches(t, '[#$%&*|]') as int)
    + 16 * cast(coalesce(doc_id > min(doc_id) over (partition by t), false) as int) as mask from w),
l as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
cells as (
  select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
  from f left join l using (doc_id) group by part, mask),
s as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
orders as (
  select s1.c || s2.c || s3.c || s4.c || s5.c as filter_order, [s1.b, s2.b, s3.b, s4.b, s5.b] as bits
  from s s1, s s2, s s3, s s4, s s5 where s1.b + s2.b + s3.b + s4.b + s5.b = 31
    and len(list_distinct([s1.b, s2.b, s3.b, s4.b, s5.b])) = 5),
steps as (
  select filter_order, k as step, bits[k] as bit, coalesce(list_sum(bits[1 : k - 1]), 0) as earlier
  from (select *, unnest([1, 2, 3, 4, 5]) as k from orders)),
r as (
  select part, filter_order, step, bit,
    sum(case when mask & (earlier + bit) = 0 then n else 0 end) as kept,
    sum(case when mask & bit > 0 and mask & earlier = 0 then n else 0 end) as removed,
    sum(case when mask & bit > 0 and mask & earlier > 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & bit > 0 and mask & earlier = 0 then good else 0 end) as good_lost,
    sum(case when mask & bit > 0 and mask & earlier = 0 then toxic else 0 end) as toxic_lost
  from cells, (select filter_order, step, bit, cast(earlier as int) as earlier from steps) group by part, filter_order, step, bit)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley from r
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
item_terms as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
total as (select cast(count(*) as bigint) as n_docs, cast(sum(len(w)) as bigint) as n_terms from words where len(w) > 0),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from words)
  where term in (select term from item_terms) group by doc_id, term),
weights as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as weight
  from tf, total group by term, n_docs),
m as (select doc_id, 50 + (50 * len(w) * n_docs) // n_terms as m from words, total where len(w) > 0),
parts as (select doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * m)) as part from tf join weights using (term) join m using (doc_id)),
scored as (select item_id, doc_id, cast(sum(part) as bigint) as score from item_terms join parts using (term) group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from scored where score > 0)
select item_id, cast(place as integer) as rank, doc_id, score from ranked where place <= 50
"""


QUERIES = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_lm_score": op4_lm_score,
    "op5_simhash": op5_simhash,
    "op6_topk": op6_topk,
    "op7_language": op7_language,
    "op8_sharding": op8_sharding,
    "op9_token_counts": op9_token_counts,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_filter_audit": op12_filter_audit,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op6_topk": OP6_SQL,
    "op11_jaccard_join": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
