"""The registered queries of the corpus operators and their check SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, importance_resampling, jaccard_join, licenses, mixing, pii, quality, sentence_pieces, structure_repair, suffix_dedup, token_rollups, topk, warc
from .common import kept_table, new_folder, table


def op1_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, d, "documents")).drop("spans")


def op2_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, d, "documents"), table(spark, d, "labels"))


#: Key of the surrogates; a real one comes from the environment.
PII_KEY = os.environ.get("SURROGATE_KEY", "surrogates of the test tables").encode()


def op3_surrogates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs, key=PII_KEY, count="n_entities")


def op4_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"))


def op5_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mix(table(spark, d, "documents")).taken()


RANKS = os.environ.get("TOKEN_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def op6_token_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Three batches: all documents come in, those labelled bad go, and those labelled toxic are counted anew in lower
    case, as a cleaning step would leave them. The second batch is sent twice, and totals are kept after it."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # both counts in one pass: texts are never shuffled
    counted = token_rollups.with_tokens(token_rollups.with_tokens(docs, RANKS).withColumn("low", F.lower("text")), RANKS, text="low", out="new").drop("low")
    counted = kept_table(counted.drop("text").withColumn("tokenizer", F.lit("byte_bpe_50k/1")), "token-counts")
    store = new_folder(spark, "token-store")
    change = lambda rows, op: rows.withColumn("op", F.lit(op)).withColumn("old_tokens", F.lit(None).cast("long"))
    token_rollups.commit(store, "0001", change(counted, "insert"))
    gone = change(counted.join(marks.filter("quality = 0"), "doc_id", "left_semi"), "delete")
    for _ in range(2):
        token_rollups.commit(store, "0002", gone)
    token_rollups.snapshot(spark, store)
    revised = counted.join(marks.filter("quality = 1 and toxic = 1"), "doc_id", "left_semi")
    revised = revised.withColumnsRenamed({"tokens": "old_tokens", "new": "tokens"}).withColumn("op", F.lit("revise"))
    token_rollups.commit(store, "0003", revised)
    return token_rollups.totals(spark, store)


def op7_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.search(topk.build_index(table(spark, d, "embeddings")))


#: Vocabulary file of the encoding; another one is named by the environment.
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return sentence_pieces.piece_digests(table(spark, d, "documents"), MODEL)


def op8_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, d, "documents")).drop("spans")


def op10_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.JaccardJoin(table(spark, d, "documents")).documents().select("doc_id", "n_shingles", "component_id")


def op11_chat(spark: SparkSession, d: str) -> DataFrame:
    """The log of all conversations and of one more, whose texts are control strings, folded, rendered and read back."""
    said = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(said)
    return chat_format.read_back(chat_format.format_conversations(chat_format.conversation_log(rows)))


def op12_structure(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return structure_repair.Repair(structure_repair.damaged(rows)).report(rows)


def op13_resampling(spark: SparkSession, d: str) -> DataFrame:
    return importance_resampling.resample(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_licenses, op2_quality, op3_surrogates, op4_warc, op5_mixing, op6_token_rollups, op7_topk, op8_suffix_dedup, op9_pieces, op10_jaccard,
                                   op11_chat, op12_structure, op13_resampling)}
ORACLES: dict[str, str] = {
    "op7_topk": """
with v as (select vec_id, row_number() over () as no, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
           from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, q.no as qno, c.vec_id, c.no, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
      from v q join v c on q.no <> c.no where q.vec_id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by qno order by score desc, vec_id nulls last, no) as rank from s) t where rank <= 20""",
    "op4_warc": r"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages),
d as (select *, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             ((cast('0x' || substr(h, 5 * g + 1, 5) as integer) >> s) & 31) + 1, 1)), '')), '') as digest from p),
f as (select *, min(page_id) over (partition by digest) as first from d)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to from f""",
    "op10_jaccard": r"""
with recursive d as (select row_number() over () as no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select no, unnest(ws) as a, unnest(range(len(ws))) as pos from d where len(ws) >= 5),
s as (select distinct no, sh from (
        select no, concat_ws(' ', a, lead(a, 1) over o, lead(a, 2) over o, lead(a, 3) over o, lead(a, 4) over o) as sh, lead(a, 4) over o as last from w window o as (partition by no order by pos)) q where last is not null
      union all select no, array_to_string(ws, ' ') from d where len(ws) between 1 and 4),
n as (select no, count(*) as n from s group by no),
pairs as (select x.no as a, y.no as b, count(*) as shared from s x join s y on x.sh = y.sh and x.no < y.no group by all),
links as (select a, b from pairs join n na on na.no = a join n nb on nb.no = b where 100 * shared >= 75 * (na.n + nb.n - shared)),
edges as (select a, b from links union all select b, a from links),
reach as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
least_of as (select a as no, min(doc_id) as m from reach join d on d.no = b group by a)
select doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id from d left join n using (no) left join least_of using (no)""",
    "op11_chat": r"""
with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations
           union all select -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
m as (select *, len(regexp_extract_all(coalesce(role, '') || chr(10) || text, '<\\*(\|turn\|>|\|text\|>|\|end\|>|s>|/s>)|\[\\*(INST\]|/INST\])')) as marks from c),
t as (select conv_id, count(*) as n_turns, string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by turn nulls first, role nulls first, text) as told,
             coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role nulls first, text), '') as learnt,
             cast(sum(length(coalesce(role, '')) + length(text) + marks + length('<|turn|><|text|><|end|>')) as bigint) as formatted_chars
      from m group by conv_id)
select conv_id, n_turns, sha256(told) as turns_sha256, length(learnt) as loss_chars, sha256(learnt) as loss_sha256, formatted_chars from t""",
    # least cost, then least audit, of all edits in each grammar state, from the last turn back
    "op12_structure": r"""
with recursive crc as (select list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as steps
             from range(256) r(i)),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
             hex(encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))) as h from conversations),
x as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
                    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 20 as d from k, crc),
g as (select conv_id, turn, case when d = 4 then 'user' else role end as role,
             case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when d = 3 then 2 else 1 end)) as copy from x where d <> 0),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos, count(*) over (partition by conv_id) as n from g),
f as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
             when regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
             lag(role) over (partition by conv_id order by pos) as before from p),
t as (select *, case when fault = 'truncated' then 1 else 0 end as cut, fault not in ('blank', 'duplicate') as stays, substr(role, 1, 1) as r from f),
go as (select distinct conv_id, n + 1 as pos, {c: 0, a: ''} as f0, {c: 4, a: 'II'} as f1, {c: 2, a: 'I'} as f2, {c: 0, a: ''} as f3 from t
       union all
       select conv_id, pos, list_min([s0, {c: least_u.c + 2, a: 'I' || least_u.a}]), list_min([s1, {c: least_u.c + 2, a: 'I' || least_u.a}]), least_u, least_a from (
         select *, list_min([s2, {c: s3.c + 2, a: 'I' || s3.a}]) as least_u, list_min([s3, {c: s2.c + 2, a: 'I' || s2.a}]) as least_a from (
           select t.conv_id, t.pos,
             list_min(list_filter([{c: f0.c + 3, a: 'D' || f0.a}, case when stays then {c: f2.c + 2 + cut, a: 'R' || f2.a} end,
               case when stays and r = 's' then {c: f1.c + cut, a: 'K' || f1.a} when stays and r = 'u' then {c: f2.c + cut, a: 'K' || f2.a} end], lambda o: o is not null)) as s0,
             list_min(list_filter([{c: f1.c + 3, a: 'D' || f1.a}, case when stays then {c: f2.c + 2 + cut, a: 'R' || f2.a} end,
               case when stays and r = 'u' then {c: f2.c + cut, a: 'K' || f2.a} end], lambda o: o is not null)) as s1,
             list_min(list_filter([{c: f2.c + 3, a: 'D' || f2.a}, case when stays then {c: f3.c + 2 + cut, a: 'R' || f3.a} end,
               case when stays and r = 'a' then {c: f3.c + cut, a: 'K' || f3.a} end], lambda o: o is not null)) as s2,
             list_min(list_filter([{c: f3.c + 3, a: 'D' || f3.a}, case when stays then {c: f2.c + 2 + cut, a: 'R' || f2.a} end,
               case when stays and r = 'u' then {c: f2.c + cut, a: 'K' || f2.a} end], lambda o: o is not null)) as s3
           from go join t on go.conv_id is not distinct from t.conv_id and go.pos = t.pos + 1) q) q),
best as (select conv_id, f0.c as cost, f0.a as audit from go where pos = 1),
l as (select conv_id, substr(audit, i, 1) as letter, i, i - len(replace(substr(audit, 1, i), 'I', '')) as inserted from (select *, unnest(range(1, len(audit) + 1)) as i from best) q),
o as (select l.conv_id, letter, l.i, t.role, t.text, row_number() over (partition by l.conv_id order by l.i) as place
      from l left join t on l.conv_id is not distinct from t.conv_id and letter <> 'I' and t.pos = l.i - l.inserted where letter <> 'D'),
e as (select *, first_value(letter = 'K' and substr(role, 1, 1) = 's') over (partition by conv_id order by place) as lead from o),
h as (select conv_id, sha256(string_agg(case when letter = 'K' then role when (place - cast(coalesce(lead, false) as integer)) % 2 = 1 then 'user' else 'assistant' end || ':'
             || case when letter = 'I' then '' else text end, chr(10) order by place)) as repaired from e group by conv_id),
s as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
             count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and substr(before, 1, 1) || substr(role, 1, 1) not in ('su', 'ua', 'au')) as illegal from t group by conv_id)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       cast(coalesce(cost, 0) as bigint) as cost, coalesce(audit, '') as audit, coalesce(repaired, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) i left join s on s.conv_id is not distinct from i.conv_id left join best b on b.conv_id is not distinct from i.conv_id left join h on h.conv_id is not distinct from i.conv_id""",
    # CRC-32 by its table of 256 steps, over the bytes of each distinct n-gram
    "op13_resampling": r"""
with crc as (select list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as steps
             from range(256) r(i)),
texts as (select row_number() over () as no, doc_id, text, false as aim from documents union all select row_number() over (), null, text, true from benchmark),
w as (select no, doc_id, aim, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from texts),
f as (select no, aim, unnest(list_concat(ws, list_transform(list_zip(ws[:-2], ws[2:]), lambda p: p[1] || ' ' || p[2]))) as f from w where len(ws) > 0),
c as (select no, aim, f, count(*) as n from f group by all),
b as (select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(hex(encode(f))) // 2), lambda i: cast('0x' || substr(hex(encode(f)), 2 * i + 1, 2) as bigint))),
                    lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket
      from (select distinct f from c) d, crc),
e as (select no, aim, bucket, sum(n) as n from c join b using (f) group by all),
g as (select bucket, coalesce(sum(n) filter (aim), 0) as t, coalesce(sum(n) filter (not aim), 0) as s from e group by bucket),
l as (select bucket, floor(1000 * ln(((t + 1)::double * ((select sum(s) from g) + 10000)::double) / ((s + 1)::double * ((select sum(t) from g) + 10000)::double))) as gain from g),
d as (select no, sum(n) as n, floor(sum(n * gain) / sum(n)) as weight from e join l using (bucket) where not aim group by no),
r as (select w.no, doc_id, len(ws) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296))) as score
      from w left join d on w.no = d.no where not aim),
k as (select no, row_number() over (order by score desc, doc_id nulls last, n_features) as rank, count(*) over () as total from r where n_words >= 20)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
       case when rank <= 25 * total // 100 then rank end as rank from r left join k using (no)""",
}
