"""The registered queries of this subpackage and their DuckDB restatements."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.common import table
from corpuskit.session import scratch_path

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.packing import pack

    packed = pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), max_tokens=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = train(docs.where(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), ["doc_id", "held_out"], model)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.quality import judge

    judged = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.tokenfiles import read_token_files, write_token_files

    manifest = write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"), _vocabulary("word_bpe_49k.json"), end_id=2)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.decontaminate import decontaminate

    judged = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.substrings import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.pii import KINDS, detect, of_kind, told

    found = detect(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.size(F.filter("base", functools.partial(of_kind, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc.doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.concat("base", "added")).alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.linededup import dedup_lines

    deduped = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", F.col("lines_seen").alias("n_lines"), F.col("lines_gone").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.periodic import find_runs, periodic_tail

    found = find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], exponent=4, least=6, tail=periodic_tail)
    longer = lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), longer)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    step = found.select("doc.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return step.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.blockanchors import remove_passages

    return remove_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuskit.llm.convtrie import prefix_trie, rebuilt

    convs, turns = rebuilt(table(spark, sf_dir, "conversations"))
    return prefix_trie(convs, turns).drop("a", "b")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_token_files": op4_token_files,
    "op5_url_filter": op5_url_filter,
    "op6_decontaminate": op6_decontaminate,
    "op7_substrings": op7_substrings,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_personal_data": op9_personal_data,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_passage_dedup": op12_passage_dedup,
    "op13_conversation_trie": op13_conversation_trie,
}

# CRC-32 of a whole number's digits, bit by bit
_CRC32 = ("xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}::varchar) + 1), lambda i: ascii(substr({0}::varchar, i::integer, 1))::bigint)),"
          " lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))")

SQL: dict[str, str] = {
    "op5_url_filter": r"""
with parts as (
  select page_id,
         case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
split as (
  select page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts),
rules(rule, rhost, rpath, verdict) as (
  values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best as (
  select page_id, host, path,
         (select max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) from rules
          where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as r
  from split)
select page_id, host, path, r.rule as rule, coalesce(r.verdict, 'allow') as verdict from best
""",
    "op6_decontaminate": r"""
with d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
bl as (select item_id, w, least(13, len(w)) as n from b where len(w) > 0),
bs as (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as s from bl),
bw as (select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as words from bs),
lens as (select distinct n from bw),
ds as (select rid, w, n, unnest(range(1, len(w) - n + 2)) as s from d, lens where len(w) >= n),
hit as (
  select rid, s, n, words from (select rid, s, n, array_to_string(w[s:s + n - 1], ' ') as words from ds)
  where words in (select words from bw)),
cover as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + n)) as p from hit) group by rid),
items as (
  select rid, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
  from hit join bw using (words) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join cover using (rid) left join items using (rid)
""",
    "op3_quality": r"""
with d as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l
  from documents),
g as (select rid, i, w[i:i + 2] as t from (select rid, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
g2 as (select rid, i, count(*) over (partition by rid, t) as c from g),
r as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 3)) as p from g2 where c > 1) group by rid),
m as (
  select rid, doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(l) as n_lines,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from d left join r using (rid)),
v as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         case when n_words > 0 then 1000 * n_symbols // n_words end as v1, case when n_words > 0 then 1000 * n_dup_lines // n_lines end as v2,
         case when n_words > 0 then 1000 * n_repeat_words // n_words end as v3, case when n_words > 0 then 100 * word_chars // n_words end as v4
  from m),
x as (
  select lang, source, metric, (val >> greatest(0, length(bin(val)) - 10)) << greatest(0, length(bin(val)) - 10) as bucket
  from (select lang, source, unnest([{'m': 1, 'v': v1}, {'m': 2, 'v': v2}, {'m': 3, 'v': v3}, {'m': 4, 'v': v4}]) as p from v where not base_failed),
       lateral (select p.m as metric, p.v as val)),
q0 as (select lang, source, metric, count(*) as n, quantile_disc(bucket, [0.125, 0.25, 0.5, 0.75, 0.875]) as q from x group by all),
q1 as (select lang, metric, count(*) as n, quantile_disc(bucket, [0.125, 0.25, 0.5, 0.75, 0.875]) as q from x group by all),
q2 as (select metric, count(*) as n, quantile_disc(bucket, [0.125, 0.25, 0.5, 0.75, 0.875]) as q from x group by all),
q as (
  select q0.lang, q0.source, q0.metric,
         list_transform([1, 2, 3, 4, 5], lambda i: (q0.n * q0.q[i] + 30 * ((q1.n * q1.q[i] + 30 * q2.q[i]) // (q1.n + 30))) // (q0.n + 30)) as q
  from q0 join q1 on q0.lang is not distinct from q1.lang and q0.metric = q1.metric join q2 on q0.metric = q2.metric),
lim as (
  select lang, source, metric, q[3] - greatest([100, 400, 250, 50][metric], [12, 12, 32, 12][metric] * (q[3] - q[[2, 1, 1, 2][metric]])) as low,
         q[3] + greatest([100, 400, 250, 50][metric], [12, 12, 32, 12][metric] * (q[[4, 5, 5, 4][metric]] - q[3])) as high
  from q),
p as (
  select lang, source, max(case metric when 1 then high end) as h1, max(case metric when 2 then high end) as h2,
         max(case metric when 3 then high end) as h3, max(case metric when 4 then high end) as h4, max(case metric when 4 then low end) as l4
  from lim group by all),
j as (
  select v.*, coalesce(v1 <= h1 and v2 <= h2 and v3 <= h3 and v4 <= h4 and v4 >= l4, false) as within
  from v left join p on v.lang is not distinct from p.lang and v.source is not distinct from p.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and within as kept from j
""",
    "op10_line_dedup": r"""
with d as (select row_number() over () as rid, doc_id, text, string_split(text, chr(10)) as l from documents),
e as (
  select rid, doc_id, len(l) as n, unnest(range(1, len(l) + 1)) as i, l,
         list_transform(l, lambda x: len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) as c
  from d where text is not null),
w as (
  select rid, doc_id, n, i as pos, (select min(k) from range(1, 9) t(k) where k = 8 or list_sum(c[i:i + k - 1]) >= 50) as len, l from e
  union
  select rid, doc_id, n, i - k + 1 as pos, k as len, l
  from (select *, (select min(k) from range(1, 9) t(k) where k = 8 or (i - k >= 0 and list_sum(c[i - k + 1:i]) >= 50)) as k from e)),
s as (select rid, doc_id, pos, len, array_to_string(l[pos:pos + len - 1], chr(10)) as body from w where pos >= 1 and pos + len - 1 <= n),
f as (select *, row_number() over (partition by len, body order by doc_id nulls first, rid, pos) as nth from s),
gone as (select distinct rid, unnest(range(pos, pos + len)) as i from f where nth > 1),
g as (select rid, list(i) as gone from gone group by rid)
select doc_id, coalesce(len(l), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed,
       sha256(case when gone is null then text else array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: not list_contains(gone, i)), lambda i: l[i]), chr(10)) end) as text_sha256
from d left join g using (rid)
""",
    "op8_near_duplicates": r"""
with recursive d as (
  select row_number() over () as rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
s as (
  select rid, doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                           when len(w) > 0 then [array_to_string(w, ' ')] else [] end as sh
  from d),
x as (select rid, unnest(sh) as g from s),
p as (select a.rid as u, b.rid as v, count(*) as n from x a join x b on a.g = b.g and a.rid < b.rid group by a.rid, b.rid),
l as (
  select u, v from p join s a on a.rid = u join s b on b.rid = v
  where 100 * n >= 75 * (len(a.sh) + len(b.sh) - n)),
e as (select u, v from l union select v, u from l),
reach as (select rid as a, rid as b from d union select reach.a, e.v from reach join e on reach.b = e.u),
c as (select a as rid, min(doc_id) as component_id from reach join d on d.rid = reach.b group by a)
select doc_id, len(sh)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join c using (rid)
""",
    "op11_periodic_runs": rf"""
with d as (
  select row_number() over () as rid, doc_id, {_CRC32.format("doc_id")} as h,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w0
  from documents),
s as (select rid, doc_id, w0, len(w0)::bigint as n, h, (h // 10) % greatest(len(w0), 1) as a, h // 10 as g from d),
r as (
  select rid, doc_id, n, case when h % 10 = 0 and n > 0
    then list_transform(range(0, n), lambda i: w0[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end + 1]) else w0 end as w
  from s),
x as (select rid, n, i, w[i + 1] as word from (select rid, n, w, unnest(range(0, n)) as i from r)),
m as (select p.rid, p.i, q.i - p.i as q from x p join x q on p.rid = q.rid and p.word = q.word and q.i > p.i and 4 * (q.i - p.i) <= p.n),
isl as (select rid, q, i, i - row_number() over (partition by rid, q order by i) as g from m),
st as (select rid, q, min(i) as start, count(*) + q as length from isl group by rid, q, g having count(*) >= 3 * q and count(*) + q >= 6),
runs as (select rid, start, length, min(q) as period from st group by rid, start, length),
best as (
  select rid, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
         min(struct_pack(k := -(length::decimal(38, 15) / period), start := start, period := period, length := length)) as b
  from runs group by rid),
gone as (select distinct rid, unnest(range(start + period, start + length)) as i from runs),
kept as (select rid, string_agg(word, ' ' order by i) as words from x where not exists (from gone where gone.rid = x.rid and gone.i = x.i) group by rid)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, b.start as start, b.length as length, b.period as period,
       (1000 * b.length // b.period)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from r left join best using (rid) left join kept using (rid)
""",
    "op12_passage_dedup": r"""
with d as (
  select row_number() over () as rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
s as (select rid, doc_id, i, array_to_string(w[i:i + 12], ' ') as body from (select rid, doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
f as (select rid, i from (select *, min(doc_id) over (partition by body) as least from s) where doc_id > least),
gone as (select rid, list(distinct p) as gone from (select rid, unnest(range(i, i + 13)) as p from f) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
       sha256(case when gone is null then array_to_string(w, ' ')
              else array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)), lambda i: w[i]), ' ') end) as kept_sha256
from d left join gone using (rid)
""",
    "op13_conversation_trie": rf"""
with c as (
  select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first) as s
  from conversations where conv_id is not null group by conv_id),
k as (select conv_id, s, conv_id - conv_id % 20 as base, {_CRC32.format("conv_id")} % 4 as h from c),
b as (select k.conv_id, list_concat(coalesce(o.s[1:k.h], []), k.s[k.h + 1:]) as s from k left join c o on o.conv_id = k.base),
p as (
  select conv_id, len(s) as n, d, array_to_string(list_transform(s[1:d], lambda x: md5(x.r || chr(0) || x.t)), '') as path,
         case when d > 0 then len(list_filter(regexp_split_to_array(s[d].t, '[\x20\x09-\x0D]+'), lambda w: w <> '')) else 0 end as words
  from (select conv_id, s, unnest(range(0, len(s) + 1)) as d from b)),
nodes as (
  select path, d, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(words) as saved,
         coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '') as ends
  from p group by path, d),
kids as (select left(path, 32 * (d - 1)::integer) as path, count(*) as n_children from nodes where d > 0 group by all),
n2 as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (path)),
up as (select left(path, 32 * a::integer) as path, saved, n_children from (select path, saved, n_children, unnest(range(0, d + 1)) as a from n2)),
tot as (select path, sum(saved)::bigint as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from up group by path)
select n2.conv_id, n2.d::bigint as depth, o.conv_id as parent_conv_id, n2.n_convs, n2.n_children, n_leaves, saved_tokens, sha256(n2.ends) as ends_sha256
from n2 join tot on tot.path = n2.path left join nodes o on n2.d > 0 and o.path = left(n2.path, 32 * (n2.d - 1)::integer)
""",
}
