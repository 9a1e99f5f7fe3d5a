"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwork.llm.chat import format_turns, read_back, with_probe
from chartwork.llm.common import new_folder
from chartwork.llm.decontamination import find_leaks
from chartwork.llm.extraction import extract_text
from chartwork.llm.fingerprints import fingerprint_documents
from chartwork.llm.jaccard import jaccard_components
from chartwork.llm.langid import predict_languages
from chartwork.llm.linededup import dedup_lines
from chartwork.llm.mixing import mix_sources
from chartwork.llm.periodic import periodic_runs, periodic_tail
from chartwork.llm.sharding import shard_documents
from chartwork.llm.substrings import repeated_passages
from chartwork.llm.variants import group_variants
from chartwork.llm.warc import captures_of_pages, resolve_revisits


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an own store of maps for each call: another table's map is no start for this one
    return shard_documents(_table(spark, sf_dir, "documents"), n_shards=40, maps_path=new_folder(spark, "maps"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures_of_pages(_table(spark, sf_dir, "pages")))
    fields = [F.col("headers")[k].alias(k.replace("-", "_")) for k in ("etag", "last-modified", "date", "cache-control", "content-length")]
    return found.select("revisit_id", "canonical", "target_id", "outcome", *fields)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(format_turns(with_probe(_table(spark, sf_dir, "conversations"))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(_table(spark, sf_dir, "documents"), misspelt=199)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_table(spark, sf_dir, "documents"), rewrite=periodic_tail)


#: CRC-32 in SQL: the bytes of a string, and the table of the reflected polynomial.
_CRC_TABLE = """crc_table as (
  select list(c order by b) as t from (
    select b, list_reduce(list_prepend(b, range(1, 9)), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c
    from (select unnest(range(0, 256)) as b)))"""


def _crc(of: str) -> str:
    """SQL of the unsigned CRC-32 of a string column; the table crc_table must be joined."""
    code = f"list_transform(range(0, strlen({of})), lambda i: ('0x' || substr(hex(encode({of})), 2 * i + 1, 2))::bigint)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {code}), lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])))"


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sharding": op2_sharding,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_mixing": op8_mixing,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_fingerprints": op10_fingerprints,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op1_line_dedup": """
with lines as (
  select doc_id, u.line, u.nr,
    translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents) d,
    lateral (select unnest(d.parts) as line, generate_subscripts(d.parts, 1) as nr) u),
often as (
  select key, max(doc_id) as holder from lines where length(key) >= 40
  group by key having count(distinct doc_id) >= 5),
marked as (
  select l.*, o.key is not null and l.doc_id <> o.holder as cut
  from lines l left join often o on l.key = o.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (cut)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by nr) filter (not cut), '')) as kept_sha256
from marked group by doc_id
""",
    "op3_warc_revisits": r"""
with parts as (
  select page_id, coalesce(html, '') as html, html is null as bare,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as u from pages),
pieces as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') as host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
      lambda p: p <> '' and lower(split_part(p, '=', 1)) not in ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref',
        'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))) as params
  from parts),
p as (
  select page_id, bare, html, host || path || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as canonical,
    '"' || substr(md5(html), 1, 16) || '"' as tag, 'day ' || substr(md5(html), 17, 4) as day from pieces),
one as (
  select 2 * page_id as id, 2 * page_id as t, canonical, case when page_id % 5 <> 0 then tag end as etag, day,
    case when not bare then strlen(html)::varchar end as length from p),
two as (
  select 2 * page_id + 1 as id, 2 * page_id + 5 as t, canonical, day,
    case when page_id % 5 = 0 then null when page_id % 7 = 0 then '"stale"' when page_id % 3 = 0 then 'W/' || tag else tag end as etag
  from p),
best as (
  select b.id, b.canonical, b.t, b.etag, b.day, max(struct_pack(t := a.t, id := a.id)) as m
  from two b left join one a on a.canonical = b.canonical and (a.t < b.t or a.t = b.t and a.id < b.id)
  group by all),
found as (
  select b.*, a.id as target_id, a.etag as own_etag, a.day as own_day, a.length, a.t as own_t
  from best b left join one a on a.id = b.m.id),
judged as (
  select *, case when target_id is null then 'orphan'
    when etag is not null and own_etag is not null
      then case when regexp_replace(etag, '^W/', '') = own_etag then 'resolved' else 'mismatch' end
    when day = own_day then 'resolved' else 'mismatch' end as outcome from found)
select id as revisit_id, canonical, target_id, outcome,
  case when outcome = 'mismatch' then own_etag when outcome <> 'orphan' then coalesce(etag, own_etag) end as etag,
  case when outcome = 'mismatch' then own_day when outcome <> 'orphan' then day end as last_modified,
  case when outcome = 'mismatch' then 'second ' || own_t when outcome <> 'orphan' then 'second ' || t end as date,
  case when outcome = 'mismatch' then 'max-age=60' when outcome <> 'orphan' then 'max-age=600' end as cache_control,
  length as content_length
from judged
""",
    "op9_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
sets as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as s
  from w),
grams as (select doc_id, unnest(s) as g from sets),
counted as (
  select a.doc_id as a, b.doc_id as b, count(*) as o
  from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from counted join sets x on x.doc_id = a join sets y on y.doc_id = b
  where 100 * o >= 80 * (len(x.s) + len(y.s) - o)),
reach(doc_id, c) as (
  select doc_id, doc_id from documents
  union
  select l.b, r.c from reach r join links l on l.a = r.doc_id where r.c < l.b)
select s.doc_id, len(s.s)::bigint as n_shingles, m.c as component_id
from sets s join (select doc_id, min(c) as c from reach group by doc_id) m on m.doc_id = s.doc_id
""",
    "op11_chat_formatting": r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(15 + length(role) + len(regexp_extract_all(role, '[\\<>]'))
    + length(text) + len(regexp_extract_all(text, '\\|<turn |</turn>|<image/>|<audio/>|<document/>')))::bigint as formatted_chars,
  0::bigint as n_attachments, 0::bigint as n_tokens
from said group by conv_id
""",
    "op12_spelling_variants": f"""
with recursive {_CRC_TABLE},
runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as r from documents),
per as (select doc_id, r, count(*) as n, doc_id || ':' || r as k from runs where length(r) >= 6 group by all),
hashed as (select r, n, {_crc('k')} as h from per, crc_table),
spelt as (
  select case when h % 199 = 0 then substr(r, 1, (h % length(r))::bigint) || substr(r, (h % length(r))::bigint + 2) else r end as word, n
  from hashed),
words as (select word, sum(n)::bigint as n from spelt where length(word) >= 6 group by word having sum(n) >= 5),
less as (
  select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as v from (
    select word, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as other from less a join less b on a.i = b.i and a.v = b.v and a.word <> b.word
  union select a.word, b.word from less a join words b on b.word = a.v
  union select b.word, a.word from less a join words b on b.word = a.v),
best as (
  select w.word, w.n, count(o.word) as n_near, first(o.word order by o.n desc, o.word) as form, max(o.n) as form_n
  from words w left join near x on x.word = w.word left join words o on o.word = x.other group by w.word, w.n),
formed as (
  select word, n, n_near, case when form_n >= 5 * n then form end as form, case when form_n >= 5 * n then form_n end as form_n from best),
up(word, root) as (
  select word, word from formed
  union all
  select u.word, f.form from up u join formed f on f.word = u.root where f.form is not null)
select f.word, f.form, e.root, f.n, f.n_near, f.form_n
from formed f join (select u.word, u.root from up u join formed l on l.word = u.root where l.form is null) e on e.word = f.word
""",
    "op13_periodic_runs": f"""
with {_CRC_TABLE},
listed as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws, doc_id::varchar as k from documents),
hashed as (select doc_id, ws, len(ws) as n, {_crc('k')} as h from listed, crc_table),
placed as (
  select *, h % 10 = 0 and n > 0 as hit, case when n > 0 then (h // 10) % n else 0 end as a, 3 + (h // 10) % 8 as d from hashed),
put as (
  select doc_id, n, case when hit then list_transform(range(0, n),
    lambda i: ws[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // d) end]) else ws end as ws from placed),
words as (select doc_id, n, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from put),
equal as (
  select x.doc_id, x.i, y.i - x.i as q from words x join words y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and 3 * (y.i - x.i) <= x.n),
stretches as (
  select doc_id, q, min(i) as s, count(*) + q as m
  from (select *, i - row_number() over (partition by doc_id, q order by i) as g from equal)
  group by doc_id, q, g having count(*) + q >= greatest(24, 3 * q)),
runs as (
  select * from stretches r where not exists (
    select 1 from stretches l where l.doc_id = r.doc_id and l.q < r.q and l.s <= r.s and l.s + l.m >= r.s + r.m)),
kept as (
  select doc_id, string_agg(w, ' ' order by i) as t from words x
  where not exists (select 1 from runs r where r.doc_id = x.doc_id and x.i >= r.s + r.q and x.i < r.s + r.m) group by doc_id),
tops as (
  select doc_id, s, m, q from (
    select *, row_number() over (partition by doc_id order by m::decimal(18, 0) * 1000000000000 // q desc, s, q) as nr from runs) where nr = 1),
sums as (
  select doc_id, count(*) as n_runs, sha256(string_agg(s || ',' || m || ',' || q || chr(10), '' order by s, q)) as sha from runs group by doc_id)
select p.doc_id, coalesce(z.n_runs, 0)::bigint as n_runs, t.s as start, t.m as length, t.q as period, 1000 * t.m // t.q as exponent_milli,
  coalesce(z.sha, sha256('')) as runs_sha256, sha256(coalesce(k.t, '')) as collapsed_sha256
from put p left join sums z on z.doc_id = p.doc_id left join tops t on t.doc_id = p.doc_id left join kept k on k.doc_id = p.doc_id
""",
}
