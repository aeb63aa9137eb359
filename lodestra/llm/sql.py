"""DuckDB SQL for those of the queries that SQL can express."""

LINES = r"""
with l as (
    select doc_id, i, ls[i] as line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents) d, unnest(range(1, len(ls) + 1)) u(i)),
f as (select k, max(doc_id) as m from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5)
select doc_id, count(*) as n_lines, count(*) filter (where m is not null and m <> doc_id) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (where m is null or m = doc_id), '')) as kept_sha256
from l left join f using (k) group by doc_id
"""

WORDS = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, i, ws[i] as word, case when i <= len(ws) - 12 then array_to_string(ws[i:i + 12], ' ') end as k from d, unnest(range(1, len(ws) + 1)) u(i)),
s as (select *, case when k is not null and min(doc_id) over (partition by k) < doc_id then 1 else 0 end as again from w),
g as (select *, max(again) over (partition by doc_id order by i rows between 12 preceding and current row) as gone from s)
select d.doc_id, cast(len(any_value(d.ws)) as bigint) as n_words, cast(coalesce(sum(gone), 0) as bigint) as n_removed,
    sha256(coalesce(string_agg(word, ' ' order by i) filter (where gone = 0), '')) as kept_sha256
from d left join g using (doc_id) group by d.doc_id
"""

_KEY = r"""
    select *, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/@?#]*@)?', ''), '#.*$', '') as bare from pages"""

REVISITS = rf"""
with b as ({_KEY}),
q as (select *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) as ps from b),
p as (select page_id as p, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
        || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') || case when len(ps) > 0 then '?' || array_to_string(ps, '&') else '' end as url_key,
    md5(coalesce(html, '')) as digest, strlen(coalesce(html, '')) as size from q),
t as (select *, case when p % 3 <> 0 then '"' || substr(digest, 1, 16) || '"' end as tag, case when p % 5 <> 0 then p * 10 - 1 end as modified from p),
r as (select p * 2 + 1 as record_id, url_key, p * 10 + 5005 as ts, case when tag is not null then case when p % 7 = 0 then '"0"' else tag end end as etag,
    case when tag is null then modified end as modified, case when p % 35 = 0 then digest end as digest from t),
s as (select p * 2 as record_id, url_key, p * 10 as ts, tag as etag, modified, digest, size from t),
m as (select r.*, s.record_id as source_id, s.ts as source_ts, s.etag as s_etag, s.digest as s_digest, s.size,
    case when s.record_id is null then 'no_source'
         else case case when r.etag is not null and s.etag is not null then r.etag = s.etag when r.modified is not null and s.modified is not null then r.modified = s.modified
                        when r.digest is not null then r.digest = s.digest end when true then 'resolved' when false then 'mismatch' else 'unvalidated' end end as state
    from r asof left join s on r.url_key = s.url_key and r.ts > s.ts)
select record_id, url_key, source_id, source_ts, state, case when state in ('resolved', 'unvalidated') then s_digest end as digest,
    case when state in ('resolved', 'unvalidated') then 'content-type: text/html; content-length: ' || size || coalesce('; etag: ' || s_etag, '') || '; date: ' || ts || '; cache-control: max-age=60'
         else 'date: ' || ts || '; cache-control: max-age=60; content-length: 0; server: s' end as headers
from m
"""

ORACLE_SQL = {"op3_substring_dedup": WORDS, "op4_revisits": REVISITS, "op5_line_dedup": LINES}
