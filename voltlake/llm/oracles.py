"""SQL for DuckDB that gives the rows of the queries whose operators it can express."""

from __future__ import annotations

from .queries import FIXED_ENTRIES

_DIGIT = "cast('0x' || substr(md5(pattern), {i}, 2) as integer)"
_d = {i: _DIGIT.format(i=i) for i in (1, 3, 5, 7)}
_fixed = ", ".join(f"('{p}', '{a}', date '{d}')" for p, a, d in FIXED_ENTRIES)

OP3 = rf"""
with caps as (
  select page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') as host,
         date '2024-01-01' + cast(page_id % 366 as integer) as fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1)) as segment from pages),
hosts as (select distinct regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as pattern from pages where regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) <> ''),
entries as (
  select pattern, 'block' as action, date '2024-01-01' + {_d[1]} as listed from hosts where {_d[5]} % 2 = 0
  union all select pattern, 'remove', date '2024-01-01' + {_d[1]} + 30 from hosts where {_d[5]} % 2 = 0
  union all select pattern, 'block', date '2024-01-01' + {_d[1]} + 30 + {_d[3]} from hosts where {_d[5]} % 2 = 0
  union all select pattern || '/en', 'allow', date '2024-01-01' + {_d[1]} + 10 from hosts where {_d[7]} % 4 = 0
  union all select * from (values {_fixed})),
one as (select lower(pattern) as pattern, listed, max_by(action, list_position(['remove', 'allow', 'block'], action)) as action from entries group by 1, 2),
keys as (
  select page_id, fetched, array_to_string(l[i:], '.') as key from (select *, string_split(host, '.') as l from caps where host is not null), unnest(generate_series(1, len(l))) u(i)
  union all select page_id, fetched, host || '/' || segment from caps where host is not null and segment <> ''),
-- As of the fetch: the last entry of the pattern that is not later.
asof_entry as (select k.page_id, k.key, arg_max(struct_pack(action := action, listed := listed), listed) as e from keys k join one on one.pattern = k.key and one.listed <= k.fetched group by all),
best as (select page_id, arg_max(struct_pack(action := e.action, listed := e.listed, pattern := key), length(key)) as b from asof_entry where e.action <> 'remove' group by page_id)
select caps.page_id, url, host, strftime(fetched, '%Y-%m-%d') as fetched, coalesce(b.action, 'none') as verdict, b.pattern as pattern, strftime(b.listed, '%Y-%m-%d') as listed
from caps left join best using (page_id)
"""

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
with base as (
  select doc_id, source, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w, coalesce(text, '') as t, [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '{_WORD}')] as l from documents),
trip as (select doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as k from base, unnest(generate_series(1, len(w) - 2)) u(i)),
again as (select doc_id, i from trip qualify count(*) over (partition by doc_id, k) > 1),
covered as (select doc_id, count(distinct i + o) as n_repeat_words from again, (values (0), (1), (2)) v(o) group by doc_id),
counts as (
  select doc_id, source, cast(len(w) as bigint) as n_words, cast(length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from base left join covered using (doc_id)),
rules as (select *, n_words < 50 as f1, 100 * n_repeat_words > 50 * n_words as f2, 100 * n_symbols > 50 * n_words as f3 from counts),
hosts as (select source, count(*) as n, sum(f1::int) as a, sum(f2::int) as b, sum(f3::int) as c from rules group by source),
sums as (select count(*) as k, sum(n) as nn, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) as fr, avg(a / n) as ma, avg(b / n) as mb, avg(c / n) as mc,
         sum(a) / sum(n) as pa, sum(b) / sum(n) as pb, sum(c) / sum(n) as pc, sum(a * a / n) as qa, sum(b * b / n) as qb, sum(c * c / n) as qc from hosts),
spread as (select *, qa - nn * pa * pa as sa, qb - nn * pb * pb as sb, qc - nn * pc * pc as sc, k > 1 and pa > 0 and pa < 1 as fa, k > 1 and pb > 0 and pb < 1 as fb, k > 1 and pc > 0 and pc < 1 as fc from sums),
weight as (select *, case when fa and sa > 1e-9 * nn and (sa - pa * (1 - pa) * (k - 1)) > 0 and fr > 0 then least(greatest(pa * (1 - pa) * fr / (sa - pa * (1 - pa) * (k - 1)) - 1, 2), 100) else 100 end as wa, case when fb and sb > 1e-9 * nn and (sb - pb * (1 - pb) * (k - 1)) > 0 and fr > 0 then least(greatest(pb * (1 - pb) * fr / (sb - pb * (1 - pb) * (k - 1)) - 1, 2), 100) else 100 end as wb, case when fc and sc > 1e-9 * nn and (sc - pc * (1 - pc) * (k - 1)) > 0 and fr > 0 then least(greatest(pc * (1 - pc) * fr / (sc - pc * (1 - pc) * (k - 1)) - 1, 2), 100) else 100 end as wc from spread),
most as (select *, case when fa and sa > 1e-9 * nn then least(0.5, ma + 3 * sqrt(ma * (1 - ma) / (wa + 1))) else 0.5 end as la, case when fb and sb > 1e-9 * nn then least(0.5, mb + 3 * sqrt(mb * (1 - mb) / (wb + 1))) else 0.5 end as lb, case when fc and sc > 1e-9 * nn then least(0.5, mc + 3 * sqrt(mc * (1 - mc) / (wc + 1))) else 0.5 end as lc from weight),
verdict as (select source, (a + ma * wa) / (n + wa) > la or (b + mb * wb) / (n + wb) > lb or (c + mc * wc) / (n + wc) > lc as rejected from hosts, most)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 or f2 as base_failed, not (f1 or f2) and not rejected as kept
from rules join verdict on rules.source is not distinct from verdict.source
"""

OP6 = r"""
with low as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
pats as (select distinct item, m, array_to_string(w[i:i + m - 1], ' ') as p from (select item, w, least(len(w), 10) as m from items where len(w) > 0), unnest(generate_series(1, len(w) - m + 1)) u(i)),
wins as (select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') as p from low, (select distinct m from pats) k, unnest(generate_series(1, len(w) - m + 1)) u(i)),
found as (select doc_id, i, m, item from wins join pats using (m, p)),
hit as (select doc_id, count(distinct i + o) as n_hit from (select distinct doc_id, i, m from found) f, unnest(generate_series(0, m - 1)) u(o) group by doc_id),
its as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list_distinct(list(item))), ',') as joined from found group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(joined, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from low left join hit using (doc_id) left join its using (doc_id)
"""

OP7 = rf"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], chr(10)) as s from words, unnest(generate_series(1, greatest(len(w) - 4, 1))) u(i) where len(w) > 0),
size as (select doc_id, count(*) as n from sh group by doc_id),
df as (select s, count(*) as df from sh group by s),
ranked as (select doc_id, s, row_number() over (partition by doc_id order by df, s) as r from sh join df using (s)),
prefix as (select doc_id, s, n from ranked join size using (doc_id) where r <= n - cast(ceil(75 * n / 100.0) as bigint) + 1),
cand as (select distinct a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb from prefix a join prefix b on a.s = b.s and a.doc_id < b.doc_id and 100 * a.n >= 75 * b.n and 100 * b.n >= 75 * a.n),
common as (select a, b, any_value(na) as na, any_value(nb) as nb, count(*) as o from cand join sh x on x.doc_id = a join sh y on y.doc_id = b and x.s = y.s group by a, b),
links as (select a, b from common where 100 * o >= 75 * (na + nb - o)),
edges as (select a as u, b as v from links union all select b, a from links),
reach(u, v) as (select u, v from edges union select r.u, e.v from reach r join edges e on r.v = e.u),
low as (select u, min(v) as m from reach group by u)
select words.doc_id, coalesce(n, 0) as n_shingles, least(words.doc_id, coalesce(m, words.doc_id)) as component_id from words left join size using (doc_id) left join low on low.u = words.doc_id
"""

OP9 = rf"""
with ls as (select doc_id, l, i from (select doc_id, string_split(text, chr(10)) as a from documents where text is not null), unnest(a) with ordinality u(l, i)),
sets as (select doc_id, i, list_sort(list_distinct(regexp_extract_all(l, '{_WORD}'))) as w from ls),
big as (select doc_id, i, w, len(w) as n, row_number() over (order by doc_id, i) as id from sets where len(w) >= 1),
-- Equal sets: the first one stands for all.
firsts as (select w, min(id) as id, any_value(n) as n from big group by w),
tok as (select id, n, unnest(w) as t from firsts),
df as (select t, count(*) as df from tok group by t),
prefix as (select id, n, t from (select id, n, t, row_number() over (partition by id order by df, t) as r from tok join df using (t)) where r <= n - cast(ceil(75 * n / 100.0) as bigint) + 1),
cand as (select distinct a.id as a, b.id as b from prefix a join prefix b on a.t = b.t and a.id < b.id and 100 * a.n >= 75 * b.n and 100 * b.n >= 75 * a.n),
later as (select distinct b from cand join firsts x on x.id = a join firsts y on y.id = b where 100 * len(list_intersect(x.w, y.w)) >= 75 * (x.n + y.n - len(list_intersect(x.w, y.w)))),
gone as (select doc_id, i from big join firsts using (w) where big.id <> firsts.id or firsts.id in (select b from later)),
kept as (select doc_id, string_agg(l, chr(10) order by i) as t, count(*) as n from ls anti join gone using (doc_id, i) group by doc_id),
n as (select doc_id, count(*) as n from ls group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_lines, coalesce(n.n, 0) - coalesce(kept.n, 0) as n_removed, case when d.text is not null then length(coalesce(t, '')) end as n_chars,
       case when d.text is not null then sha256(coalesce(t, '')) end as text_sha256
from documents d left join n using (doc_id) left join kept using (doc_id)
"""

OP12 = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as units, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
        cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
c as (select *, cast(len(units) as bigint) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b from u),
p as (select *, case when t = '' or regexp_matches(t, '<P>|<S>|<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
        array_to_string(units[1:a], '') as pre, array_to_string(units[a + 1:b], '') as mid, array_to_string(units[b + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p"""

ORACLES = {"op3_url_filter": OP3, "op5_host_rules": OP5, "op6_decontaminate": OP6, "op7_near_duplicates": OP7, "op9_line_dedup": OP9, "op12_fill_in_middle": OP12}
