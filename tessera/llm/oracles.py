"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from tessera.llm import licenses

RE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"regexp_extract_all({FOLD.format(f'coalesce({text}, chr(32))')}, '{RE_WORD}')"


OP4 = f"""
with docs as (select row_number() over () as r, doc_id, {_words('text')} as w from documents),
items as (select cast(item_id as varchar) as item, {_words('text')} as w from benchmark where item_id is not null and text is not null),
windows as (
  select item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
sizes as (select distinct n from windows),
places as (
  select r, i, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)),
hits as (select distinct r, i, n, item from places join windows using (n, win)),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by 1),
found as (select r, string_agg(item, ',' order by item) as ids, count(*) as n_items from (select distinct r, item from hits) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join words using (r) left join found using (r)
"""

OP6 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
"""

_TEMPLATES = licenses.BASE + licenses.NOTICES
_MUST = [sorted(licenses.must_places([licenses.Index.place(t.text.split(), m.split()) for m in t.must])) for t in _TEMPLATES]
_NOTICES = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, '{t.text}', {must})" for k, (t, must) in enumerate(zip(_TEMPLATES, _MUST)))
#: A template matches where as many of its mandatory words stand in place as it has.
OP8 = f"""
with t(k, label, base, body, must) as (values {_NOTICES}),
tw as (select k, word, j, list_contains(must, j) as need from (select k, must, unnest(string_split(body, ' ')) as word, unnest(range(0, len(string_split(body, ' ')))) as j from t)),
d as (select row_number() over () as r, doc_id, {_words('text')} as w from documents),
p as (select r, unnest(w) as word, unnest(range(0, len(w))) as i from d),
hits as (select r, k, i - j as start, count(*) filter (where need) as n_must, count(*) as same from p join tw using (word) group by 1, 2, 3),
found as (select r, label, base, start, same / len(string_split(body, ' ')) as share from hits join t using (k) where n_must = len(must)),
per as (select r, count(*) filter (where base) as n_base, min(start) filter (where base) as first_word, max(start) filter (where base) as last_word,
    string_agg(distinct label, ',' order by label) filter (where base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from found group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join per using (r)
"""

RULES = (("com/", "com", "/", "allow"), ("example.com/en/", "example.com", "/en/", "block"), ("www.example.com/en/", "www.example.com", "/en/", "allow"), ("net/es/", "net", "/es/", "block"), ("net/fr/", "net", "/fr/", "block"))
_VALUES = ", ".join(f"('{n}', '{h}', '{p}', '{v}')" for n, h, p, v in RULES)
_HOST = "translate(coalesce(regexp_extract({u}, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), '')"
_RULE = "(select {what} from rules where ({h} = rule_host or ends_with({h}, '.' || rule_host)) and starts_with({p}, rule_path) order by length(name) desc limit 1)"
_NODE = f"concat(lower(regexp_extract({{u}}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), '://', {_HOST}, case when starts_with(regexp_extract({{u}}, '://[^/?#]*([^#]*)', 1), '/') then '' else '/' end, regexp_extract({{u}}, '://[^/?#]*([^#]*)', 1))"
#: Relative links are told apart as the operator does; a class is what a walk over both directions of links reaches.
OP3 = f"""
with recursive rules(name, rule_host, rule_path, verdict) as (values {_VALUES}),
p as (select page_id, url, {_HOST.format(u='url')} as host, {_PATH.format(u='url')} as path from pages),
tags as (select url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)))) as link
  from pages where url is not null and html is not null),
edges as (select url as src, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link
    when starts_with(link, '//') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) || ':' || link
    when starts_with(link, '/') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || link end as dst from tags where link <> ''),
links as (select {_NODE.format(u='src')} as a, {_NODE.format(u='dst')} as b from edges where dst is not null),
both_ways as (select a, b from links where a <> b union select b, a from links where a <> b),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
bad as (select distinct a from reach where {_RULE.format(what='verdict', h=_HOST.format(u='b'), p=_PATH.format(u='b'))} = 'block')
select page_id, host, path, {_RULE.format(what='name', h='host', p='path')} as rule,
  coalesce({_RULE.format(what='verdict', h='host', p='path')}, case when {_NODE.format(u='url')} in (select a from bad) then 'block' else 'allow' end) as verdict
from p
"""

_KINDS = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, "length(value) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", 0, "length(value) >= 20"),
    ("hex", r"[0-9a-f]{24,}", 0, "true"),
    ("provider", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, "true"),
    ("entropy", r"[A-Za-z0-9+/_-]{32,}", 0, "regexp_matches(value, '[0-9]') and regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]')"),
)
_SPANS = " union all ".join(
    f"""select r, '{k}' as kind, {rank} as rank, a + list_sum(list_transform(gaps[1:i], lambda g: length(g))) as start, value, hit, owner
  from (select r, owner, gaps, i, hits[i] as hit, vals[i] as value, coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as a
    from (select r, owner, gaps, hits, vals, unnest(range(1, len(hits) + 1)) as i
      from (select r, owner, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}', 0) as hits, regexp_extract_all(t, '{p}', {g}) as vals from d))) where {cond}"""
    for rank, (k, p, g, cond) in enumerate(_KINDS)
)
OP9 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(source, '') as owner from documents),
spans as ({_SPANS}),
owned as (select value, count(distinct owner) as n_owners from spans group by 1),
kept as (select s.*, cast(start + length(hit) as bigint) as stop, n_owners, case when n_owners >= 3 then 'example'
    when regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and len(list_distinct(string_split(value, ''))) >= 8 then 'live' else 'plain' end as class
  from spans s join owned using (value) where kind in ('assign', 'access', 'hex') or n_owners < 3),
per as (select r, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
    string_agg(kind || ':' || cast(start as bigint) || ':' || stop, ',' order by start, rank) filter (where rank < 3) as base,
    string_agg(kind || ':' || cast(start as bigint) || ':' || stop, ',' order by start, rank) as spans,
    count(*) filter (where class = 'live') as n_live, count(*) filter (where class = 'example') as n_example from kept group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from d left join per using (r)
"""
