"""SQL (DuckDB) that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

from . import quality

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _q(s: str) -> str:
    return s.replace("'", "''")


SUBSTRING = f"""
with d as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
p as (select doc_id, len(w) as n, unnest(range(1, len(w) + 1)) as i, w from d),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as s from p where i + 49 <= n),
rep as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as m from win) where m < doc_id),
gone as (select distinct doc_id, i + k as i from rep, range(50) r(k)),
stay as (select p.doc_id, p.i, p.w[p.i] as x from p anti join gone on p.doc_id = gone.doc_id and p.i = gone.i),
kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by i) as t from stay group by 1)
select d.doc_id, len(d.w)::bigint as n_words, len(d.w)::bigint - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256 from d left join kept k using (doc_id)
"""

JACCARD = f"""
with recursive d as (select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from d union select r.a, l.b from reach r join link l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(b) from reach r where r.a = d.doc_id) as component_id, coalesce(k.n_links, 0) as n_links
from d left join n using (doc_id) left join (select a as doc_id, count(*) as n_links from link group by 1) k using (doc_id)
"""

MIXING = f"""
with d as (select doc_id, source, coalesce(len({WORDS.format('text')}), 0)::bigint as size from documents),
h as (select *, md5('mix:' || coalesce(doc_id::varchar, '-') || ':' || size) as h from d),
s as (select source, sum(size)::bigint as source_size from d group by 1),
w as (select *, [1, 2, 3][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::bigint as weight, row_number() over (order by source is null, source) as i from s),
c as (select *, source_size * 3 as cap, sum(source_size) over ()::bigint * 1.0::double as budget, sum(weight) over ()::bigint as total from w),
l as (select *, (budget - coalesce(sum(cap) over (order by cap / weight, i rows between unbounded preceding and 1 preceding), 0)::bigint)
    / (total - coalesce(sum(weight) over (order by cap / weight, i rows between unbounded preceding and 1 preceding), 0)::bigint) as level from c),
f as (select (select level from l where cap / weight >= level order by cap / weight, i limit 1) as lv),
t as (select source, source_size, case when lv is null then cap::double else least(cap::double, weight * lv) end as target from l, f),
q as (select h.*, t.source_size, t.target, sum(size) over (partition by h.source order by h, doc_id rows unbounded preceding)::bigint as fin from h join t on h.source is not distinct from t.source),
v as (select doc_id, source, size, h, e, (e * source_size + fin) / target as finish from q, range(3) r(e) where size > 0 and target > 0 and e * source_size + fin - size < target),
taken as (select doc_id, source, h, count(*) as copies from (select *, sum(size) over (order by finish, source nulls first, h, doc_id, e rows unbounded preceding) as total from v)
    where total <= (select sum(target) from t) + 1e-6 group by 1, 2, 3)
select q.doc_id, q.size, q.source_size, q.target, (coalesce(k.copies, 0) * q.size)::bigint as taken from q left join taken k on k.doc_id = q.doc_id and k.h = q.h and k.source is not distinct from q.source
"""

EXACT = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from n join g using (t)
"""


def _count(pattern: str, c: str) -> str:
    return f"len(regexp_extract_all({c}, '{_q(pattern)}'))"


_N = f"len({WORDS.format('x')})"
_FAILS = (
    f"not regexp_matches(x, '{_q(quality.ENDINGS)}') or {_count(quality.SEPARATORS, 'x')} * 4 >= {_N} or {_count(quality.SYMBOLS, 'x')} * 2 >= {_N}"
    f" or {_count(quality.LOUD, 'x')} * 2 >= {_N} or regexp_matches(x, '{_q(quality.BOILERPLATE)}')"
)
QUALITY = f"""
with d as (select doc_id, coalesce(text, '') as t, {WORDS.format("coalesce(text, '')")} as w from documents),
g as (select doc_id, i, count(*) over (partition by doc_id, s) as c from (select doc_id, i, array_to_string(w[i:i + 2], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d))),
r as (select doc_id, count(distinct i + k) as n from g, range(3) q(k) where c > 1 group by 1),
l as (select doc_id, x, row_number() over (partition by doc_id, x order by i) as k from (select doc_id, unnest(string_split(t, chr(10))) as x, generate_subscripts(string_split(t, chr(10)), 1) as i from d)
    where regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
b as (select doc_id, count(*) filter (where k > 1) as dup, sum(length(x) + 1) filter (where k = 1 and not ({_FAILS})) as chars from l group by 1),
m as (select d.doc_id, t, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars, {_count(quality.SYMBOLS, 't')}::bigint as n_symbols,
    coalesce(b.dup, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, greatest(coalesce(b.chars, 0) - 1, 0) as clean from d left join r using (doc_id) left join b using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) and not ((length(t) - clean) * 100 > length(t) * {quality.MAX_LOST}) as kept from m
"""

_SHARE = "1 + (1000000000::hugeint * ({0} + 5)) // ({1} + 5 * v)"
AUDIT = f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select distinct lang, source from d),
w as (select lang, source, term, count(*) as df, sum(k) as c from (select r, lang, source, term, count(*) as k from (select r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d) group by all) group by all),
k as (select lang, term, sum(c)::hugeint as total from w group by all having sum(df) >= 30),
l as (select lang, count(*) as v, sum(total)::hugeint as every from k group by 1),
n as (select g.lang, g.source, coalesce(sum(w.c) filter (where k.term is not null), 0)::hugeint as n from g left join w using (lang, source) left join k on k.lang = w.lang and k.term = w.term group by all),
p as (select n.lang, n.source, k.term, coalesce(w.c, 0) as c, {_SHARE.format('coalesce(w.c, 0)', 'n.n')} as p, {_SHARE.format('k.total', 'l.every')} as q
    from n join k on k.lang = n.lang join l on l.lang = n.lang left join w on w.lang = n.lang and w.source = n.source and w.term = k.term),
s as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
term as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p where c > 0 and p > q),
both_ as (select * from pair union all select * from term)
select * from (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from both_) where part = 'pair' or rank <= 50
"""
