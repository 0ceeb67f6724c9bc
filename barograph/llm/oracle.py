"""DuckDB SQL with the results of those queries that SQL can express."""

from __future__ import annotations

from barograph.llm import mixing, rules, urls

_WORD, _GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def _moment(share: str, knots) -> str:
    """As mixing.moment(), for a schedule of one straight line."""
    (t0, w0), (t1, w1) = knots
    due = f"({share} * {mixing.area(knots)}::double)"
    root = f"sqrt(greatest(0.0, {w0 * w0}::double + {2 * (w1 - w0) / (t1 - t0)}::double * {due}))"
    return f"least(1.0, greatest(0.0, {t0}::double + 2.0::double * {due} / ({w0}::double + {root})))"


_OP1 = f"""
with d as (select doc_id, source, md5(coalesce(doc_id::varchar, '')) as o,
    coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 as turn from s),
v as (select *, (case turn when 0 then 3.0 when 1 then 1.0 else 2.0 end)::double as weight, source_size * 2 as most from w),
l as (select *, (1.5::double * (sum(source_size) over ())::double
    - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
    / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as level from v),
t as (select source, source_size, turn, least(most::double, max(level) over () * weight) as target from l),
r as (select d.doc_id, size, source_size, target, turn, floor(target)::bigint as goal,
    case when source_size > 0 then floor(target)::bigint // source_size else 0 end as passes,
    (sum(size) over (partition by d.source order by o, doc_id nulls first, size rows unbounded preceding) - size)::bigint as ahead
    from d join t on d.source is not distinct from t.source),
x as (select *, (size * passes + greatest(0, least(size, goal - passes * source_size - ahead)))::bigint as taken from r)
select doc_id, size, source_size, target, taken,
    case when taken > 0 then case turn when 0 then {_moment("(ahead::double / goal)", mixing.CURRICULUM[0])}
    when 1 then {_moment("(ahead::double / goal)", mixing.CURRICULUM[1])}
    else {_moment("(ahead::double / goal)", mixing.CURRICULUM[2])} end end as position
from x"""

_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
_OP2 = f"""
with u as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as n from pages),
r(h, p, v) as (values {_VALUES}),
m as (select u.*, h || p as rule, v, row_number() over (partition by n order by length(h || p) desc nulls last, length(h) desc, h || p desc) as k
    from u left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where k = 1"""

_LINE_FAILS = rf"""(case
    when contains(l, '!!') and len(regexp_extract_all(l, '!![\x20\x09-\x0D]')) + (case when ends_with(l, '!!') then 1 else 0 end) > {rules.SHOUT_SHARE} * len(regexp_extract_all(l, '{_WORD}')) then true
    when len(regexp_extract_all(l, '{rules.SYMBOLS}')) > {rules.SYMBOL_SHARE} * length(l) then true
    when len(regexp_extract_all(replace(l, ' ', '  '), ' [|>] ')) >= {rules.BARS} and 100 * len(regexp_extract_all(replace(l, ' ', '  '), ' [|>] ')) >= {rules.BARS_PERCENT} * len(regexp_extract_all(l, '{_WORD}')) then true
    when length(l) <= {rules.BOILERPLATE_CHARS} and regexp_matches(l, '{rules.BOILERPLATE}') then true
    when not regexp_matches(l, '{rules.SENTENCE}') and len(regexp_extract_all(l, '{_WORD}')) > {rules.BARE_WORDS} then true
    else false end)"""
_OP6 = rf"""
with d as (select row_number() over () as n, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{_WORD}') as ws, string_split(t, chr(10)) as ls from d),
p as (select n, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select n, ws, unnest(range(1, len(ws) - 1)) as i from w)),
q as (select n, i from (select n, i, count(*) over (partition by n, g) as c from p) where c > 1),
rep as (select n, count(distinct i + k)::bigint as r from q, (values (0), (1), (2)) as v(k) group by n),
lost as (select n, sum(case when fails then length(l) else 0 end)::bigint as lost_chars, count(*) filter (where fails)::bigint as n_failed, count(*) as n_lines
    from (select n, l, {_LINE_FAILS} as fails from (select n, unnest(ls) as l from w)) group by n),
x as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    len(regexp_extract_all(t, '{rules.SYMBOLS}'))::bigint as n_symbols,
    (len(list_filter(ls, lambda l: regexp_matches(l, '{_WORD}'))) - len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, '{_WORD}')))))::bigint as n_dup_lines,
    coalesce(r, 0)::bigint as n_repeat_words, n_failed as n_failed_lines, lost_chars, length(t) - n_lines + 1 as chars
    from w left join rep using (n) join lost using (n))
select * exclude (chars), n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_chars <= {rules.LOST_SHARE} * chars as kept from x"""

_OP8 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v)::bigint as score
    from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score from s)
select * from r where rank <= 5"""

_OP9 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f"""

_OP11 = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
a as (select lang, w[i] as w1, w[i + 1] as w2, w[i + 2] as w3 from (select lang, w, unnest(range(1, len(w) + 1)) as i from w)),
n as (select lang, count(*) as n from a group by lang),
f1 as (select lang, w1, count(*) as f from a group by all),
f2 as (select lang, w1, w2, count(*) as f from a where w2 is not null group by all having count(*) >= 10),
f3 as (select lang, w1, w2, w3, count(*) as f from a where w3 is not null group by all having count(*) >= 10),
c2 as (select f2.lang, f2.w1 || ' ' || f2.w2 as phrase, f2.f as a, x.f as l, y.f as r from f2
    join f1 x on x.lang = f2.lang and x.w1 = f2.w1 join f1 y on y.lang = f2.lang and y.w1 = f2.w2
    where not exists (select 1 from f3 where f3.lang = f2.lang and 100 * f3.f >= 50 * f2.f
        and ((f3.w1 = f2.w1 and f3.w2 = f2.w2) or (f3.w2 = f2.w1 and f3.w3 = f2.w2)))),
c3 as (select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 as phrase, f3.f as a, x.f as l1, y.f as r1, u.f as l2, v.f as r2 from f3
    join f1 x on x.lang = f3.lang and x.w1 = f3.w1 join f2 y on y.lang = f3.lang and y.w1 = f3.w2 and y.w2 = f3.w3
    join f2 u on u.lang = f3.lang and u.w1 = f3.w1 and u.w2 = f3.w2 join f1 v on v.lang = f3.lang and v.w1 = f3.w3),
s3 as (select *, (1000000::hugeint * a * a) // (l1::hugeint * r1) as s1, (1000000::hugeint * a * a) // (l2::hugeint * r2) as s2 from c3),
s as (select lang, phrase, a, l, r, (1000000::hugeint * a * a) // (l::hugeint * r) as score from c2 union all
    select lang, phrase, a, case when s2 < s1 then l2 else l1 end, case when s2 < s1 then r2 else r1 end, least(s1, s2) from s3),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from s)
select o.lang, rank::integer as rank, phrase, a, l, r, n, score::bigint as score from o join n using (lang) where rank <= 2000"""

ORACLE = {"op1_mixing": _OP1, "op2_url_filters": _OP2, "op6_quality_rules": _OP6, "op8_top_k": _OP8, "op9_warc": _OP9, "op11_collocations": _OP11}
