"""DuckDB SQL for the rows of the operators that SQL can express. The others are tested against brute force."""

from __future__ import annotations


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# op1: rules, then the same two models by plain joins.

_RULES = """rules(said, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))"""


def _models(order: int = 3, pull: float = 4.0) -> str:
    parts = [f"g3 as (select g, count(*) filter (side = 1) as a, count(*) filter (side = 0) as r from grams group by g)"]
    before = "cast(1.0/256 as double) as pa0, cast(1.0/256 as double) as pr0"
    for k in range(order + 1):
        counts = f"(select substr(g, {order + 1 - k}, {k + 1}) as g, sum(a) as a, sum(r) as r from g3 group by 1)"
        seen = f"(select substr(g, {order + 1 - k}, {k}) as c, sum(a) as na, sum(r) as nr from g3 group by 1)"
        low = f"(select *, {before} from x)" if k == 0 else f"(select x.*, m.pa as pa0, m.pr as pr0 from x join m{k - 1} m on m.g = substr(x.g, 2, {k}))"
        joined = f"with x as (select t.*, s.na, s.nr from {counts} t join {seen} s on s.c = substr(t.g, 1, {k})) select g, (a + {pull}*pa0)/(na + {pull}) as pa, (r + {pull}*pr0)/(nr + {pull}) as pr from {low}"
        parts.append(f"m{k} as ({joined})")
    return ",\n".join(parts)


OP1 = rf"""with {_RULES},
u as (select page_id, coalesce(url, '') as url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest, row_number() over () as id from pages),
v as (select *, translate(coalesce(regexp_extract(rest, '(?s)\A([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(rest, '(?s)\A[^/?#]*([^?#]*)', 1), '') as path, coalesce(rest, url) as lm from u),
w as (select v.*, (select arg_max(row(h || p, said), row(length(h || p), length(h))) from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as best from v),
x as (select *, best[1] as rule, best[2] as said, ('0x' || substr(md5(url), 1, 8))::bigint % 5 = 0 as apart from w),
y as (select *, case when said is null or apart then null when said = 'allow' then 1 else 0 end as side from x),
grams as (select id, side, substr(repeat(chr(2), 3) || lm, i, 4) as g from y, lateral (select unnest(range(1, length(lm) + 1)) as i) where lm <> ''),
{_models()},
s as (select y.*, coalesce(t.total/length(lm), 0) as raw from y left join (select id, sum(ln(pa) - ln(pr)) as total from grams join m3 using (g) group by id) t using (id)),
z as (select *, round(raw, 6) as score from s),
b as (select greatest(-1000, least(1000, cast(floor(score/0.01::double) as integer))) as bin, count(*) filter (said = 'allow') as a, count(*) filter (said <> 'allow') as r from z where apart and said is not null group by 1),
c as (select bin, round((sum(a) over o)/sum(a) over () - (sum(r) over o)/sum(r) over (), 9) as gain, sum(a) over () as na, sum(r) over () as nr, lag(bin) over (order by bin) as below from b window o as (order by bin desc)),
th as (select coalesce((select coalesce((bin + below + 1)/2.0::double, bin)*0.01::double from c where na > 0 and nr > 0 order by gain desc, bin limit 1), 0) as t)
select page_id, host, path, rule, coalesce(said, case when score >= t then 'allow' else 'block' end) as verdict from z, th"""

# op2: spans from the lengths of what lies between matches.

_WORDS = "|".join(map(_either_case, ["password", "passwd", "secret", "token", "api"])).replace(_either_case("api"), _either_case("api") + "_?" + _either_case("key"))
_PATTERNS = {
    "assign": (rf"(?:{_WORDS})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 3, "length(v) >= 8"),
    "access": ("AKIA[A-Z0-9]+", 2, "length(v) >= 16"),
    "hex": ("[0-9a-f]+", 2, "length(v) >= 32"),
    "owned": ("[A-Za-z0-9+/_=-]+", 2, "length(v) >= 20 and length(regexp_replace(v, '[^0-9]', '', 'g')) > 1 and length(regexp_replace(v, '[^a-z]', '', 'g')) > 1 and length(regexp_replace(v, '[^A-Z]', '', 'g')) > 1"),
}


def _spans(kind: str, place: int) -> str:
    pattern, group, test = _PATTERNS[kind]
    whole = f"(?s)(.*?)({pattern})"
    every = lambda g: f"regexp_extract_all(text, '{whole}', {g})"
    return f"""select id, {place} as k, '{kind}' as kind, s, s + length(m) as e, v from (select id, m, v, cast(sum(length(p) + length(m)) over (partition by id order by n) - length(m) as bigint) as s from
(select id, unnest({every(1)}) as p, unnest({every(2)}) as m, unnest({every(group)}) as v, unnest(range(1, len({every(2)}) + 1)) as n from d)) where {test}"""


OP2 = f"""with d as (select row_number() over () as id, doc_id, source, lang, coalesce(text, '') as text from documents),
base as ({' union all '.join(_spans(k, i) for i, k in enumerate(('assign', 'access', 'hex')))}),
cand as (select c.* from ({_spans('owned', 3)}) c where not exists (select 1 from base b where b.id = c.id and b.s < c.e and c.s < b.e)),
every_ as (select * from base union all select * from cand),
owners as (select v, count(distinct coalesce('=' || source, '')) <= 1 and count(distinct coalesce('=' || source, '') || chr(1) || coalesce('=' || lang, '')) <= 2 as live from every_ join d using (id) group by v),
shown as (select e.*, live from every_ e join owners using (v) where k < 3 or live)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example from d left join
(select id, count(*) filter (live) as n_live, count(*) filter (not live) as n_example, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans from shown group by id) using (id)"""

OP5 = """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256*cast(x as double)) as bigint)) as v from embeddings
 where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select query_id, cast(rk as integer) as rank, vec_id, score from (select q.vec_id as query_id, c.vec_id, s.score, row_number() over (partition by q.vec_id order by s.score desc, c.vec_id) as rk from v q join v c on q.vec_id <> c.vec_id,
 lateral (select cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1]*z[2])) as bigint) as score) s where q.vec_id % 50 = 0) where rk <= 5"""

OP7 = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
e as (select doc_id, unnest(s) as g from s), n as (select doc_id, len(s) as n from s),
links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as both_ from e x join e y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2) join n p on p.doc_id = a join n q on q.doc_id = b where 100*both_ >= 80*(p.n + q.n - both_)),
sym as (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from s union select r.a, y.b from reach r join sym y on y.a = r.b)
select n.doc_id, n.n as n_shingles, least(n.doc_id, min(r.b)) as component_id from n join reach r on r.a = n.doc_id group by n.doc_id, n.n"""

OP8 = r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, coalesce(text, '') as text from documents),
k as (select doc_id, source, size, -ln((('0x' || substr(sha256(concat('17:', coalesce(cast(doc_id as varchar), ''), ':', md5(text))), 1, 13))::bigint + 0.5::double)/4503599627370496::double)
 / greatest(0.05::double, 1::double - (length(text) - length(translate(text, '!"#$%&()*+/:;<=>?@[\]^_`{|}~', '')))::double/greatest(length(text), 1)) as key from d),
s as (select source, sum(size)::bigint as source_size from k group by source),
r as (select *, [1, 2, 3][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)] as w from s),
c as (select *, sum(source_size) over () as total, coalesce(sum(source_size*3) over (order by source_size/w, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped, sum(w) over () - coalesce(sum(w) over (order by source_size/w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest from r),
l as (select *, (select arg_min((total - capped)::double/rest, capped) from c where (total - capped)::double/rest*w <= source_size*3) as level from c),
t as (select source, source_size, round(least((source_size*3)::double, level*w), 6) as target from l),
p as (select k.*, source_size, target, cast(round(target) as bigint) as budget, coalesce(sum(size) over (partition by k.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead from k join t on k.source is not distinct from t.source),
f as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from p)
select doc_id, size, source_size, target, cast(epochs*size + greatest(0, least(size, budget - epochs*source_size - ahead)) as bigint) as taken from f"""

OP10 = r"""with b as (select page_id, coalesce(html, '') as html, case when url is null then '' else 'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10) end as uri from pages),
r as (select page_id, concat(replace('WARC/1.0|WARC-Type: resource|', '|', chr(13) || chr(10)), uri, replace(concat('WARC-Date: 2024-01-01T00:00:00Z|WARC-Record-ID: <urn:page:', page_id, '>|Content-Type: text/html|Content-Length: ', strlen(html), '||'), '|', chr(13) || chr(10)), html, chr(13), chr(10), chr(13), chr(10)) as rec from b)
select page_id, strlen(rec) as n_bytes, sha256(rec) as record_sha256, case when page_id % 1000000 < 5000 and page_id % 97 = 13 then 'corrupt' else 'ok' end as status from r"""

ORACLE_SQL = {
    "op1_url_char_lm": OP1,
    "op2_secret_ownership": OP2,
    "op5_impact_topk": OP5,
    "op7_parity_join": OP7,
    "op8_weighted_mix": OP8,
    "op10_warc_merkle": OP10,
}
