"""DuckDB SQL for the operators that SQL can express."""

_EDGE = "([^A-Za-z0-9_.%-]|$)"
_LABEL = "(?s)^[^:]*://([^/?#]*\\.)?"

OP1 = f"""
with parts as (
  select page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages),
ruled as (
  select *, case
      when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
      when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
      when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
      when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
      when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule,
    case
      when url is null then null
      when regexp_matches(url, '{_LABEL}example\\.net{_EDGE}en{_EDGE}1.*{_EDGE}') then '@@||example.net^en^1*^'
      when regexp_matches(url, '{_LABEL}ads-track\\..*{_EDGE}') then '||ads-track.*^'
      when contains(url, '-bets.') then '-bets.'
      when regexp_matches(url, '{_LABEL}casino-win\\.') then '||casino-win.'
      when regexp_matches(url, '{_LABEL}cheap-pills\\.') then '||cheap-pills.'
      when regexp_matches(url, '{_LABEL}spam-farm\\.') then '||spam-farm.'
      when regexp_matches(url, '{_LABEL}adult-x\\.') then '||adult-x.'
      when ends_with(url, 'utm_source=feed') then 'utm_source=feed|'
      when regexp_matches(url, '{_EDGE}index\\.php{_EDGE}') then '^index.php^' end as pat
  from parts)
select page_id, host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when pat is null or pat like '@@%' then 'allow' else 'block' end as verdict,
  case when rule is null then pat end as pattern
from ruled
"""

OP4 = """
with base as (
  select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) end as size,
    sha256(coalesce(cast(doc_id as varchar), '-') || '|' || coalesce(md5(text), '-')) as hex
  from documents),
sizes as (
  select source, sum(size)::bigint as words, ((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::double as weight
  from base group by source),
sums as (
  select *, words * 3.0::double as ceiling,
    (sum(words) over ())::double - coalesce(sum(words * 3.0::double) over (order by words / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as left_over,
    sum(weight) over (order by words / weight, source asc nulls last rows between current row and unbounded following) as weight_left
  from sizes),
marked as (select *, ceiling * weight_left < weight * left_over as capped from sums),
level as (select left_over as l, weight_left as w from marked where not capped order by words / weight, source asc nulls last limit 1),
rates as (
  select source, words, case when capped then ceiling else least(ceiling, weight * l / w) end as target
  from marked left join level on true),
r as (select *, case when words > 0 then least(target / words, 3.0::double) else 0 end as rate from rates),
tries as (
  select b.source, j, abs(sum(b.size * (floor(r.rate) + case when ('0x' || substr(b.hex, (j * 8 + 1)::int, 8))::bigint / 4294967296.0::double < r.rate - floor(r.rate) then 1 else 0 end)) - any_value(r.target)) as miss
  from base b join r on b.source is not distinct from r.source cross join range(8) t(j)
  group by b.source, j),
pick as (select source, arg_min(j, (miss, j)) as j from tries group by source)
select b.doc_id, b.size::bigint as size, r.words as source_size, r.target,
  (b.size * (floor(r.rate) + case when ('0x' || substr(b.hex, (p.j * 8 + 1)::int, 8))::bigint / 4294967296.0::double < r.rate - floor(r.rate) then 1 else 0 end))::bigint as taken
from base b join r on b.source is not distinct from r.source join pick p on b.source is not distinct from p.source
"""

OP2 = """
with valid as (
  select distinct vec_id, embedding from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
rows as (select row_number() over () as r, vec_id, embedding from valid),
parts as (select r, vec_id, unnest(generate_series(1, len(embedding))) as i, unnest(embedding) as x from rows),
ints as (select r, vec_id, i, cast(floor(256 * cast(x as double)) as bigint) as v from parts),
none as (select a.r as qr, a.vec_id as query_id, b.r, b.vec_id from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
sums as (
  select q.r as qr, c.r, sum(q.v * c.v)::bigint as score
  from ints q join ints c on q.i = c.i and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by q.r, c.r),
ranked as (
  select n.query_id, n.vec_id, coalesce(s.score, 0) as score,
    cast(row_number() over (partition by n.qr order by coalesce(s.score, 0) desc, n.vec_id) as int) as rank
  from none n left join sums s on s.qr = n.qr and s.r = n.r)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

_WORDS = "case when text is null then [] else regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') end"

OP6 = f"""
with items as (select distinct coalesce(cast(item_id as varchar), '') as item, {_WORDS} as w from benchmark),
windows as (
  select item, array_to_string(w[p:p + 12], ' ') as window, least(len(w), 13) as l
  from (select item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as p from items where len(w) > 0)),
sizes as (select distinct l from windows),
docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
spots as (
  select r, l, p, array_to_string(w[p:p + l - 1], ' ') as window
  from (select r, w, l, unnest(generate_series(1, len(w) - l + 1)) as p from docs, sizes where len(w) >= l)),
hits as (select distinct s.r, s.p, s.l, x.item from spots s join windows x on s.window = x.window and s.l = x.l),
hit_words as (select r, count(distinct k) as n_hit from (select r, unnest(generate_series(p, p + l - 1)) as k from (select distinct r, p, l from hits)) group by r),
found as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hits) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(f.n_items, 0)::bigint as n_items,
  sha256(coalesce(f.items, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(d.w) as contaminated
from docs d left join hit_words h on h.r = d.r left join found f on f.r = d.r
"""

OP10 = """
with every as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
escaped as (
  select *, replace(replace(replace(text, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>') as e,
    replace(replace(replace(replace(role, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>'), ':', '\\:') as r
  from every)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(r) + 2 + length(e) + 9)::bigint as formatted_chars
from escaped group by conv_id
"""

OP9 = f"""
with recursive docs as (select row_number() over () as r, doc_id, text, {_WORDS} as w from documents),
sets as (
  select distinct r, array_to_string(w[p:p + k - 1], ' ') as g
  from (select r, w, least(5, len(w)) as k, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) as p from docs where len(w) > 0)),
sizes as (select r, count(*) as n from sets group by r),
shared as (select x.r as a, y.r as b, count(*) as o from sets x join sets y on x.g = y.g and x.r < y.r group by x.r, y.r),
pairs as (
  select a, b from shared join sizes s on s.r = a join sizes t on t.r = b where 9 * o >= 4 * (s.n + t.n)
  union select x.r, y.r from docs x join docs y on x.text = y.text and x.r < y.r where len(x.w) = 0),
ways as (select a, b from pairs union all select b, a from pairs),
reach as (select r as a, r as b from docs union select x.a, y.b from reach x join ways y on x.b = y.a),
class as (select x.a as r, min(d.doc_id) as class_id from reach x join docs d on d.r = x.b group by x.a),
degree as (select a as r, count(*) as n from ways group by a)
select d.doc_id, c.class_id, coalesce(g.n, 0)::bigint as n_links from docs d join class c on c.r = d.r left join degree g on g.r = d.r
"""

OP13 = """
with hashed as (select row_number() over () as r, page_id, url, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages),
ranked as (
  select *, row_number() over same as place, first_value(page_id) over same as first_id
  from hashed window same as (partition by payload order by page_id nulls last, url nulls last, r))
select page_id, strlen(payload)::bigint as payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (i // 4 * 5 + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest,
  case when place = 1 then 'response' else 'revisit' end as record_type,
  case when place > 1 then first_id end as refers_to, url
from ranked
"""

SQL: dict[str, str] = {"op13_warc": OP13, "op1_url_filter": OP1, "op2_topk": OP2, "op4_mixing": OP4, "op6_decontamination": OP6, "op9_jaccard_join": OP9, "op10_chat": OP10}
