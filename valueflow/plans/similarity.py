"""The sequence matcher's ratio and its top three in SQL, for the oracles of the matching queries."""

from __future__ import annotations

FOOD_TYPES = ("UNIVERSAL", "MEASURED", "PROCESSED", "OUT_EAT")
FOOD_TEXTS = f"(select distinct item_text as query from receipt_lines where food_type in {FOOD_TYPES})"


def ratio_views(name: str, asked: str, names: str, on: str = "true", also: str = "") -> list[tuple[str, str]]:
    """CTEs that end in ``<name>_scored`` (query, name, score, ``also``): the pairs of ``asked`` q and ``names`` n that reach 0.4.

    Of the common runs of two strings inside a range the longest is a block
    (then the one that starts first in the name, then in the query); the
    ranges before and after it are searched again.  The score is twice the
    length of all blocks over both lengths.
    """
    more = f", {also}" if also else ""
    chars = "unnest(generate_series(1, length({0}))) as {1}, unnest(string_split({0}, '')) as ch"
    return [
        (f"{name}_all", f"select row_number() over () as p, q.query, n.name{more} from {asked} q join {names} n on {on}"),
        (f"{name}_q", f"select query, {chars.format('query', 'j')} from (select distinct query from {name}_all) x"),
        (f"{name}_n", f"select name, {chars.format('name', 'i')} from (select distinct name from {name}_all) x"),
        (f"{name}_bound", f"""select query, name from (
  select query, name, sum(least(a, b)) as m from (select query, ch, count(*) as a from {name}_q group by all) x
    join (select name, ch, count(*) as b from {name}_n group by all) y using (ch) group by query, name) z
where 2.0e0 * m / (length(query) + length(name)) >= 0.4e0"""),
        (f"{name}_pairs", f"select * from {name}_all join {name}_bound using (query, name)"),
        (f"{name}_cells", f"select p, i, i - j as d from {name}_pairs join {name}_n using (name) join {name}_q using (query, ch)"),
        (f"{name}_runs", f"""select p, d, min(i) as i0, count(*) as n
from (select p, d, i, i - row_number() over (partition by p, d order by i) as g from {name}_cells) x group by p, d, g"""),
        (f"{name}_ranges", f"""select p, 1::bigint as a0, length(name) + 1::bigint as a1, 1::bigint as b0, length(query) + 1::bigint as b1, 0::bigint as got from {name}_pairs
union all
select p, x.a0, x.a1, x.b0, x.b1, x.got from (
  select p, unnest([{{'a0': a0, 'a1': b.s, 'b0': b0, 'b1': b.s - b.d, 'got': b.k}}, {{'a0': b.s + b.k, 'a1': a1, 'b0': b.s - b.d + b.k, 'b1': b1, 'got': 0}}]) as x
  from (select p, a0, a1, b0, b1, arg_max({{'s': s, 'd': d, 'k': k}}, (k, -s, d)) as b
    from (select t.*, r.d, greatest(r.i0, a0, b0 + r.d) as s, least(r.i0 + r.n, a1, b1 + r.d) - greatest(r.i0, a0, b0 + r.d) as k
      from {name}_ranges t join {name}_runs r on r.p = t.p where t.a0 < t.a1 and t.b0 < t.b1) y
    where k > 0 group by p, a0, a1, b0, b1) z) w"""),
        (f"{name}_scored", f"""select query, name, score{more and ", " + also.split(".")[-1]} from (
  select p, 2.0e0 * sum(got) / (any_value(length(query)) + any_value(length(name))) as score from {name}_ranges join {name}_pairs using (p) group by p) x
  join {name}_pairs using (p) where score >= 0.4e0"""),
    ]


def places_sql(scored: str) -> str:
    """The best three places per (query, kind) of rows (query, kind, name, id, copies, score)."""
    return f"""select query, kind, name, id, score, (before + 1)::bigint as rank, least(copies, 3 - before)::bigint as slots from (
  select *, coalesce(sum(copies) over (partition by query, kind order by score desc, name desc rows between unbounded preceding and 1 preceding), 0) as before
  from {scored}) w where before < 3"""


FOOD_VIEWS = [("food_names", "select food_kind as kind, name, count(*) as copies, min(id) as id from m_foods group by food_kind, name"),
              *ratio_views("food", FOOD_TEXTS, "(select distinct name from m_foods)")]

BRAND_VIEWS = [
    *ratio_views("brand", "(select distinct brand_text as query from receipt_lines where brand_text not in (select name from m_brands))",
                 "(select distinct name from m_brands)"),
    ("brand_places", places_sql("brand_scored join (select 'BRAND' as kind, name, count(*) as copies, min(id) as id from m_brands group by name) m using (name)")),
    ("brand_of", """select name as query, min(id) as brand_id, 'EXACT' as brand_match from m_brands group by name
union all select query, id, 'FUZZY' from brand_places where rank = 1"""),
    ("branch_asked", "select distinct l.branch_text as query, cast(b.brand_id as varchar) as kind from receipt_lines l join brand_of b on b.query = l.brand_text where l.branch_text is not null"),
    ("branch_names", "select cast(brand_id as varchar) as kind, branch_name as name, count(*) as copies, min(id) as id from m_store_branches group by all"),
    *ratio_views("branch", "(select a.* from branch_asked a anti join branch_names m on m.kind = a.kind and m.name = a.query)", "branch_names", "n.kind = q.kind", "q.kind"),
    ("branch_places", places_sql("branch_scored join branch_names using (kind, name)")),
    ("branch_of", """select a.kind, a.query, m.id as branch_id, 'EXACT' as branch_match from branch_asked a join branch_names m on m.kind = a.kind and m.name = a.query
union all select kind, query, id, 'FUZZY' from branch_places where rank = 1"""),
]
