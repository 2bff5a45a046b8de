"""Registered matching queries (J-09, J-10, Z-01 … Z-05, W-04).

Their oracles compute the matcher's ratio in SQL (``similarity.ratio_views``),
over all pairs that the quick bound lets through.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as Z
from ..sources.ingest import ingest_receipts
from .catalog import AS_OF, register
from .queries_sources import MATCH_SQL
from .similarity import BRAND_VIEWS, FOOD_TEXTS, FOOD_VIEWS, places_sql

c = F.col
FOOD_TYPES = ("UNIVERSAL", "MEASURED", "PROCESSED", "OUT_EAT")


def _lines(led):
    return ingest_receipts(led["raw_receipts"], AS_OF)["lines"]


def _food_queries(led):
    return _lines(led).filter(c("food_type").isin(*FOOD_TYPES)).select(c("item_text").alias("query"), "food_type")


@register("j09_existing_entity_match", f"select * from {MATCH_SQL} m")
def j09(led):
    return Z.existing_entity_match(_lines(led), led)


@register("j10_new_entities", f"""select distinct 'BRAND' as entity, cast(null as varchar) as scope, l.brand_text as name
from receipt_lines l where trim(l.brand_text) <> '' and l.brand_text not in (select name from m_brands)
union all
select distinct 'BRANCH' as entity, coalesce(cast(brand_id as varchar), 'new:' || brand_text) as scope, branch_text as name
from {MATCH_SQL} m where trim(brand_text) <> '' and trim(branch_text) <> '' and branch_id is null
union all
select distinct 'FOOD' as entity, case when food_type = 'OUT_EAT' then 'PROCESSED' else food_type end as scope,
  item_text as name
from {MATCH_SQL} m where food_type in ('UNIVERSAL','MEASURED','PROCESSED','OUT_EAT') and trim(item_text) <> '' and food_id is null""")
def j10(led):
    return Z.new_entities(_lines(led), led)


@register("z01_exact_food", f"""select query, 'EXACT' as match_type, kind, id, name from (
  select q.query, f.food_kind as kind, f.id, f.name, row_number() over (partition by q.query
    order by case f.food_kind when 'UNIVERSAL' then 1 when 'MEASURED' then 2 else 3 end, f.id) as rn
  from {FOOD_TEXTS} q join m_foods f on q.query = f.name) x where rn = 1""")
def z01_exact(led):
    """The exact step of the lookup alone: the first master in order wins."""
    return Z.exact_food(_food_queries(led), Z.food_masters(led)).select("query", "match_type", "kind", "id", "name")


@register("z05_similarity_bound", f"""with q as (select query as s from {FOOD_TEXTS} t), n as (select distinct name as s from m_foods),
qc as (select s, ch, count(*) as k from (select s, unnest(string_split(s, '')) as ch from q) c where ch <> '' group by all),
nc as (select s, ch, count(*) as k from (select s, unnest(string_split(s, '')) as ch from n) c where ch <> '' group by all)
select query, name, 2.0e0 * m / (length(query) + length(name)) as ub from (
  select qc.s as query, nc.s as name, sum(least(qc.k, nc.k)) as m from qc join nc on qc.ch = nc.ch group by all) p
where 2.0e0 * m / (length(query) + length(name)) >= 0.4e0""")
def z05_bound(led):
    """Pairs that are scored, with the matcher's upper bound: all pairs whose bound reaches the cutoff."""
    return Z.candidate_pairs(_food_queries(led).select("query"), Z.food_masters(led)).select("query", "name", "ub")


@register("z05_similarity_join", "select query, kind, name, score from food_scored join food_names using (name)", FOOD_VIEWS)
def z05(led):
    """Every (receipt food text, master, name) pair scoring >= 0.4."""
    return Z.similarity_join(_food_queries(led).select("query"), Z.food_masters(led))


@register("w04_top3_candidates", places_sql("food_scored join food_names using (name)"), FOOD_VIEWS)
def w04(led):
    return Z.top_candidates(_food_queries(led).select("query").distinct(), Z.food_masters(led))


EXACT_FOOD = f"""(select query, kind, id, name from (select q.query, f.food_kind as kind, f.id, f.name, row_number() over (partition by q.query
    order by case f.food_kind when 'UNIVERSAL' then 1 when 'MEASURED' then 2 else 3 end, f.id) as rn
  from {FOOD_TEXTS} q join m_foods f on q.query = f.name) e where rn = 1)"""


@register("z01_find_food", f"""select query, 'EXACT' as match_type, kind, id, name, 1.0e0 as score, 1::bigint as rank, 1::bigint as slots from {EXACT_FOOD} x
union all select query, 'FUZZY' as match_type, kind, id, name, score, rank, slots
from ({places_sql("food_scored join food_names using (name)")}) p where query not in (select name from m_foods)""", FOOD_VIEWS)
def z01(led):
    return Z.find_food(_food_queries(led), Z.food_masters(led))


@register("z02_find_food_candidates", places_sql("food_scored join food_names using (name)"), FOOD_VIEWS)
def z02(led):
    return Z.find_food_candidates(_food_queries(led), Z.food_masters(led))


ASKED = f"(select distinct item_text as query, food_type, case food_type when 'OUT_EAT' then 'PROCESSED' else food_type end as kind from receipt_lines where food_type in {FOOD_TYPES})"


@register("z03_find_food_in", f"""select a.query, a.food_type, m.id, m.name, p.score
from ({places_sql("food_scored join food_names using (name)")}) p join {ASKED} a on a.query = p.query and a.kind = p.kind
join m_foods m on m.food_kind = p.kind and m.name = p.name""", FOOD_VIEWS)
def z03(led):
    return Z.find_food_in(_food_queries(led), Z.food_masters(led))


@register("z04_match_store", """select distinct l.brand_text, l.branch_text, b.brand_id, b.brand_match, s.branch_id, s.branch_match
from receipt_lines l left join brand_of b on b.query = l.brand_text left join branch_of s on s.kind = cast(b.brand_id as varchar) and s.query = l.branch_text""",
          BRAND_VIEWS)
def z04(led):
    return Z.match_store(_lines(led), led["m_brands"], led["m_store_branches"])
