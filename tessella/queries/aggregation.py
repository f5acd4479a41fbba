"""Aggregates and orders (groups D and E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import number, phase_ordinal
from tessella.operators import ordering as O
from tessella.operators import summary as S
from tessella.plans import star
from tessella.sources.curate import first_per_key

from .registry import SQL, query


@query("count_distinct", "select count(distinct l_partkey) as n from lineitem")
def _(t):
    return S.how_many(t.lineitem, "l_partkey")


@query("stats", "select l_returnflag, round(avg(l_extendedprice), 4) as avg, round(sum(l_extendedprice), 2) as sum, min(l_extendedprice) as min, max(l_extendedprice) as max, round(median(l_extendedprice), 4) as median from lineitem group by 1")
def _(t):
    s = S.statistics(t.lineitem, "l_extendedprice", ["l_returnflag"])
    return s.select("l_returnflag", F.round("avg", 4).alias("avg"), F.round("sum", 2).alias("sum"), "min", "max", F.round("median", 4).alias("median"))


@query("stats_approximate", "select l_returnflag, count(*) as n, true as near from lineitem group by 1")
def _(t):
    """The approximate median lies between the values at 49 and 51 % of the rows."""
    s = S.statistics(t.lineitem, "l_extendedprice", ["l_returnflag"], approximate=True).select("l_returnflag", "median")
    x = t.lineitem.join(s, "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_extendedprice") <= F.col("median")).alias("low"))
    return x.select("l_returnflag", "n", (F.abs(F.col("low") / F.col("n") - 0.5) <= 0.01 + 1 / F.col("n")).alias("near"))


@query("share", "select l_returnflag, round(count(*) filter (where l_discount > 0.05) / count(*), 6) as share from lineitem group by 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(S.share(F.col("l_discount") > 0.05), 6).alias("share"))


@query("having", "select l_partkey, count(distinct l_suppkey) as n from lineitem group by 1 having count(distinct l_suppkey) >= 30")
def _(t):
    return S.having(t.lineitem, ["l_partkey"], "l_suppkey", 30)


@query("require_all", "select l_partkey, l_returnflag, l_suppkey from lineitem where l_returnflag in ('A', 'R') and (l_partkey, l_suppkey) in (select (l_partkey, l_suppkey) from lineitem where l_returnflag in ('A', 'R') group by l_partkey, l_suppkey having count(distinct l_returnflag) = 2)")
def _(t):
    return star.linked_to_all(t.lineitem.select("l_partkey", "l_returnflag", "l_suppkey"), "l_returnflag", ["a", "R"], ["l_partkey", "l_suppkey"])


@query("anchor_all", "select l_partkey from lineitem where l_suppkey in (1, 2) group by 1 having count(distinct l_suppkey) = 2")
def _(t):
    return S.linked_partners(t.lineitem.withColumn("l_suppkey", F.col("l_suppkey").cast("string")), "l_suppkey", "l_partkey", ["1", "2"])


@query("intersection_summary", "select count(distinct p_name) as n, array_to_string(list_sort(list(distinct p_name))[1:50], ', ') as names from part")
def _(t):
    return S.intersection_summary(t.part, "p_name")


@query("text_rollup", "select p_brand, array_to_string(list_sort(list(distinct p_type)), '; ') as p_type, min(p_name) as p_name from part group by 1")
def _(t):
    return S.text_rollup(t.part, ["p_brand"], ["p_type"], ["p_name"])


@query("text_rollup_nested", "select p_brand, array_to_string(list_sort(list(distinct x)), '; ') as x from (select p_brand, p_type, p_type || ': ' || min(p_name) as x from part group by p_brand, p_type) group by 1")
def _(t):
    first = S.text_rollup(t.part, ["p_brand", "p_type"], [], ["p_name"]).withColumn("x", F.concat("p_type", F.lit(": "), "p_name"))
    return S.text_rollup(first, ["p_brand"], ["x"], [])


@query(
    "col_profile",
    " union all ".join(f"""select '{c}' as "column", count(distinct {c}) as n_distinct, coalesce(max(length({c}::varchar)), 0)::int as longest, count(distinct {c}) <= 1 as constant from part""" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size")),
)
def _(t):
    return S.profile(t.part.drop("p_retailprice"))


@query("answer_lists", """select 'p_type' as "column", count(distinct p_type) as n, array_to_string(list_sort(list(distinct p_type)), '|') as "values" from part union all select 'p_brand', count(distinct p_brand), array_to_string(list_sort(list(distinct p_brand)), '|') from part""")
def _(t):
    return S.answer_lists(t.part.withColumn("one", F.lit("x")), ["p_type", "p_brand", "one", "p_partkey"], most=50)


@query("row_counts", "select count(*) as n, count(*) filter (where p_size > 25) as large, max(length(p_name)) as longest from part")
def _(t):
    return t.part.agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"), F.max(F.length("p_name")).cast("long").alias("longest"))


@query("row_greatest", "select l_partkey, l_suppkey, greatest(n * 10000, price) as top, n * 10000 > price as n_wins, (n > 1)::int + (price > 50000)::int as met from links", "links")
def _(t):
    n = F.col("n") * 10000
    return t.links.select("l_partkey", "l_suppkey", F.greatest(n, "price").alias("top"), (n > F.col("price")).alias("n_wins"), ((F.col("n") > 1).cast("int") + (F.col("price") > 50000).cast("int")).alias("met"))


@query("token_df", "select token, count(*) as n from (select distinct p_partkey, unnest(string_split(upper(p_type || '_' || replace(p_name, ' ', '_')), '_')[2:]) as token from part) where length(token) >= 4 and regexp_matches(token, '^[A-Z]+$') and token <> 'RING' group by 1 having count(*) between 100 and 2000")
def _(t):
    return S.token_frequency(t.part.select(F.concat_ws("_", "p_type", F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name")), "name", least_length=4, band=(100, 2000), stop=("RING",))


@query("low_card", """select 'p_type' as "column", array_to_string(list_sort(list(distinct p_type)), '|') as "values" from part union all select 'p_brand', array_to_string(list_sort(list(distinct p_brand)), '|') from part having count(distinct p_brand) <= 25""")
def _(t):
    return S.low_cardinality(t.part)


@query("result_hierarchy", """select p_type, '{' || string_agg('"' || p_brand || '":' || names, ',' order by p_brand) || '}' as tree from (select p_type, p_brand, '[' || string_agg(distinct '"' || p_name || '"', ',' order by '"' || p_name || '"') || ']' as names from part group by all) group by 1""")
def _(t):
    levels = S.by_cardinality(t.part, ["p_brand", "p_type"])
    return S.hierarchy_json(t.part, levels, "p_name")


@query("approved_summary", "select count(distinct o_custkey) as n, count(*) as orders from orders where contains(upper(o_orderpriority), 'URGENT')")
def _(t):
    return t.orders.where(F.upper("o_orderpriority").contains("URGENT")).agg(F.countDistinct("o_custkey").alias("n"), F.count("*").alias("orders"))


@query("rank_sort", "select l_partkey, l_suppkey, n, price, row_number() over (order by n desc, price desc, l_partkey, l_suppkey) as place from links", "links")
def _(t):
    ranked = [("n", True), ("price", True)]
    rows = t.links.select("l_partkey", "l_suppkey", "n", "price")
    return O.placed(rows, star.ordering(ranked, rows.columns))


@query("category_sort", "select o_orderkey, o_orderpriority, row_number() over (order by case o_orderpriority when '2-HIGH' then 0 when '1-URGENT' then 1 else 2 end, case when contains(lower(o_orderstatus), 'f') then 0 else 1 end, o_orderkey) as place from orders")
def _(t):
    place = O.category_place(F.col("o_orderpriority"), ["2-HIGH", "1-URGENT"])
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return O.placed(rows, [F.asc(place), F.asc(O.any_of_first(F.col("o_orderstatus"), ["F"])), F.asc("o_orderkey")]).drop("o_orderstatus")


@query("stable_order", "select p_partkey, p_size from part order by p_size, p_partkey limit 50")
def _(t):
    return O.top(t.part.select("p_size", "p_partkey"), 50)


@query("first_per_key", "select p_name, p_partkey from (select *, row_number() over (partition by p_name order by p_size desc, p_partkey) as rn from part) where rn = 1")
def _(t):
    return first_per_key(t.part, ["p_name"], [F.desc("p_size"), F.asc("p_partkey")]).select("p_name", "p_partkey")


PHASE = "case o_orderpriority when '1-URGENT' then 'APPROVAL' when '2-HIGH' then 'PHASE_2_3' when '3-MEDIUM' then 'PRECLINICAL' when '5-LOW' then 'Phase 1' end"


def phases(t):
    p = F.col("o_orderpriority")
    return F.when(p == "1-URGENT", "APPROVAL").when(p == "2-HIGH", "PHASE_2_3").when(p == "3-MEDIUM", "PRECLINICAL").when(p == "5-LOW", "Phase 1")


@query("phase_sort", f"select o_orderkey, case {PHASE} when 'APPROVAL' then 5 when 'PHASE_2_3' then 3 when 'PRECLINICAL' then 0 when 'Phase 1' then 1 else -1 end as stage from orders")
def _(t):
    return t.orders.select("o_orderkey", phase_ordinal(phases(t)).alias("stage"))


@query("score_phase_sort", f"select o_orderkey, o_totalprice, {PHASE} as phase, row_number() over (order by o_totalprice desc, case {PHASE} when 'APPROVAL' then 5 when 'PHASE_2_3' then 3 when 'PRECLINICAL' then 0 when 'Phase 1' then 1 else -1 end desc, o_orderkey) as place from orders")
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", phases(t).alias("phase"))
    return O.placed(rows, [F.desc(O.score_value(rows, "o_totalprice")), F.desc(O.score_value(rows, "phase")), F.asc("o_orderkey")])


@query("topk_ids", "select k, s from (select lower(trim(p_name)) as k, max(p_retailprice) as s from part group by 1) order by s desc, k limit 10")
def _(t):
    return O.top_ids(t.part.select("p_name", "p_retailprice"), "p_name", "p_retailprice", 10).select(F.lower("p_name").alias("k"), F.col("p_retailprice").alias("s"))


@query("positive_topk", "select s_suppkey, s_acctbal from supplier where s_acctbal > 0 order by s_acctbal desc, s_suppkey limit 25")
def _(t):
    return O.positive_top(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal")


@query("rerank", f"select o_orderkey, tier, approval, row_number() over (order by tier, approval, o_orderkey) as place from (select o_orderkey, case when lower(o_orderpriority) = 'f' or lower(o_orderstatus) = 'f' then 0 when contains(lower(o_orderpriority), 'f') then 1 else 2 end as tier, case {PHASE} when 'APPROVAL' then 0 when 'PHASE_2_3' then 2 when 'PRECLINICAL' then 4 when 'Phase 1' then 3 else 10 end as approval from orders)")
def _(t):
    rows = t.orders.select("o_orderkey", O.entity_tier(["o_orderpriority", "o_orderstatus"], ["F"]).alias("tier"), O.approval_tier(phases(t)).alias("approval"))
    return O.placed(rows, [F.asc("tier"), F.asc("approval"), F.asc("o_orderkey")])


@query("full_distinct", "select distinct p_name, p_brand from part")
def _(t):
    return t.part.select("p_name", "p_brand").dropDuplicates()


@query("row_handles", "select 'part:' || row_number() over (order by p_partkey) as handle, p_partkey from part")
def _(t):
    return O.handles(t.part.select("p_partkey"), "part", [F.asc("p_partkey")])


@query("bounded_preview", "select doc_id, case when length(text) > 200 then substr(text, 1, 200) || '…' else text end as text from documents order by doc_id limit 50")
def _(t):
    return O.preview(t.documents.select("doc_id", "text").orderBy("doc_id"), 50)


@query(
    "budget",
    """with r as (select p_partkey, p_name, row_number() over (order by p_partkey) as i, sum(length(to_json({'p_partkey': p_partkey, 'p_name': p_name})::varchar)) over (order by p_partkey) as size from part),
    h as (select unnest([64, 32, 16, 8, 4, 2, 1]) as h), n as (select max(h) as n from h where (select max(size) from r where i <= h) <= 720)
    select p_partkey, p_name from r where i <= (select coalesce(n, 1) from n)""",
)
def _(t):
    return O.within_budget(t.part.select("p_partkey", "p_name"), [F.asc("p_partkey")], 64, 720)


@query("lexical", "select p_partkey, n as overlap from (select p_partkey, list_contains(string_split(p_name, ' '), 'ring')::int + list_contains(string_split(p_name, ' '), 'blue')::int as n from part where p_partkey > 100) where n > 0 order by n desc, p_partkey limit 30")
def _(t):
    return O.lexical_rescue(t.part.select("p_partkey", "p_name"), "p_partkey", 100, "blue ring: which one is that", stop=("which", "that"), most=30).select("p_partkey", "overlap")


@query("nested_sort", "select p_brand, array_to_string(list(p_type order by r desc, p_type), ',') as types from (select p_brand, p_type, case p_type when 'SMALL' then 2 when 'ECONOMY' then 1 else -1 end as r from part group by all) group by 1")
def _(t):
    rank = F.coalesce(F.try_element_at(F.create_map(F.lit("SMALL"), F.lit(2), F.lit("ECONOMY"), F.lit(1)), "p_type"), F.lit(-1))
    rows = t.part.select("p_brand", F.struct((-rank).alias("r"), "p_type").alias("x")).distinct().groupBy("p_brand").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("p_brand", F.array_join(F.transform("x", lambda e: e.p_type), ",").alias("types"))


@query("row_limit", "select s_suppkey from supplier order by s_suppkey limit 7")
def _(t):
    return t.supplier.select("s_suppkey").orderBy("s_suppkey").limit(O.row_limit("give me the top 7 suppliers"))


@query("sql_view", "select p_type, count(*) as n, round(avg(p_retailprice), 2) as avg_price from part where lower(p_brand) = 'brand#1' group by 1 having count(*) >= 2")
def _(t):
    return t.spark.sql("select p_type, count(*) as n, round(avg(p_retailprice), 2) as avg_price from {df} where lower(p_brand) = 'brand#1' group by 1 having count(*) >= 2", df=t.part)


@query("number_text", "select o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) as double) as v from orders where o_orderpriority ilike '%urgent%' or regexp_matches(o_orderpriority, '^[35]') or length(o_orderpriority) = 6")
def _(t):
    p = F.col("o_orderpriority")
    return t.orders.where(p.ilike("%urgent%") | p.rlike("^[35]") | (F.length(p) == 6)).select("o_orderkey", number(F.split_part(p, F.lit("-"), F.lit(1))).alias("v"))


@query("stats_selected", SQL["stats"])
def _(t):
    """The same, by selection over ranges of the values whatever the groups' sizes."""
    s = S.statistics(t.lineitem, "l_extendedprice", ["l_returnflag"], in_task=0)
    return s.select("l_returnflag", F.round("avg", 4).alias("avg"), F.round("sum", 2).alias("sum"), "min", "max", F.round("median", 4).alias("median"))
