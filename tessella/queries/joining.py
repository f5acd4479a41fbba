"""Joins and set operations (groups C and F)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import is_structural
from tessella.operators import keyed as K
from tessella.operators.ordering import running
from tessella.plans import star
from tessella.plans.spec import JoinEdge, SortKey, StarPlan
from tessella.sources.curate import full_names  # noqa: F401

from .registry import query


def flagship(t, **how):
    """Which parts did customers of one segment order from suppliers of two nations."""
    catalog = {"nation": t.nation, "supplier": t.supplier, "lineitem": t.lineitem, "part": t.part, "orders": t.orders, "customer": t.customer}
    plan = StarPlan(
        parents={"lineitem": None, "supplier": "lineitem", "nation": "supplier", "part": "lineitem", "orders": "lineitem", "customer": "orders"},
        joins=(
            JoinEdge("lineitem", "supplier", ("l_suppkey",), ("s_suppkey",)),
            JoinEdge("supplier", "nation", ("s_nationkey",), ("n_nationkey",)),
            JoinEdge("part", "lineitem", ("p_partkey",), ("l_partkey",)),
            JoinEdge("lineitem", "orders", ("l_orderkey",), ("o_orderkey",)),
            JoinEdge("orders", "customer", ("o_custkey",), ("c_custkey",)),
        ),
        outputs=("p_name", "n_name", "s_name", "o_orderpriority"),
        rank=(("absent", True), ("l_extendedprice", True)),
        tie_breakers=("l_quantity",),
    )
    return star.run(catalog, plan, {"n_name": ["nation_18", "NATION_19"], "c_mktsegment": ["Household"], "p_name": "requested"}, **how)


STAR = """select distinct p_name, n_name, s_name, o_orderpriority, c_mktsegment, l_extendedprice
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join part on l_partkey = p_partkey
  join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  where n_name in ('NATION_18', 'NATION_19') and c_mktsegment = 'HOUSEHOLD'"""


@query("star_join", STAR)
def _(t):
    return flagship(t).rows


@query(
    "star_funnel",
    """select 1 as step, 'n_name' as "column", 'nation' as "table", count(*) as rows_before, count(*) filter (where n_name in ('NATION_18', 'NATION_19')) as rows_after, round(100.0 * count(*) filter (where n_name not in ('NATION_18', 'NATION_19')) / count(*), 4) as reduction_pct from nation
    union all select 1, 'c_mktsegment', 'customer', count(*), count(*) filter (where c_mktsegment = 'HOUSEHOLD'), round(100.0 * count(*) filter (where c_mktsegment <> 'HOUSEHOLD') / count(*), 4) from customer""",
)
def _(t):
    return flagship(t).funnel


JOINS = """with n as (select n_nationkey from nation where n_name in ('NATION_18', 'NATION_19')),
    s1 as (select l.* from lineitem l join supplier on l_suppkey = s_suppkey), s2 as (select s1.* from s1 join supplier on l_suppkey = s_suppkey join n on s_nationkey = n_nationkey),
    s3 as (select s2.* from s2 join part on l_partkey = p_partkey), s4 as (select s3.*, o_custkey from s3 join orders on l_orderkey = o_orderkey), s5 as (select s4.* from s4 join customer on o_custkey = c_custkey where c_mktsegment = 'HOUSEHOLD')
    select 1 as step, 'supplier' as "table", (select count(*) from lineitem) as rows_before, (select count(*) from s1) as rows_after union all select 2, 'nation', (select count(*) from s1), (select count(*) from s2)
    union all select 3, 'part', (select count(*) from s2), (select count(*) from s3) union all select 4, 'orders', (select count(*) from s3), (select count(*) from s4) union all select 5, 'customer', (select count(*) from s4), (select count(*) from s5)"""


@query("star_joins", JOINS)
def _(t):
    return flagship(t).joins


@query("star_observed", JOINS)
def _(t):
    return flagship(t, observe=True).joins


@query("star_observed_rows", STAR)
def _(t):
    return flagship(t, observe=True).rows


@query(
    "join_factors",
    """select 0 as step, (select count(*) from orders where o_orderstatus = 'F') as n
    union all select 1, (select coalesce(max(n), 0) from (select count(*) as n from lineitem where l_returnflag = 'R' group by l_orderkey))
    union all select 2, (select coalesce(max(n), 0) from (select count(*) as n from links group by l_partkey))""",
    "links",
)
def _(t):
    root, items = t.orders.where("o_orderstatus = 'F'"), t.lineitem.where("l_returnflag = 'R'")
    joined = root.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return star.join_factors(root, [(root, items, [("o_orderkey", "l_orderkey")]), (joined, t.links, [("l_partkey", "l_partkey")])])


SEGMENTS = ("MACHINERY", "BUILDING")


@query(
    "star_sorted",
    """with s as (select distinct c_mktsegment, n_name, c_acctbal, c_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA')
    select *, row_number() over (order by case c_mktsegment when 'MACHINERY' then 0 when 'BUILDING' then 1 else 2 end, case when n_name like '%1%' then 0 else 1 end, c_acctbal desc nulls last, c_mktsegment, c_name, n_name) as place from s""",
)
def _(t):
    plan = StarPlan(
        parents={"customer": None, "nation": "customer", "region": "nation"},
        joins=(JoinEdge("customer", "nation", ("c_nationkey",), ("n_nationkey",)), JoinEdge("nation", "region", ("n_regionkey",), ("r_regionkey",))),
        outputs=("c_mktsegment", "c_name", "n_name", "c_acctbal"), rank=(("c_acctbal", True),),
        sort=(SortKey("c_mktsegment", order=SEGMENTS), SortKey("absent", descending=True), SortKey("n_name", contains_first=("1",))),
    )
    rows = star.run({"customer": t.customer, "nation": t.nation, "region": t.region}, plan, {"r_name": ["Asia"]}).rows
    order = star.ordering(star.rank_columns(plan, rows.columns), rows.columns, plan.sort)
    return running(rows, order, {"place": F.lit(1)}).withColumn("place", (F.col("place") + 1).cast("long"))


@query("star_rewritten", "select distinct r_name, n_name from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'")
def _(t):
    plan = StarPlan(parents={"nation": None, "region": "nation"}, joins=(JoinEdge("nation", "region", ("n_regionkey",), ("r_regionkey",)),), outputs=("n_name", "r_name"), rewrites={"r_name": {"far east": "Asia"}})
    return star.run({"nation": t.nation, "region": t.region}, plan, {"r_name": ["Far East"]}).rows


@query("star_retry", "select distinct n_name, r_name from nation join region on n_regionkey = r_regionkey where lower(r_name) = 'asia'")
def _(t):
    plan = StarPlan(parents={"nation": None, "region": "nation"}, joins=(JoinEdge("nation", "region", ("n_regionkey",), ("r_regionkey",)),), outputs=("n_name", "r_name"))
    return star.run({"nation": t.nation, "region": t.region}, plan, {"r_name": ["Atlantis"]}, on_empty=lambda f: {"r_name": ["Asia"]}).rows


@query("star_decorated", "select distinct d.doc_id, lang, source, quality from documents d left join labels l on d.doc_id = l.doc_id where lower(lang) in ('en')")
def _(t):
    plan = StarPlan(parents={"documents": None, "labels": "documents"}, joins=(JoinEdge("documents", "labels", ("doc_id",), ("doc_id",)),), outputs=("doc_id", "source", "quality"), decorations=frozenset({"labels"}))
    return star.run({"documents": t.documents.select("doc_id", "lang", "source"), "labels": t.labels}, plan, {"lang": ["EN"]}).rows


@query("star_lax", "select distinct l_partkey, l_suppkey, price, n from links join (select l_partkey, l_suppkey, count(*) as m from lineitem where l_returnflag = 'R' group by all) using (l_partkey, l_suppkey) where lower(flags) = 'r'", "links")
def _(t):
    returned = t.lineitem.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("m"))
    plan = StarPlan(parents={"links": None, "returned": "links"}, outputs=("l_partkey", "l_suppkey", "price", "n"), strict=False)
    return star.run({"links": t.links, "returned": returned}, plan, {"flags": ["R"]}).rows.drop("flags")


@query("explosion_estimate", "select (select count(*) from orders) as left_rows, (select count(*) from lineitem) as right_rows, (select count(*) from orders join lineitem on o_orderkey = l_orderkey) as join_rows")
def _(t):
    return star.estimated_rows(t.orders, t.lineitem, [("o_orderkey", "l_orderkey")])


@query("anti", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def _(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("semi_chain", "select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 2)))")
def _(t):
    s = t.supplier.join(t.nation.where("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    l = t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return t.part.join(l, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("m1_join", "select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey")
def _(t):
    return K.many_to_one(t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), t.nation, ["n_nationkey"]).select("c_custkey", "n_name")


@query("score_join", "select p_partkey, p_name, s from part left join (select l_partkey, round(avg(l_discount), 4) as s from lineitem group by 1) on p_partkey = l_partkey")
def _(t):
    scores = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.avg("l_discount"), 4).alias("s"))
    return t.part.join(scores, "p_partkey", "left").select("p_partkey", "p_name", "s")


@query(
    "detect_key",
    """with a as (select '' as gene_id, p_partkey::varchar as drug_id, p_name as drug_name from part), b as (select * from a where drug_id < '5'),
    n as (select 'gene_id' as k, 1 as o, (select count(*) from a where trim(gene_id) <> '') as l, (select count(*) from b where trim(gene_id) <> '') as r union all select 'drug_id', 2, (select count(*) from a where trim(drug_id) <> ''), (select count(*) from b where trim(drug_id) <> '')
      union all select 'drug_name', 3, (select count(*) from a where trim(drug_name) <> ''), (select count(*) from b where trim(drug_name) <> ''))
    select k, case when k like '%_id' then 'id' else 'name' end as confidence from n where l > 0 and r > 0 order by o limit 1""",
)
def _(t):
    a = t.part.select(F.lit("").alias("gene_id"), F.col("p_partkey").cast("string").alias("drug_id"), F.col("p_name").alias("drug_name"))
    k, confidence = K.detect_key(a, a.where("drug_id < '5'"))
    return t.spark.createDataFrame([(k, confidence)], "k string, confidence string")


SIDES = """a as (select p_name as drug_name, max(p_retailprice) as association_score, min(p_type) as note from part where p_size <= 25 group by 1),
b as (select upper(p_name) as drug_name, min(case when p_size > 45 then null else p_retailprice end) as association_score, null as note, max(p_brand) as brand from part where p_size > 20 and p_brand in ('Brand#1', 'Brand#2') group by 1)"""


def sides(t):
    a = t.part.where("p_size <= 25").groupBy(F.col("p_name").alias("drug_name")).agg(F.max("p_retailprice").alias("association_score"), F.min("p_type").alias("note"))
    b = t.part.where("p_size > 20 and p_brand in ('Brand#1', 'Brand#2')").groupBy(F.upper("p_name").alias("drug_name")).agg(F.min(F.when(F.col("p_size") <= 45, F.col("p_retailprice"))).alias("association_score"), F.lit(None).cast("string").alias("note"), F.max("p_brand").alias("brand"))
    return a, b


@query("enrich", f"with {SIDES} select a.drug_name, a.association_score as association_score_left, b.association_score as association_score_right, a.note as note_left, b.note as note_right, brand from a left join b on lower(a.drug_name) = lower(b.drug_name)")
def _(t):
    return K.enrich(*sides(t), "drug_name")


@query("coalesce_suffixes", f"with {SIDES} select a.drug_name, coalesce(a.association_score, b.association_score) as association_score, a.note, brand from a left join b on lower(a.drug_name) = lower(b.drug_name)")
def _(t):
    return K.coalesce_suffixes(K.enrich(*sides(t), "drug_name"))


@query("synonym_canonical", "select synonym, arg_min(name, length(name) || name) as canonical from (select lower(s.synonym) as synonym, p_name as name from syn s join part on id = p_partkey where length(s.synonym) between 4 and 80) group by 1", "syn")
def _(t):
    return K.synonym_canonical(t.syn, t.part.select(F.col("p_partkey").alias("id"), "p_name"), "id", "synonym", "p_name", is_structural(F.col("synonym")))


@query("intersect", f"with {SIDES} select a.drug_name, case when a.association_score is null or b.association_score is null then null else least(a.association_score, b.association_score) end as association_score, a.note, brand from a join b on lower(a.drug_name) = lower(b.drug_name)")
def _(t):
    return K.intersect(*sides(t), "drug_name")


@query("difference", f"with {SIDES} select a.* from a where lower(drug_name) not in (select lower(drug_name) from b)")
def _(t):
    return K.difference(*sides(t), "drug_name")


@query("union_first", f"with {SIDES} select *, null as brand from a union all select * from b where lower(drug_name) not in (select lower(drug_name) from a)")
def _(t):
    return K.union(*sides(t), "drug_name")


@query(
    "union_best",
    f"with {SIDES}, u as (select *, null as brand, 0 as side from a union all select *, 1 from b) select drug_name, association_score, note, brand from (select *, row_number() over (partition by lower(drug_name) order by association_score desc nulls last, side) as rn from u) where rn = 1",
)
def _(t):
    return K.union(*sides(t), "drug_name", best=True)


@query(
    "empty_sides",
    """with a as (select lower(p_name) as k from part), e as (select k from a where k < ''), u as (select count(distinct k) as n from (select k from a union all select k from e))
    select 'intersect' as op, 'left' as "empty", (select count(*) from e join a using (k)) as n union all select 'intersect', 'right', (select count(*) from a join e using (k)) union all select 'intersect', 'both', (select count(*) from e x join e y using (k))
    union all select 'difference', 'left', (select count(*) from e where k not in (select k from a)) union all select 'difference', 'right', (select count(*) from a where k not in (select k from e)) union all select 'difference', 'both', (select count(*) from e)
    union all select 'union', 'left', (select n from u) union all select 'union', 'right', (select n from u) union all select 'union', 'both', (select count(*) from e)""",
)
def _(t):
    """Rows of each set operation where a side, or either, has none."""
    some = t.part.select(F.col("p_name").alias("drug_name"), F.col("p_retailprice").alias("association_score"))
    none = some.where("drug_name < ''")
    cases = {"left": (none, some), "right": (some, none), "both": (none, none)}
    ops = {"intersect": K.intersect, "difference": K.difference, "union": K.union}
    return reduce(DataFrame.union, [f(*given, "drug_name").agg(F.lit(op).alias("op"), F.lit(side).alias("empty"), F.count("*").alias("n")) for op, f in ops.items() for side, given in cases.items()])


@query("set_cap", f"with {SIDES} select *, true as truncated from a order by association_score desc, drug_name limit 20")
def _(t):
    a, _ = sides(t)
    return K.capped(a, 1000, most=20)


@query(
    "combine",
    "with x as (select l_partkey, max(price) as s from links where l_suppkey = 1 group by 1), y as (select l_partkey, max(price) as s from links where l_suppkey = 2 group by 1) select l_partkey, case when x.s is null or y.s is null then null else least(x.s, y.s) end as association_score from x join y using (l_partkey)",
    "links",
)
def _(t):
    e = t.links.groupBy("l_suppkey", "l_partkey").agg(F.max("price").alias("association_score"))
    return K.combine(e, "l_suppkey", "l_partkey", "1", "2", "intersect")


@query("diagonal_union", "select distinct c_name as name, c_mktsegment as seg from customer union select distinct s_name, null from supplier")
def _(t):
    return t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg")).unionByName(t.supplier.select(F.col("s_name").alias("name")), allowMissingColumns=True).distinct()


@query("trusted_union", "select v as value, min(prio)::int as prio from (select p_name as v, 0 as prio from part where p_size = 1 union all select p_name, 1 from part where p_size <= 5 union all select p_name, 2 from part) group by 1")
def _(t):
    of = lambda p: t.part.where(p).select(F.col("p_name").alias("value"))
    return K.by_trust([of("p_size = 1"), of("p_size <= 5"), of("true")], "value")
