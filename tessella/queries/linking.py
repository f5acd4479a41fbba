"""Graphs, hierarchies and data quality (groups J and K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.operators import quality as Q

from .registry import query

@query(
    "bfs",
    """with e as (select parent_id as a, child_id as b, left(parent_id, 1) as kind from hier union all select child_id, parent_id, left(parent_id, 1) from hier),
    h1 as (select s.root, e.b as node, min(kind) as kind from (select distinct parent_id as root from hier) s join e on e.a = s.root group by all),
    h2 as (select h1.root, e.b as node, min(e.kind) as kind from h1 join e on e.a = h1.node left join h1 seen on seen.root = h1.root and seen.node = e.b where e.b <> h1.root and seen.node is null group by all)
    select root, node, 1 as hop, kind from h1 union all select root, node, 2, kind from h2""",
    "hier",
)
def _(t):
    edges = t.hier.select(F.col("parent_id").alias("a"), F.col("child_id").alias("b"), F.substring("parent_id", 1, 1).alias("kind"))
    return G.neighbours(edges, edges.select(F.col("a").alias("root")).distinct(), 2)


@query("typed_edges", "with r as (select 'n' || n_nationkey as node, 'nation' as tab, n_regionkey as k from nation union all select 'r' || r_regionkey, 'region', r_regionkey from region) select distinct x.node as a, y.node as b, x.k as kind from r x join r y on x.k = y.k and x.tab <> y.tab and x.node < y.node")
def _(t):
    rows = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit("nation").alias("tab"), F.col("n_regionkey").alias("k"))
    rows = rows.union(t.region.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("region"), F.col("r_regionkey")))
    return G.typed_edges(rows, "k", "tab", "node")


KEYED = """r as (select 's' || s_suppkey as node, 'supplier' as tab, s_nationkey as k from supplier union all select 'c' || c_custkey, 'customer', c_nationkey from customer union all select 'n' || n_nationkey, 'nation', n_nationkey from nation union all select 'n' || n_nationkey, 'nation', 100 + n_regionkey from nation union all select 'r' || r_regionkey, 'region', 100 + r_regionkey from region)"""


def keyed(t):
    """Records of five kinds by the key of their nation or region; a nation has both."""
    row = lambda df, mark, n, tab, k: df.select(F.concat(F.lit(mark), n).alias("node"), F.lit(tab).alias("tab"), F.col(k).alias("k"))
    region = lambda df, k: df.withColumn(k, F.col(k) + 100)
    rows = row(t.supplier, "s", "s_suppkey", "supplier", "s_nationkey").union(row(t.customer, "c", "c_custkey", "customer", "c_nationkey")).union(row(t.nation, "n", "n_nationkey", "nation", "n_nationkey"))
    rows = rows.union(row(region(t.nation, "n_regionkey"), "n", "n_nationkey", "nation", "n_regionkey"))
    return rows.union(t.region.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("region"), F.col("r_regionkey") + 100))


@query("typed_hubs", f"with {KEYED} select distinct k as hub, tab, node from r")
def _(t):
    return G.typed_hubs(keyed(t), "k", "tab", "node")


@query(
    "hub_bfs",
    f"""with {KEYED}, e as (select distinct x.node as a, y.node as b, x.k as kind from r x join r y on x.k = y.k and x.tab <> y.tab),
    h1 as (select 's1' as root, b as node, 1 as hop, min(kind) as kind from e where a = 's1' group by b),
    h2 as (select root, e.b as node, 2 as hop, min(e.kind) as kind from h1 join e on e.a = h1.node where e.b <> 's1' and e.b not in (select node from h1) group by all)
    select * from h1 union all select * from h2""",
)
def _(t):
    start = t.supplier.where("s_suppkey = 1").select(F.concat(F.lit("s"), "s_suppkey").alias("root"))
    return G.hub_neighbours(G.typed_hubs(keyed(t), "k", "tab", "node"), start, 2)


@query(
    "closure",
    """with recursive c as (select r_id as root, r_id as node, 0 as depth from (select 'r' || r_regionkey as r_id from region) union all select c.root, h.child_id, c.depth + 1 from c join hier h on h.parent_id = c.node)
    select root, node, depth from c""",
    "hier",
)
def _(t):
    edges = t.hier.select(F.col("parent_id").alias("parent"), F.col("child_id").alias("child"))
    return G.descendants(edges, t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("root")))


@query("closure_synonyms", "select distinct 'r' || n_regionkey as root, c_mktsegment as synonym from customer join nation on c_nationkey = n_nationkey")
def _(t):
    edges = t.hier.select(F.col("parent_id").alias("parent"), F.col("child_id").alias("child"))
    below = G.descendants(edges, t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("root")))
    syn = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("synonym"))
    return below.join(syn, "node").select("root", "synonym").distinct()


@query("children", "select distinct child_id, child_name from hier where lower(parent_name) in ('asia', 'nation_3')", "hier")
def _(t):
    return G.children(t.hier, ["ASIA", "NATION_3"])


@query("parents", "select distinct parent_id, parent_name from hier where lower(child_name) = 'nation_3'", "hier")
def _(t):
    return G.children(t.hier, ["nation_3"], end="child")


@query("expand", "with top as (select s_suppkey from supplier order by s_acctbal desc, s_suppkey limit 5) select l_suppkey, l_partkey, price from links where l_suppkey in (select s_suppkey from top) order by price desc, l_partkey, l_suppkey limit 40", "links")
def _(t):
    source = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    edges = t.links.select("l_partkey", "l_suppkey", "price")
    return G.expand(source, edges, "l_suppkey", "l_suppkey", source_score="s_acctbal", edge_score="price", top_k=5, most=40)


@query(
    "traverse_typed",
    """with h1 as (select l_partkey, max(price) as price from links where l_suppkey = 3 group by 1), top as (select l_partkey from h1 order by price desc, l_partkey::varchar limit 5),
    h2 as (select case when l_suppkey % 2 = 0 then l_suppkey end as l_suppkey, case when l_suppkey % 3 = 0 then 'S' || l_suppkey end as name, price from links where l_partkey in (select l_partkey from top))
    select l_suppkey, case when l_suppkey is null then name end as name, max(price) as price from h2 where l_suppkey is not null or name is not null group by all""",
    "links",
)
def _(t):
    edges = t.links.select("l_partkey", "l_suppkey", "price")
    odd = F.col("l_suppkey") % 2 == 1
    named = edges.withColumn("name", F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("S"), "l_suppkey"))).withColumn("l_suppkey", F.when(~odd, F.col("l_suppkey")))
    registry = G.Edges({("supplier", "part"): (edges, "l_suppkey", "l_partkey"), ("part", "vendor"): (named, "l_partkey", "l_suppkey")})
    start = edges.where("l_suppkey = 3").groupBy("l_partkey").agg(F.max("price").alias("price"))
    out = G.traverse(start, registry.path("part", "vendor"), score="price", top_k=5, name="name")
    return out.select("l_suppkey", F.when(F.col("l_suppkey").isNull(), F.col("name")).alias("name"), "price")


@query(
    "traverse",
    """with h1 as (select l_partkey, max(price) as s from links where l_suppkey = 3 group by 1), top as (select l_partkey from h1 order by s desc, l_partkey::varchar limit 5)
    select l_suppkey, max(price) as price from links where l_partkey in (select l_partkey from top) group by 1""",
    "links",
)
def _(t):
    edges = t.links.select("l_partkey", "l_suppkey", "price")
    start = edges.where("l_suppkey = 3")
    best = start.groupBy("l_partkey").agg(F.max("price").alias("price"))
    out = G.traverse(best, [(edges, "l_partkey", "l_suppkey")], score="price", top_k=5)
    return out.select("l_suppkey", "price")


@query("evidence_page", "select l_orderkey, l_linenumber, l_extendedprice, count(*) over () as total from lineitem where l_partkey = 10 and l_returnflag = 'A' order by l_extendedprice, l_linenumber, l_orderkey limit 25")
def _(t):
    rows = t.lineitem.select("l_extendedprice", "l_linenumber", "l_orderkey", "l_partkey", "l_returnflag")
    return G.evidence(rows, ("l_partkey", 10), ("l_returnflag", "A")).select("l_orderkey", "l_linenumber", "l_extendedprice", "total")


KEYS = [("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("documents", "doc_id", "labels", "doc_id")]


def _tables(t):
    return {"lineitem": t.lineitem, "part": t.part.where("p_size <= 40"), "supplier": t.supplier, "documents": t.documents, "labels": t.labels, "orders": t.orders}


def _orphans_sql(fact, fk, master, key):
    m = f"(select {key} from {master}{' where p_size <= 40' if master == 'part' else ''})"
    return f"select '{fact}' as fact, '{fk}' as fk, count(*) as rows, count(*) filter (where {fk} not in {m}) as orphan_rows, count(distinct {fk}) filter (where {fk} not in {m}) as orphan_keys from {fact}"


@query("orphans", " union all ".join(_orphans_sql(*k) for k in KEYS))
def _(t):
    return Q.orphans(_tables(t), KEYS)


@query(
    "key_audit",
    """select 'orders' as "table", count(*) as rows, 0 as null_keys, count(distinct o_orderkey) as distinct_keys, 0 as repeated_keys from orders
    union all select 'lineitem', (select count(*) from lineitem), 0, count(*), count(*) filter (where n > 1) from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)""",
)
def _(t):
    return Q.key_audit(_tables(t), {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]})


@query("unreferenced", "select 'orders' as master, 'lineitem' as fact, count(*) as unreferenced from orders where o_orderkey not in (select l_orderkey from lineitem) union all select 'supplier', 'lineitem', count(*) from supplier where s_suppkey not in (select l_suppkey from lineitem)")
def _(t):
    return Q.unreferenced(_tables(t), [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")])
