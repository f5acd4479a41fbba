"""Predicates and projections (group B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import predicates as P
from tessella.operators import inject as J
from tessella.operators import resolve as R
from tessella.operators import summary as S
from tessella.operators.graph import children
from tessella.plans import spec
from tessella.plans.star import declared

from .registry import query

L = r"\p{L}\p{N}_"


@query("ci_in_filter", "select p_partkey from part where lower(p_brand) in ('brand#1', 'brand#2') and lower(p_type) in ('economy')")
def _(t):
    return P.filter_table(t.part, {"p_brand": ["BRAND#1", "brand#2"], "p_type": ["Economy"], "absent": ["x"], "p_size": ["3"]}).select("p_partkey")


@query("or_group", "select p_partkey from part where (lower(p_brand) = 'brand#1' or lower(p_type) = 'small') and lower(p_name) = 'red widget'")
def _(t):
    return P.filter_table(t.part, {"p_brand": ["Brand#1"], "p_type": ["SMALL"], "p_name": ["Red Widget"]}, any_of=("p_brand", "p_type")).select("p_partkey")


@query("wholeword", rf"select doc_id from documents where regexp_matches(lower(text), '(^|[^{L}])(idiot|idiots|licenses|license|der|ders)($|[^{L}])')")
def _(t):
    return t.documents.where(P.whole_word("text", ["idiot", "licenses", "der"])).select("doc_id")


@query("prefix_literal", "select p_partkey from part where contains(lower(p_name), 'red w') or contains(lower(p_name), 'ue bo')")
def _(t):
    return t.part.where(P.holds_text("p_name", ["Red w", "ue BO"])).select("p_partkey")


@query("component_match", r"select l_partkey, l_suppkey from links where list_contains(regexp_split_to_array(replace(lower(flags), '|', ' / '), '\s*[/;,]\s*'), 'a')", "links")
def _(t):
    return t.links.withColumn("flags", F.replace("flags", F.lit("|"), F.lit(" / "))).where(P.component("flags", ["A"])).select("l_partkey", "l_suppkey")


@query(
    "notation",
    r"""select p_partkey from (select p_partkey, case p_partkey % 5 when 0 then 'x (p.val' || p_size || 'glu)' when 1 then 'p.Val' || p_size || 'GlufsTer12' when 2 then 'c.5g, p.Val' || p_size || 'Lys' when 3 then 'RS12' || p_size || ' x' else 'V' || p_size || 'E here' end as v from part)
    where regexp_matches(lower(v), '\bval10glu\b|\bval1[a-z]{3}\b') or regexp_matches(lower(v), '(^|[^a-z0-9_])(v10e|p\.v1|rs123)s?($|[^a-z0-9_])')""",
)
def _(t):
    kinds = [F.concat(F.lit("x (p.val"), "p_size", F.lit("glu)")), F.concat(F.lit("p.Val"), "p_size", F.lit("GlufsTer12")), F.concat(F.lit("c.5g, p.Val"), "p_size", F.lit("Lys")), F.concat(F.lit("RS12"), "p_size", F.lit(" x")), F.concat(F.lit("V"), "p_size", F.lit("E here"))]
    v = F.element_at(F.array(*kinds), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.withColumn("v", v).where(P.notation("v", ["V10E", "p.V1", "rs123"])).select("p_partkey")


@query("threshold", "select p_partkey from part where p_size <= 10 and p_retailprice > 950")
def _(t):
    filters = {"p_size": ["x", "10"], "p_retailprice": [950], "op": [">"]}
    return P.filter_table(t.part, filters, kinds={"p_size": "number", "p_retailprice": "number"}, operators={"p_retailprice": "op"}).select("p_partkey")


@query("project_declared", "select p_name, p_partkey from part")
def _(t):
    return declared(t.part, ("p_name", "absent", "p_partkey"))


@query(
    "funnel",
    """select 1 as step, 'p_brand' as "column", count(*) as rows_before, count(*) filter (where p_brand = 'Brand#1') as rows_after, round(100.0 * (count(*) - count(*) filter (where p_brand = 'Brand#1')) / count(*), 4) as reduction_pct from part
    union all select 2, 'p_size', count(*), count(*) filter (where p_size <= 10), round(100.0 * (count(*) - count(*) filter (where p_size <= 10)) / count(*), 4) from part where p_brand = 'Brand#1'""",
)
def _(t):
    return P.funnel(t.part, {"p_brand": ["brand#1"], "p_size": [10]}, kinds={"p_size": "number"})


@query("null_tolerant", "select o_orderkey, p from (select o_orderkey, case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then '' else o_orderpriority end as p from orders) where lower(p) in ('1-urgent') or p is null or p = ''")
def _(t):
    p = F.when(F.col("o_orderkey") % 5 == 1, "").when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", p.alias("p")).where(P.null_tolerant("p", ["1-Urgent"]))


@query("score_floor", "select l_partkey, l_suppkey, n from links where n >= 3 or not exists (select 1 from links where n >= 3)", "links")
def _(t):
    return P.keep_if_any(t.links, F.col("n") >= 3).select("l_partkey", "l_suppkey", "n")


@query("drop_null_rows", "select o_orderkey, p, x_xref from (select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderpriority end as p, null::varchar as x_xref from orders) where p is not null")
def _(t):
    return S.drop_null_rows(t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("p"), F.lit(None).cast("string").alias("x_xref")))


@query("drop_empty", "select o_orderkey, p from (select case when o_orderkey % 3 = 0 then null else o_orderkey end as o_orderkey, case when o_orderkey % 3 = 0 then '' else o_orderpriority end as p from orders) where o_orderkey is not null")
def _(t):
    third = F.col("o_orderkey") % 3 == 0
    return S.drop_empty(t.orders.select(F.when(~third, F.col("o_orderkey")).alias("o_orderkey"), F.when(third, "").otherwise(F.col("o_orderpriority")).alias("p"), F.lit(" ").alias("blank")))


@query("fill_cleanup", "select p_partkey, case when p_size < 10 then '' else p_type end as t, case when p_size < 10 then 0.0 else p_retailprice end as price from part")
def _(t):
    small = F.col("p_size") < 10
    rows = t.part.select("p_partkey", F.when(~small, F.concat(F.lit(" "), "p_type")).alias("t"), F.when(~small, F.col("p_retailprice")).alias("price"))
    return S.fill(rows)


@query("active_prune", "select s_suppkey from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity >= 50 and l_discount >= 0.1)")
def _(t):
    active = t.lineitem.where("l_quantity >= 50 and l_discount >= 0.1").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("active", F.lit(True))
    return P.keep_if_any(t.supplier.join(active, "s_suppkey", "left"), F.col("active")).select("s_suppkey")


@query(
    "relax_terms",
    """with c as (select unnest(['pediatric shiny red widget', 'shiny red widget', 'red widget', 'widget']) as cand, unnest([0, 1, 2, 3]) as k),
    n as (select cand, k, count(p_partkey) as n from c left join part on contains(' ' || lower(p_name) || ' ', ' ' || cand || ' ') group by all)
    select cand as term, n from n where n > 0 and n <= 0.02 * (select count(*) from part) order by k limit 1""",
)
def _(t):
    return P.relaxed("Pediatric shiny red widget", t.part, "p_name")


@query("vocab_norm", "select distinct v from (select lower(replace(unnest(string_split(p_type, ',')), '_', ' ')) as v from part) where contains(v, 'econom') or contains('small parts', v) or contains('small part', v)")
def _(t):
    return P.in_vocabulary(P.vocabulary(t.part, "p_type"), ["Econom", "small parts"])


@query("inject_filter", "select p_partkey from part where lower(p_brand) = 'brand#3' and lower(p_type) = 'economy'")
def _(t):
    intents = {"cheap": "economy", "tiny": "small"}
    filters = P.injected({"p_brand": ["Brand#3"]}, "p_type", intents["cheap"], entities=("p_brand",), tables={"part"}, table="part")
    return P.filter_table(t.part, filters).select("p_partkey")


@query("two_hop_filter", "select c_custkey from customer where 'n' || c_nationkey in (select child_id from hier where lower(parent_name) = 'asia')", "hier")
def _(t):
    below = children(t.hier, ["Asia"]).select(F.col("child_id").alias("k"))
    return t.customer.withColumn("k", F.concat(F.lit("n"), "c_nationkey")).join(below, "k", "left_semi").select("c_custkey")


def flagged(t):
    """links with a map of maps: its flags in one group, the size of its price in another."""
    flags = F.map_from_entries(F.transform(F.split("flags", r"\|"), lambda x: F.struct(x, F.lit(True))))
    return t.links.withColumn("m", F.create_map(F.lit("FL"), flags, F.lit("PR"), F.create_map(F.lit("dear"), F.col("price") > 50_000, F.lit("cheap"), F.col("price") < 2_000)))


@query("map_bucket", "select l_partkey, l_suppkey, array_to_string(list_transform(list_sort(string_split(flags, '|')), lambda x: 'FL:' || x) || case when price > 50000 then ['PR:dear'] when price < 2000 then ['PR:cheap'] else []::varchar[] end, '; ') as buckets from links", "links")
def _(t):
    return P.with_buckets(flagged(t), "m").select("l_partkey", "l_suppkey", "buckets")


@query("map_bucket_any", "select l_partkey, l_suppkey, array_to_string(list_transform(list_filter(list_sort(string_split(flags, '|')), lambda x: x in ('A', 'N')), lambda x: 'FL:' || x), '; ') as buckets from links where contains(flags, 'A') or contains(flags, 'N')", "links")
def _(t):
    return P.with_buckets(flagged(t), "m", ["a", "N"], modality="fl").select("l_partkey", "l_suppkey", "buckets")


@query("map_bucket_none", "select l_partkey, l_suppkey, '' as buckets from links where price between 2000 and 50000", "links")
def _(t):
    return P.with_buckets(flagged(t), "m", modality="PR", negated=True).select("l_partkey", "l_suppkey", "buckets")


@query("edge_cross", "select a, b, score from pairs where a in (select p_partkey from part where p_brand = 'Brand#1') and b in (select p_partkey from part where p_brand = 'Brand#1')", "pairs")
def _(t):
    return P.between(t.pairs, "a", "b", t.part.where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("key")))


@query("edge_anchor", "select a, b, score from pairs where a = 7 or b = 7", "pairs")
def _(t):
    return P.between(t.pairs, "a", "b", t.part.where("p_partkey = 7").select(F.col("p_partkey").alias("key")), known=1)


@query("prune_columns", "select p_partkey, p_name, p_size from part")
def _(t):
    owners = {"disease_note": "disease", "p_size": "drug", "p_brand": "gene", "p_type": "gene", "p_retailprice": "disease"}
    return P.pruned(t.part.withColumn("disease_note", F.col("p_type")), owners, {"drug"})


@query("literal_floor", "select p_partkey from part where lower(p_name) = 'red widget'")
def _(t):
    return P.filter_table(t.part, spec.literal_floor({"p_name": []}, {"p_name": [" Red Widget "], "p_brand": "requested"})).select("p_partkey")


@query("prefix_inject", "select n_name from nation where starts_with(lower(n_name), 'nation_1')")
def _(t):
    prefix = P.prefix_in("Sets of the first nations, first and second", [("first nations", "NATION_1"), ("second", "NATION_2"), ("nations", "NATION_")])
    return t.nation.where(P.starts_with_any("n_name", [prefix])).select("n_name")


@query(
    "token_inject",
    """with tok as (select token from (select distinct p_partkey, unnest(string_split(upper(p_type || '_' || replace(p_name, ' ', '_')), '_')[2:]) as token from part) where length(token) >= 4 and regexp_matches(token, '^[A-Z]+$') and token <> 'RING' group by 1 having count(*) between 10 and 100000),
    q as (select p_partkey as id, p_size % 4 as k, p_brand, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part),
    f as (select *, list_filter([case b when 'rod' then 'BAR' when 'bolt' then 'FASTENER' end, case b when 'rod' then 'POLE' end, (select token from tok where token = upper(a)), (select token from tok where token = upper(b))], lambda x: x is not null) as found from q)
    select id, case when b = 'gear' then (case when a in ('old', 'cold') then 'OG_' else 'GEAR_' end) when k <> 2 and len(found) > 0 then array_to_string(found, ',') when k = 3 then 'requested' end as name,
      case k when 2 then p_brand when 3 then '' end as brand, case when id % 2 = 0 then 'Homo sapiens' end as organism from f""",
)
def _(t):
    """A prefix, else tokens of the names' vocabulary where a question has no filter at all, and the organism of what is shared."""
    who = F.when(F.col("p_partkey") % 2 == 0, "human").otherwise("yeast")
    k, one = F.col("p_size") % 4, lambda c, v: F.create_map(F.lit(c), F.array(v))
    filters = F.when(k == 1, one("name", F.lit("%"))).when(k == 2, one("brand", F.col("p_brand"))).when(k == 3, F.map_concat(one("name", F.lit("requested")), one("brand", F.lit(""))))
    text = F.concat(F.lit("Which "), "p_name", F.lit(" sets are shared between "), who, F.lit(" cells?"))
    asked = t.part.select(F.col("p_partkey").alias("id"), text.alias("text"), filters.alias("filters"))
    names = t.part.select(F.concat_ws("_", "p_type", F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"))
    tokens = S.token_frequency(names, "name", least_length=4, band=(10, 100_000), stop=("RING",))
    aliases = t.spark.createDataFrame([("rod", "POLE"), ("rod", "BAR"), ("bolt", "FASTENER")], "word string, token string")
    asked = J.with_tokens(J.with_prefix(asked, "name", [("old gear", "OG_"), ("gear", "GEAR_")]), "name", aliases, tokens)
    asked = J.with_organism(asked, ["organism"], r"(?i)\b(shared between|in both)\b", [(r"(?i)\bhuman\b", "Homo sapiens"), (r"(?i)\bmouse\b", "Mus musculus")])
    return asked.select("id", *[F.array_join(J.value_of(c), ",").alias(c) for c in ("name", "brand", "organism")])


@query("phrase_rewrite", "select p_partkey, case when contains(p_name, 'crimson') then p_name else replace(p_name, 'red', 'crimson') end as name from part")
def _(t):
    return t.part.select("p_partkey", R.rewrite_phrases(F.col("p_name"), [("RED", "crimson")]).alias("name"))
