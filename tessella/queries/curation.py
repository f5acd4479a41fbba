"""Scans, cleaning, key repair and flattening (group A of the inventory)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.functions.text import number
from tessella.operators.lineage import shared_folder
from tessella.sources import curate as C
from tessella.sources import flatten as X

from .registry import NESTED, query


@query("scan_utf8", "select p_partkey::varchar as p_partkey, p_name, p_brand, p_type, p_size::varchar as p_size, p_retailprice from part")
def _(t):
    return C.scan(t.spark, f"{t.folder}/part.parquet", keep_native=("p_retailprice",))


@query("scan_resolved", "select s_suppkey::varchar as s_suppkey, s_name from supplier")
def _(t):
    return C.scan(t.spark, C.resolve(t.spark, t.folder, ["suppliers", "supplier"])).select("s_suppkey", "s_name")


@query("rename_trim_distinct", "select distinct trim(o_orderstatus) as status, trim(o_orderpriority) as priority from orders")
def _(t):
    padded = t.orders.select(F.concat(F.lit(" "), "o_orderstatus").alias("o_orderstatus"), F.concat("o_orderpriority", F.lit("  ")).alias("o_orderpriority"))
    return C.clean(C.rename(padded, {"o_orderstatus": "st", "absent": "x"}, {"st": "status", "o_orderpriority": "priority"}))


@query("sentinel_null", "select o_orderkey, case when o_orderpriority in ('4-NOT SPECIFIED', '') then null else o_orderpriority end as o_orderpriority from orders")
def _(t):
    return C.null_if(t.orders.select("o_orderkey", "o_orderpriority"), {"o_orderpriority": ["4-NOT SPECIFIED", ""], "absent": ["x"]})


@query("sentinel_drop", "select o_orderkey, p from (select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderpriority end as p from orders) where p not in ('5-LOW', '#N/A') or p is null")
def _(t):
    return C.drop_sentinels(t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("p")), "p", ["5-LOW", "#N/A"])


@query("prefix_strip", r"select p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace('MESH:KEGG:' || p_brand, '^MESH:', ''), '^REACT:', ''), '^KEGG:', ''), '^OMIM:', '') as id from part")
def _(t):
    return t.part.select("p_partkey", C.strip_prefixes(F.concat(F.lit("MESH:KEGG:"), "p_brand")).alias("id"))


@query("lenient_cast", "select p_partkey, try_cast(case when p_size % 3 = 0 then p_size || 'x' else p_size || '.5' end as double) as v from part")
def _(t):
    return t.part.select("p_partkey", number(F.when(F.col("p_size") % 3 == 0, F.concat("p_size", F.lit("x"))).otherwise(F.concat("p_size", F.lit(".5")))).alias("v"))


@query("regex_extract", r"select p_partkey, nullif(regexp_extract(p_brand, '#(1\d)$', 1), '') as code from part")
def _(t):
    return t.part.select("p_partkey", C.extract(F.col("p_brand"), r"#(1\d)$").alias("code"))


@query(
    "unpivot_xref",
    "select distinct p_partkey, case s when 'p_brand' then 'BRAND' else s end as xref_source, v as xref_id from (select p_partkey, 'p_brand' as s, p_brand as v from part union all select p_partkey, 'p_type', p_type from part union all select p_partkey, 'size', case when p_size < 10 then 'NA' else p_size::varchar end from part) where v is not null and v not in ('', 'NA')",
)
def _(t):
    wide = t.part.select("p_partkey", "p_brand", "p_type", F.when(F.col("p_size") < 10, "NA").otherwise(F.col("p_size").cast("string")).alias("size"))
    return C.unpivot_xref(wide, "p_partkey", ["p_brand", "p_type", "size"], {"p_brand": "BRAND"})


@query("synonym_explode", "select p_partkey, trim(s) as synonym from (select p_partkey, unnest(string_split(p_name || ' | ' || p_brand || '|', '|')) as s from part) where trim(s) <> ''")
def _(t):
    return C.synonyms(t.part.select("p_partkey", F.concat("p_name", F.lit(" | "), "p_brand", F.lit("|")).alias("packed")), "p_partkey", "packed")


@query("edge_collapse", "select l_partkey, l_suppkey, array_to_string(list_sort(list(distinct l_returnflag)), '|') as l_returnflag, min(l_linestatus) as l_linestatus, count(*) as n from lineitem group by all")
def _(t):
    return C.collapse_edges(t.lineitem, ["l_partkey", "l_suppkey"], ["l_returnflag"], ["l_linestatus"])


@query(
    "derived_measures",
    "select l_partkey, l_suppkey, case flags when 'R' then 1 when 'A' then 2 when 'N' then 3 else 4 end as flags_rank, len(string_split(flags, '|')) as flags_count, (contains(flags, 'A'))::int as has_a from links",
    "links",
)
def _(t):
    return C.derived_measures(t.links, "flags", ["R", "A", "N"], "flags", "A").select("l_partkey", "l_suppkey", "flags_rank", F.col("flags_count").cast("long").alias("flags_count"), "has_a")


@query("bidirectional_edges", "select a, b, score from pairs union all select b, a, score from pairs", "pairs")
def _(t):
    return C.both_directions(t.pairs, "a", "b")


@query("partner_denorm", "select a, b, score, p_name as partner_p_name, p_size as partner_p_size from pairs left join (select * from part where p_size <= 40) on b = p_partkey", "pairs")
def _(t):
    return C.partner_attributes(t.pairs, t.part.where("p_size <= 40"), partner_fk="b", master_key="p_partkey", attrs=["p_name", "p_size"])


@query("partner_auto", "select a, b, score, p_name as partner_p_name, p_brand as partner_p_brand, p_type as partner_p_type, p_size as partner_p_size, p_retailprice as partner_p_retailprice from pairs left join part on b = p_partkey", "pairs")
def _(t):
    return C.auto_partner_attributes(t.pairs, t.part, master_key="p_partkey", partner_fk="b")


@query("partner_found", "select l.l_partkey, l_suppkey, partner_id, p_name as partner_p_name, p_type as partner_p_type, p_size as partner_p_size, p_retailprice as partner_p_retailprice from (select l_partkey, l_suppkey, l_partkey % 7 + 1 as partner_id, 'x' as p_brand from links) l left join part on partner_id = p_partkey", "links")
def _(t):
    fact = t.links.select("l_partkey", "l_suppkey", (F.col("l_partkey") % 7 + 1).alias("partner_id"), F.lit("x").alias("p_brand"))
    references = [("fact", "l_partkey", "part", "p_partkey"), ("fact", "partner_id", "part", "p_partkey"), ("fact", "l_suppkey", "supplier", "s_suppkey")]
    return C.with_partners({"fact": fact, "part": t.part, "supplier": t.supplier}, references)["fact"].drop("p_brand")


@query("hierarchy_names", "select a as parent, b as child, p.p_name as parent_name, c.p_name as child_name from pairs left join (select * from part where p_size <= 40) p on a = p.p_partkey left join (select * from part where p_size <= 40) c on b = c.p_partkey", "pairs")
def _(t):
    return C.name_both_ends(t.pairs.select(F.col("a").alias("parent"), F.col("b").alias("child")), t.part.where("p_size <= 40"), "parent", "child", "p_partkey", "p_name")


@query("fk_extend", "select p_partkey, p_name from part where p_size <= 40 union all select distinct l_partkey, null from lineitem where l_partkey not in (select p_partkey from part where p_size <= 40)")
def _(t):
    return C.extend_dimension(t.part.where("p_size <= 40").select("p_partkey", "p_name"), t.lineitem, "p_partkey", "l_partkey")


@query(
    "fk_filter",
    "select l_partkey, l_suppkey, l_orderkey from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber, l_extendedprice) as rn from lineitem where l_partkey in (select p_partkey from part where p_size <= 40)) where rn = 1",
)
def _(t):
    kept = C.drop_orphans(t.lineitem, t.part.where("p_size <= 40"), "l_partkey", "p_partkey")
    return C.first_per_key(kept, ["l_partkey", "l_suppkey"], [F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_extendedprice")]).select("l_partkey", "l_suppkey", "l_orderkey")


@query(
    "fk_backfill",
    "select distinct p_name, id from (select p_name, id from (select p_name, min(p_partkey) as id from part group by 1) where id % 2 = 0 union all select m.p_name, m.id from (select p_name, min(p_partkey) as id from part group by 1) m where id % 2 <> 0)",
)
def _(t):
    master = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return C.backfill_links(master.where("id % 2 = 0"), t.part, master, "p_name", "id")


@query("canonical_coalesce", "select c_custkey, coalesce(n_name, 'own') as label from customer left join (select * from nation where n_nationkey < 20) on c_nationkey = n_nationkey")
def _(t):
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.lit("own").alias("label"))
    return C.canonical_or_own(rows, t.nation.where("n_nationkey < 20"), "n_nationkey", "label", "n_name").select("c_custkey", "label")


@query("surrogate_key", "select p_partkey, case when p_size < 5 then null else p_brand || '|' || p_type end as k from part")
def _(t):
    return t.part.withColumn("ty", F.when(F.col("p_size") >= 5, F.col("p_type"))).select("p_partkey", C.composite_key("p_brand", "ty").alias("k"))


@query("supplement", "select n_nationkey, n_name, null as src from nation union all select n_nationkey, null, 'added' from nation where n_nationkey in (1, 3, 5)")
def _(t):
    return C.supplement(t.nation.select("n_nationkey", "n_name"), [1, 3, 5], "n_nationkey", {"src": "added"})


@query("active_keys", "select distinct k from (select l_suppkey as k from lineitem where l_returnflag = 'R' union all select s_suppkey from supplier where s_acctbal > 9000)")
def _(t):
    return C.active_keys([(t.lineitem.where("l_returnflag = 'R'"), "l_suppkey"), (t.supplier.where("s_acctbal > 9000"), "s_suppkey")], "k")


@query("value_pool", "select distinct 'p_brand' as field, p_brand as value from part union select distinct 'p_type', p_type from part union select distinct 'n_name', n_name from nation")
def _(t):
    return C.value_pool({"part": t.part, "nation": t.nation}, ["p_brand", "p_type", "n_name", "smiles"])


@query("page_titles", "select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title from pages where regexp_matches(html, '(?is)<title[^>]*>.*?</title>')")
def _(t):
    out = C.records(t.pages.select("page_id", "html"), "html", "title", {"title": r"(?is)<title[^>]*>(.*?)</title>"})
    return out.select("page_id", F.coalesce("title", F.lit("")).alias("title"))


@query(
    "xml_synonyms",
    """with s as (select p_brand as canonical, lower(unnest([p_type || ' ' || p_brand, p_name])) as synonym from part),
    u as (select synonym, min(canonical) as canonical from s group by 1 having count(distinct canonical) = 1) select synonym, canonical from u where synonym not in (select lower(p_brand) from part)""",
)
def _(t):
    record = F.struct(F.col("p_brand").alias("Name"), F.struct(F.array(F.concat_ws(" ", "p_type", "p_brand"), F.col("p_name")).alias("Synonym")).alias("SynonymList"))
    texts = t.part.select(F.to_xml(record, {"rowTag": "Disorder"}).alias("xml"))
    rows = C.xml_records(texts, "xml", "Name string, SynonymList struct<Synonym:array<string>>")
    return C.synonym_map(rows.select("Name", "SynonymList.Synonym"), "Name", "Synonym")


@query(
    "xml_files",
    """with s as (select trim(p_brand) as canonical, unnest([p_brand, p_type || ' ' || p_brand, p_name]) as alias from part)
    select lower(alias) as alias, array_to_string(list_sort(list(distinct canonical)), '|') as canonicals from s group by 1""",
)
def _(t):
    element = lambda c: F.struct(c.alias("_VALUE"), F.lit("en").alias("_lang"))
    names = F.array(element(F.lit(" ")), element(F.col("p_brand")))
    record = t.part.select(F.col("p_partkey").alias("_id"), names.alias("Name"), F.struct(F.array(element(F.concat_ws(" ", "p_type", "p_brand")), element(F.col("p_name"))).alias("Synonym")).alias("SynonymList"))
    path = f"{shared_folder(t.spark)}/xml-{uuid.uuid4().hex}"
    record.write.format("xml").option("rootTag", "DisorderList").option("rowTag", "Disorder").save(path)
    text = "array<struct<_VALUE:string,_lang:string>>"
    rows = C.xml_rows(t.spark, path, "Disorder", f"Name {text}, SynonymList struct<Synonym:{text}>")
    lists = C.alias_lists(rows, F.col("Name._VALUE"), F.col("SynonymList.Synonym._VALUE"))
    return lists.select("alias", F.array_join("canonicals", "|").alias("canonicals"))


def _items(t):
    return X.parsed(t.nested, "doc", NESTED).select("l_orderkey", "r.items")


@query(
    "json_flatten_first",
    "select l_orderkey, part, targets[1].id as first_value, array_to_string(list_sort(list_distinct([x.status for x in targets])), '; ') as statuses from items union all select distinct l_orderkey, null::bigint, null, null from lineitem where l_orderkey % 7 = 0",
    "items",
)
def _(t):
    return X.rows_with_first(_items(t), "items", "targets", "id", "status").select("l_orderkey", "item.part", "first_value", "statuses")


@query("json_flatten_pairs", "select l_orderkey, part, unnest(list_distinct([x.id for x in targets])) as target from items union all select distinct l_orderkey, null, null from lineitem where l_orderkey % 7 = 0", "items")
def _(t):
    return X.item_pairs(_items(t), "items", "targets").select("l_orderkey", "item.part", F.col("sub.id").alias("target")).distinct()


@query("json_flatten_fallback", "select l_orderkey, part, coalesce(case when part % 2 = 0 then targets[1].id end, targets[1].status, 'none') as name from items", "items")
def _(t):
    rows = _items(t).select("l_orderkey", F.explode("items").alias("i"))
    even = F.when(F.col("i.part") % 2 == 0, X.first_of(F.col("i.targets"), "id"))
    return rows.select("l_orderkey", "i.part", X.first_name(even, F.lit(" "), X.first_of(F.col("i.targets"), "status"), F.lit("none")).alias("name"))


@query("json_flatten_anchor", "select l_orderkey, array_to_string(list_sort(list(part::varchar)), ', ') as parts from items where list_contains([x.id for x in targets], (l_orderkey % 100)::varchar) group by 1", "items")
def _(t):
    held = X.holding(F.col("items"), "targets", "id", (F.col("l_orderkey") % 100).cast("string"))
    rows = _items(t).withColumn("held", held).where("size(held) > 0")
    return rows.select("l_orderkey", F.array_join(F.array_sort(F.transform("held", lambda x: x.part.cast("string"))), ", ").alias("parts"))


@query(
    "json_score_columns",
    "select l_orderkey, " + ", ".join(f"max(case when part % 3 = {k} then score else 0.0 end) as score_{k}" for k in range(3)) + " from (select l_orderkey, part, score from items union all select distinct l_orderkey, 0, 0.0 from lineitem where l_orderkey % 7 = 0) group by 1",
    "items",
)
def _(t):
    scores = F.transform("items", lambda x: F.struct((x.part % 3).alias("id"), x.score.alias("score")))
    return X.score_columns(_items(t).select("l_orderkey", scores.alias("s")), "s", ["0", "1", "2"]).drop("s")


@query("json_expression", "select l_orderkey, coalesce(case when part % 2 = 0 then 'part ' || part end, 'text') as name, score as value from items", "items")
def _(t):
    items = F.transform("items", lambda x: F.struct(F.when(x.part % 2 == 0, F.concat(F.lit("part "), x.part.cast("string"))).alias("label"), F.lit("text").alias("text"), x.score.alias("score")))
    return X.expression_rows(_items(t).select("l_orderkey", items.alias("i")), "i").select("l_orderkey", "name", "value")


@query("json_evidence", "select l_orderkey, array_to_string(list_sort(list(part))[1:5], ', ') as ids, count(*) as total from items group by 1", "items")
def _(t):
    ids = F.transform("items", lambda x: x.part.cast("string"))
    first, n = X.literature(ids)
    return _items(t).where("size(items) > 0").select("l_orderkey", first.alias("ids"), n.cast("long").alias("total"))


@query("json_annotations", "select l_orderkey, coalesce(array_to_string(list_sort(list_distinct(list(part % 50) filter (where part % 2 = 0)))[1:4], ','), '') as even, min(part) filter (where score >= 25) as preferred from items group by 1", "items")
def _(t):
    terms = F.transform("items", lambda x: F.struct((x.part % 50).alias("id"), F.when(x.part % 2 == 0, "even").otherwise("odd").alias("aspect")))
    ids = F.transform("items", lambda x: F.struct(x.part.alias("id"), F.when(x.score >= 25, "strong").otherwise("weak").alias("source")))
    even = F.slice(X.by_aspect(terms, "even"), 1, 4)
    return _items(t).where("size(items) > 0").select("l_orderkey", F.array_join(even.cast("array<string>"), ",").alias("even"), X.preferred_id(ids, ["strong"]).alias("preferred"))


@query("record_rows", "select l_orderkey, min(part) as part, (part % 10) as grp from items group by l_orderkey, part % 10", "items")
def _(t):
    rows = _items(t).select("l_orderkey", F.explode("items").alias("i")).select("l_orderkey", "i.part", (F.col("i.part") % 10).alias("grp"))
    return C.first_per_key(rows, ["l_orderkey", "grp"], [F.asc("part")])


@query("conform_columns", "select null as gene_id, p_name as gene_name, p_partkey::varchar as drug_id, null as drug_name from part")
def _(t):
    return C.conform(t.part.select(F.col("p_name").alias("gene_symbol"), F.col("p_partkey").cast("string").alias("drug_id")), ["gene_id", "gene_name", "drug_id", "drug_name"], {"gene_symbol": "gene_name"})


@query("csv_round_trip", "select s_suppkey::varchar as key, s_name as gene_name from supplier")
def _(t):
    path = f"{shared_folder(t.spark)}/csv-{uuid.uuid4().hex}"
    C.write_csv(t.supplier.select(F.col("s_suppkey").alias("KEY"), F.col("s_name").alias("Gene Symbol")), path, ["KEY"])
    return C.read_csv(t.spark, path)


@query("tag_note", "select l_partkey, n, 'several suppliers' as note from (select l_partkey, count(*) as n from links group by 1 having count(*) > 1)", "links")
def _(t):
    many = t.links.groupBy("l_partkey").agg(F.count("*").alias("n")).where("n > 1")
    return C.tag_when(many, {"l_partkey", "n"}, "note", "several suppliers")


@query("full_names", "select c_custkey, n, n_name as n_full_name from (select c_custkey, 'N' || c_nationkey as n from customer) left join (select 'N' || n_nationkey as s, n_name from nation where n_nationkey < 20) on n = s")
def _(t):
    lookup = t.nation.where("n_nationkey < 20").select(F.concat(F.lit("N"), "n_nationkey").alias("s"), "n_name")
    return C.full_names(t.customer.select("c_custkey", F.concat(F.lit("N"), "c_nationkey").alias("n")), lookup, "s", "n_name", ["n"])
