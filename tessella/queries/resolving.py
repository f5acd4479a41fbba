"""Text functions and entity resolution (groups G and H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import resolve as R

from .registry import query


@query("normal_forms", r"select p_partkey, trim(regexp_replace(lower('  ' || p_brand || '   ' || p_name), '\s+', ' ', 'g')) as tidy, lower(p_name || ' x-y smith') as safe from part")
def _(t):
    return t.part.select("p_partkey", X.tidy(F.concat(F.lit("  "), "p_brand", F.lit("   "), "p_name")).alias("tidy"), X.safe_normalise(F.concat("p_name", F.lit(" x–y Smith’s "))).alias("safe"))


@query("match_key", "select p_partkey, array_to_string(list_sort(string_split(lower(p_name || ' ' || p_type), ' ')), ' ') as k from part")
def _(t):
    return t.part.select("p_partkey", X.match_key(F.concat("p_type", F.lit(", "), F.upper("p_name"))).alias("k"))


@query("greek", "select p_partkey, p_name || '-alpha beta' as v from part")
def _(t):
    return t.part.select("p_partkey", X.spell_greek(F.concat("p_name", F.lit("-α β"))).alias("v"))


@query("salt", "select p_partkey, case when p_size % 3 = 0 then p_name end as base from part")
def _(t):
    return t.part.select("p_partkey", X.without_salt(F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" HCl"))).otherwise(F.col("p_name"))).alias("base"))


@query("plural", "select p_partkey, case when p_size % 2 <> 0 then p_name || 's' when not regexp_matches(p_name, '[suio]$') then p_name end as v from part")
def _(t):
    return t.part.select("p_partkey", X.plural_variant(F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_name"))).alias("v"))


@query("roman", "select p_partkey, p_name || ' type ' || (p_partkey % 9 + 1) || ' b' as v from part")
def _(t):
    numerals = F.array(*[F.lit(r) for r in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")])
    return t.part.select("p_partkey", X.roman_types(F.concat("p_name", F.lit(" type "), F.element_at(numerals, (F.col("p_partkey") % 9 + 1).cast("int")), F.lit(" b"))).alias("v"))


@query("indel", "select p_partkey, 'c.' || p_size || 'dup' as v from part")
def _(t):
    return t.part.select("p_partkey", X.without_bases(F.concat(F.lit("c."), "p_size", F.lit("dupCA"))).alias("v"))


@query("shorthand", "select p_partkey, case when p_partkey % 3 = 0 then 'val' || p_size || 'glu' when p_partkey % 3 = 1 then 'cys' || p_size || '[a-z]{3}' end as pattern from part")
def _(t):
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("V"), "p_size", F.lit("E"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("p.C"), "p_size")).otherwise("rs12")
    return t.part.select("p_partkey", X.shorthand_pattern(v).alias("pattern"))


@query("acronym", "select p_partkey, substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1) as v from part")
def _(t):
    return t.part.select("p_partkey", X.acronym(F.concat("p_name", F.lit(" 2"))).alias("v"))


@query("camel", "select distinct p_type, 'Re Curated ' || p_type as v from part")
def _(t):
    return t.part.select("p_type", X.camel_words(F.concat(F.lit("ReCurated"), "p_type")).alias("v")).distinct()


@query("structural", "select p_partkey, p_size % 2 = 0 as v from part")
def _(t):
    v = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("InChI=1S/"), "p_name")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.is_structural(v).alias("v"))


@query("row_text", "select p_partkey, 'p_name: ' || p_name || ' | p_size: ' || p_size as v from part")
def _(t):
    return t.part.withColumn("p_none", F.lit(None).cast("string")).select("p_partkey", X.row_text("p_name", "p_none", "p_size", "p_brand", most=2).alias("v"))


@query("json_field", "select event_id, json_extract_string(props, '$.k') as k from events where json_extract_string(props, '$.k')::int > 50")
def _(t):
    k = F.get_json_object("props", "$.k")
    return t.events.where(k.cast("int") > 50).select("event_id", k.alias("k"))


@query("vector_functions", "select vec_id, round(list_inner_product(embedding::double[], embedding::double[]), 4) as dot, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 4) as norm, round(list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]), 5) as cos from embeddings")
def _(t):
    v = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(X.dot(v, v), 4).alias("dot"), F.round(X.norm(v), 4).alias("norm"), F.round(X.cosine(v, F.reverse(v)), 5).alias("cos"))


def pool(t):
    return t.part.select(F.lit("part").alias("field"), F.col("p_name").alias("value")).distinct()


@query("exact_first", "select distinct p_size as query, 'part' as field, p_name as value from part where p_size % 2 = 0")
def _(t):
    terms = t.part.select(F.col("p_size").alias("query"), F.lit("part").alias("field"), F.upper("p_name").alias("term"))
    extra = t.part.where("p_size % 2 = 1").select("p_size", F.lit("part"), F.lit("no such part"))
    return R.exact_first(terms.union(extra), pool(t))


@query("db_overlap", "select distinct p_size as query, p_name as value from part where p_name <> 'red widget' and p_size <= 20")
def _(t):
    swapped = F.concat_ws(", ", F.split("p_name", " ")[1], F.split("p_name", " ")[0])
    cands = t.part.where("p_size <= 20").select(F.col("p_size").alias("query"), F.upper(swapped).alias("term"))
    protected = t.part.where("p_name = 'red widget'").select(F.col("p_name").alias("name"))
    return R.overlap(cands, pool(t), protected)


@query("expansion_policy", "select distinct p_size as query, case when p_size % 2 = 0 then p_name else p_name || ' zz' end as value from part where p_size <= 20")
def _(t):
    even = F.col("p_size") % 2 == 0
    terms = t.part.where("p_size <= 20").select(F.col("p_size").alias("query"), F.when(even, F.concat("p_name", F.lit(" sodium"))).otherwise(F.concat("p_name", F.lit(" zz"))).alias("term"))
    empty = t.spark.createDataFrame([], "name string, synonym string, alias string, canonical string")
    return R.expansion(terms, empty.select("name", "synonym"), empty.select("alias", "canonical"), pool(t), empty.select("name"))


@query(
    "alias_build",
    """with r as (select lower(trim(synonym)) as alias, p_name as canonical from syn join part on id = p_partkey where id in (select l_partkey from lineitem) and lower(trim(synonym)) <> lower(p_name))
    select alias, min(canonical) as canonical from r where alias not in (select lower(p_name) from part) group by 1 having count(distinct canonical) = 1""",
    "syn",
)
def _(t):
    canonicals = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("canonical"))
    return R.alias_map(t.syn.select("id", F.col("synonym").alias("alias")), canonicals, t.lineitem.select(F.col("l_partkey").alias("id")))


@query("alias_apply", "select p_partkey as query, 'association_part' as field, case when lower(p_name) = 'red widget' then 'Crimson Widget' else p_name end as value from part")
def _(t):
    maps = t.spark.createDataFrame([("part", "RED WIDGET", "Crimson Widget"), ("drug", "blue bolt", "x")], "field string, alias string, canonical string")
    return R.apply_aliases(t.part.select(F.col("p_partkey").alias("query"), F.lit("association_part").alias("field"), F.col("p_name").alias("value")), maps)


@query("reverse_map", "select synonym, array_to_string(list_sort(list(distinct name)), '|') as canonicals from (select lower(synonym) as synonym, p_name as name from syn join part on id = p_partkey union all select lower(p_name), p_name from part) group by 1", "syn")
def _(t):
    return R.reverse_map(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), t.syn)


@query(
    "prescreen",
    """with n as (select distinct p_name as value from part), q as (select unnest([0, 1]) as query, unnest(['red widget', 'blue']) as term),
    c as (select unnest(string_split('abcdefghijklmnopqrstuvwxyz ', '')) as ch),
    qr as (select q.query, n.value, sum(least(length(term) - length(replace(term, ch, '')), length(value) - length(replace(value, ch, '')))) as common from q, n, c group by q.query, n.value),
    w as (select q.query, n.value as v, term, common from q cross join n join qr on qr.query = q.query and qr.value = n.value),
    s as (select query, v as value, round(2.0 * (contains(v, term) or contains(term, v))::int + 2.0 * common / (length(term) + length(v)) + 0.5 * len(list_intersect(string_split(term, ' '), string_split(v, ' '))) / len(list_distinct(list_concat(string_split(term, ' '), string_split(v, ' ')))), 6) as score from w)
    select query, value, score from (select *, row_number() over (partition by query order by score desc, value) as rn from s) where rn <= 5""",
)
def _(t):
    terms = t.spark.createDataFrame([(0, "Red widget"), (1, " blue ")], "query int, term string")
    return R.prescreen(t.part.select(F.col("p_name").alias("value")).distinct().crossJoin(F.broadcast(terms)), 5)  # two stated terms


@query("acronym_filter", "select p_partkey as query, p_name as term from part union all select p_partkey, p_name || ' disease' from part union all select p_partkey, substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1) from part")
def _(t):
    w = F.split("p_name", " ")
    forms = F.array("p_name", F.concat("p_name", F.lit(" disease")), F.concat(F.substring(w[0], 1, 1), F.substring(w[1], 1, 1)), F.lit("other thing"), w[0])
    return R.acronym_filter(t.part.select(F.col("p_partkey").alias("query"), F.col("p_name").alias("name"), F.explode(forms).alias("term")))


@query("acronym_spelled", "select p_partkey as query, p_name || ' of 2 mellitus' as term from part")
def _(t):
    w = F.split("p_name", " ")
    short = F.concat(F.substring(w[0], 1, 1), F.substring(w[1], 1, 1), F.lit("o2m"))
    return R.acronym_filter(t.part.select(F.col("p_partkey").alias("query"), short.alias("name"), F.explode(F.array(F.concat("p_name", F.lit(" of 2 mellitus")), F.lit("zz top"))).alias("term")))


@query("family", "select distinct c_name as name from customer where lower(c_mktsegment) = 'machinery'")
def _(t):
    return R.family(t.customer.select(F.col("c_name").alias("name"), F.concat(F.lit("heavy "), "c_mktsegment").alias("family")), "machinery")


@query("canonical_hit", "select p_size as query, arg_min(p_name, [length(p_name), pos]) as name, case when p_size <= 64 then 0 end as tier from (select p_size, p_name, row_number() over (partition by p_size order by p_partkey) as pos from part) where pos = 1 group by p_size")
def _(t):
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))
    rows = t.part.select(F.col("p_size").alias("query"), F.col("p_name").alias("name"), pos.alias("pos"))
    first = rows.where("pos = 1").select("query", F.upper("name").alias("term"))
    return R.canonical_hit(rows.join(first, "query"))


@query("literal_members", "select distinct 0 as query, p_name as name from part where list_contains(string_split(p_name, ' '), 'widget') union select distinct 1, p_name from part where p_name = 'red widget'")
def _(t):
    terms = t.spark.createDataFrame([(0, "Widget"), (1, "red  widget")], "query int, term string")
    return R.literal_members(terms, t.part.select(F.col("p_name").alias("name")).distinct())


@query("foreign_drop", "select id, synonym from (select p_partkey as id, case when p_partkey % 2 = 0 then 'Brand#3' else p_brand end as synonym from part) where not (lower(synonym) = 'brand#3' and id <> 3)")
def _(t):
    syn = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "Brand#3").otherwise(F.col("p_brand")).alias("synonym"))
    return R.drop_foreign(syn, t.part.where("p_partkey = 3").select(F.col("p_partkey").alias("id"), F.lit("BRAND#3").alias("canonical")))


@query("canonical_fields", "select p_partkey, case when p_size % 2 = 0 and p_type <> 'SMALL' then p_name else '' end as target_name from part")
def _(t):
    rows = t.part.select("p_partkey", F.col("p_type").alias("db"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("gene_name"), F.lit("").alias("target_name"))
    return R.canonical_fields(rows, "gene_name", "target_name", ["SMALL"]).select("p_partkey", "target_name")


@query("collection_aliases", "select distinct unnest([lower('GoTerms' || p_type), lower('Go Terms ' || p_type)]) as alias, 'GoTerms' || p_type as canonical from part")
def _(t):
    return R.collection_aliases(t.part.select(F.concat(F.lit("GoTerms"), "p_type").alias("name")), "name")


@query("agreement", """select p_partkey as "row", p_size > 10 as agree from part""")
def _(t):
    left = t.part.select(F.col("p_partkey").alias("row"), F.explode(F.map_from_arrays(F.array(F.lit("name"), F.lit("brand")), F.array("p_name", "p_brand"))).alias("field", "value"))
    right = left.select("row", "field", F.upper("value").alias("value")).join(t.part.select(F.col("p_partkey").alias("row"), "p_size"), "row")
    right = right.where("p_size > 10 or field = 'name'").drop("p_size")
    return R.agreement(left, right)


@query("kept_candidates", "select p_size as query, min(p_partkey) as pos, p_name as value from part where p_type = 'ECONOMY' group by p_size, p_name")
def _(t):
    cands = t.part.where("p_type = 'ECONOMY'").select(F.col("p_size").alias("query"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("value"))
    return R.kept_candidates(t.part.select(F.col("p_size").alias("query"), F.upper("p_name").alias("value")), cands)


@query("merge_by_trust", "select q as query, v as value, min(prio)::int as prio from (select p_size as q, p_name as v, 0 as prio from part where p_partkey % 3 = 0 union all select p_size, p_name, 1 from part where p_partkey % 3 = 1 union all select p_size, p_name, 2 from part) group by all")
def _(t):
    from tessella.operators.keyed import by_trust

    of = lambda p: t.part.where(p).select(F.col("p_size").alias("query"), F.col("p_name").alias("value"))
    return by_trust([of("p_partkey % 3 = 0"), of("p_partkey % 3 = 1"), of("true")], "value", ["query"])


@query("fuzzy")
def _(t):
    names = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("query"))
    terms = names.select("query", F.concat(F.substring("p_name", 2, 30), F.lit("s")).alias("term"))
    return R.fuzzy(terms, t.part.select(F.concat_ws(" ", "p_brand", "p_name").alias("value")).distinct())


@query("ngram_rewrite", "select p_partkey as id, 'Is (' || p_name || ')? a widget, too.' as text, 'Is (' || case p_name when 'red widget' then 'Crimson Widget' when 'blue bolt' then 'azure fastener' else array_to_string(list_transform(string_split(p_name, ' '), lambda w: case w when 'widget' then 'gadget' else w end), ' ') end || ')? a gadget, too.' as rewritten from part")
def _(t):
    names = t.spark.createDataFrame([("red widget", "Crimson Widget"), ("widget", "gadget"), ("blue bolt", "azure fastener")], "phrase string, target string")
    texts = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("Is ("), "p_name", F.lit(")? a widget, too.")).alias("text"))
    return R.rewrite_ngrams(texts, names)


@query("ngram_rewrite_vocabulary", "select p_partkey as id, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || '; ' || p_brand || ' ' || p_name || '!' as text, p_name || '; ' || p_name || '!' as rewritten from part")
def _(t):
    """Every synonym of every part, a vocabulary as long as its table, back to the part's name."""
    vocabulary = t.syn.join(t.part, F.col("id") == F.col("p_partkey")).select(F.col("synonym").alias("phrase"), F.col("p_name").alias("target"))
    w = F.split("p_name", " ")
    texts = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.element_at(w, 2), F.lit(" "), F.element_at(w, 1), F.lit("; "), "p_brand", F.lit(" "), "p_name", F.lit("!")).alias("text"))
    return R.rewrite_ngrams(texts, vocabulary)
