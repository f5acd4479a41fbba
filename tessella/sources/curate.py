"""Scans, cleaning and key repair of raw snapshots, as DataFrame -> DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import packed_length

PREFIXES = ("MESH:", "REACT:", "KEGG:", "OMIM:")
STRUCTURAL = ("inchi", "smiles", "molformula", "protein_sequence")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, folder: str, names: list[str]) -> str | None:
    """The first of the candidate tables that is there, its second version before its first."""
    return next((p for n in names for p in (f"{folder}/{n}_v2.parquet", f"{folder}/{n}.parquet") if exists(spark, p)), None)


def scan(spark: SparkSession, path: str, *, as_text: bool = True, keep_native: tuple[str, ...] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[F.col(c).cast("string") if as_text and c not in keep_native else F.col(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, headers trimmed, lower-cased and with _ for blanks; gene_symbol is named gene_name."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    df = df.toDF(*names)
    return df.withColumnRenamed("gene_symbol", "gene_name") if "gene_name" not in names else df


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Columns in a fixed order: the given ones first, the rest by name."""
    first = [c for c in columns or [] if c in df.columns]
    df.select(*first, *sorted(set(df.columns) - set(first))).write.mode("overwrite").csv(path, header=True)


def rename(df: DataFrame, *maps: dict[str, str]) -> DataFrame:
    """Maps are applied one after another; absent names are passed over."""
    return reduce(lambda d, m: d.withColumnsRenamed(m), maps, df)


def trim_all(df: DataFrame) -> DataFrame:
    return df.select(*[F.trim(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def clean(df: DataFrame) -> DataFrame:
    return trim_all(df).distinct()


def null_if(df: DataFrame, sentinels: dict[str, list[str]]) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(v), F.col(c)) for c, v in sentinels.items() if c in df.columns})


def drop_sentinels(df: DataFrame, name: str, sentinels: list[str]) -> DataFrame:
    """Nulls stay."""
    return df.where(~F.col(name).isin(sentinels) | F.col(name).isNull())


def strip_prefixes(c: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """One after another, so that chained prefixes all go."""
    return reduce(lambda x, p: F.regexp_replace(x, f"^{p}", ""), prefixes, c)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def unpivot_xref(df: DataFrame, key: str, columns: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """(key, xref_source, xref_id) of all cross-references that aren't null, empty or NA."""
    long = df.unpivot([key], columns, "xref_source", "xref_id").where(F.col("xref_id").isNotNull() & ~F.col("xref_id").isin("", "NA"))
    if names:
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        long = long.withColumn("xref_source", F.coalesce(F.try_element_at(table, F.col("xref_source")), F.col("xref_source")))
    return long.distinct()


def synonyms(df: DataFrame, key: str, packed: str, by: str = r"\|") -> DataFrame:
    return df.select(key, F.explode(F.split(packed, by)).alias("s")).select(key, F.trim("s").alias("synonym")).where("synonym <> ''")


def collapse_edges(df: DataFrame, keys: list[str], texts: list[str], first: list[str] = []) -> DataFrame:
    """One row per pair: the sorted distinct values of text columns, the least of others, and a count."""
    packed = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|").alias(c) for c in texts]
    return df.groupBy(*keys).agg(*packed, *[F.min(c).alias(c) for c in first], F.count("*").alias("n"))


def category_rank(c: Column, order: list[str]) -> Column:
    """Place in the order from 1; unknown and null come after all."""
    table = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i + 1)])
    return F.coalesce(F.try_element_at(table, c), F.lit(len(order) + 1)).cast("int")


def derived_measures(df: DataFrame, category: str, order: list[str], packed: str, flag: str) -> DataFrame:
    return df.withColumns(
        {f"{category}_rank": category_rank(F.col(category), order), f"{packed}_count": packed_length(F.col(packed)), f"has_{flag.lower()}": F.coalesce(F.col(packed).contains(flag), F.lit(False)).cast("int")}
    )


def both_directions(df: DataFrame, a: str, b: str) -> DataFrame:
    """Edges stored once, served both ways."""
    swapped = df.select(*[F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else F.col(c) for c in df.columns])
    return df.unionByName(swapped)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def partner_attributes(fact: DataFrame, master: DataFrame, *, partner_fk: str, master_key: str, attrs: list[str], prefix: str = "partner_") -> DataFrame:
    """The master's attributes of the partner, one master row per key, so that facts never multiply."""
    new = [a for a in attrs if a in master.columns and prefix + a not in fact.columns]
    if partner_fk not in fact.columns or master_key not in master.columns or not new:
        return fact
    lookup = master.groupBy(F.col(master_key).alias("__k")).agg(*[F.min(a).alias(prefix + a) for a in new])
    return fact.join(lookup, F.col(partner_fk) == F.col("__k"), "left").drop("__k")


def scalar_attributes(master: DataFrame, key: str, taken: list[str], most: int = 80) -> list[str]:
    """Columns of the master that are short enough to be repeated on facts: one aggregate."""
    names = [c for c in master.columns if c != key and c not in taken]
    longest = master.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in names]).first() if names else {}
    return [c for c in names if (longest[c] or 0) <= most]


def auto_partner_attributes(fact: DataFrame, master: DataFrame, *, master_key: str, partner_fk: str) -> DataFrame:
    return partner_attributes(fact, master, partner_fk=partner_fk, master_key=master_key, attrs=scalar_attributes(master, master_key, fact.columns))


def partner_keys(references: list[tuple[str, str, str, str]], mark: str = "partner") -> list[tuple[str, str, str, str]]:
    """Of references (fact, its key, master, master's key), those of facts that have two or more into one master and name
    one of them as the partner's."""
    ends: dict[tuple[str, str], list] = {}
    for r in references:
        ends.setdefault((r[0], r[2]), []).append(r)
    return [r for several in ends.values() if len({k for _, k, _, _ in several}) >= 2 for r in several if mark in r[1].lower()]


def with_partners(tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]], mark: str = "partner") -> dict[str, DataFrame]:
    """The tables, those with partners extended by the partner's short attributes."""
    out = dict(tables)
    for fact, key, master, master_key in partner_keys(references, mark):
        if fact in out and master in out:
            out[fact] = auto_partner_attributes(out[fact], out[master], master_key=master_key, partner_fk=key)
    return out


def name_both_ends(edges: DataFrame, master: DataFrame, parent: str, child: str, key: str, name: str) -> DataFrame:
    p = master.select(F.col(key).alias(parent), F.col(name).alias("parent_name"))
    c = master.select(F.col(key).alias(child), F.col(name).alias("child_name"))
    return edges.join(p, parent, "left").join(c, child, "left")


def extend_dimension(dim: DataFrame, fact: DataFrame, key: str, fact_key: str) -> DataFrame:
    """Keys that only facts have become rows of the dimension."""
    orphans = fact.select(F.col(fact_key).alias(key)).distinct().where(F.col(key).isNotNull()).join(dim, key, "left_anti")
    return dim.unionByName(orphans, allowMissingColumns=True)


def drop_orphans(fact: DataFrame, dim: DataFrame, fact_key: str, key: str) -> DataFrame:
    return fact.join(dim.select(F.col(key).alias("__k")).distinct(), F.col(fact_key) == F.col("__k"), "left_semi")


def backfill_links(links: DataFrame, seen: DataFrame, master: DataFrame, name: str, key: str) -> DataFrame:
    """Names seen in facts but absent from the links get their key from the master by name."""
    missing = seen.select(name).distinct().join(links, name, "left_anti").join(master.select(name, key), name)
    return links.unionByName(missing.select(*links.columns)).distinct()


def canonical_or_own(df: DataFrame, master: DataFrame, on: str, own: str, theirs: str) -> DataFrame:
    m = master.select(F.col(on).alias("__on"), F.col(theirs).alias("__c"))
    return df.join(m, F.col(on) == F.col("__on"), "left").withColumn(own, F.coalesce("__c", own)).drop("__on", "__c")


def composite_key(*parts: str, by: str = "|") -> Column:
    """Null if any part is."""
    whole = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in parts])
    return F.when(whole, F.concat_ws(by, *parts))


def supplement(df: DataFrame, ids: list, key: str, constants: dict[str, object]) -> DataFrame:
    """Rows with constants for the listed ids, beside the table's own."""
    extra = df.where(F.col(key).isin(ids)).select(key).distinct().select(key, *[F.lit(v).alias(c) for c, v in constants.items()])
    return df.unionByName(extra, allowMissingColumns=True)


def active_keys(tables: list[tuple[DataFrame, str]], name: str) -> DataFrame:
    return reduce(DataFrame.union, [t.select(F.col(k).alias(name)) for t, k in tables]).where(F.col(name).isNotNull()).distinct()


def value_pool(tables: dict[str, DataFrame], fields: list[str]) -> DataFrame:
    """(field, value): the distinct values of each field over all its tables."""
    parts = []
    for t in tables.values():
        names = [f for f in fields if f in t.columns and f not in STRUCTURAL]
        if names:
            parts.append(t.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in names])).alias("x")).select("x.*"))
    return reduce(DataFrame.union, parts).where("value is not null and value <> ''").distinct()


def conform(df: DataFrame, columns: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """A fixed set of columns in order: aliases renamed, missing ones null."""
    df = rename(df, {a: b for a, b in (aliases or {}).items() if b not in df.columns})
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def tag_when(df: DataFrame, needs: set[str], name: str, note: str) -> DataFrame:
    """A constant column where the result has certain columns."""
    return df.withColumn(name, F.lit(note)) if needs <= set(df.columns) else df


def full_names(df: DataFrame, lookup: DataFrame, symbol: str, full: str, columns: list[str]) -> DataFrame:
    """<column>_full_name for columns that hold known symbols."""
    for c in columns:
        own = lookup.select(F.col(symbol).alias("__s"), F.col(full).alias("__f")).groupBy("__s").agg(F.min("__f").alias(f"{c}_full_name"))
        df = df.join(own, F.col(c) == F.col("__s"), "left").drop("__s")
    return df


def records(df: DataFrame, text: str, tag: str, fields: dict[str, str]) -> DataFrame:
    """Rows from a text with repeated tags: each <tag>…</tag> is a record, its fields found by pattern."""
    one = df.withColumn("__r", F.explode(F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}>"), F.lit(0))))
    return one.select(*df.columns, *[extract(F.col("__r"), p).alias(n) for n, p in fields.items()])


def xml_records(df: DataFrame, text: str, schema: str) -> DataFrame:
    """One XML text per row, parsed with a schema, beside the row's columns."""
    return df.select(*df.columns, F.from_xml(F.col(text), schema).alias("r")).select(*df.columns, "r.*")


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The <tag> elements of XML files (UTF-8) as rows of the schema. Files are cut at </tag>, so that tasks share a large one; an
    element must not stand inside another of its name. Elements without content, and ends of tags in comments, are no records."""
    parts = spark.read.option("lineSep", f"</{tag}>").text(path)
    element = F.regexp_extract("value", rf"(?s)<{tag}(?:\s[^>]*[^/>]|\s*)>.*$", 0)
    return parts.select(element.alias("x")).where("x <> ''").select(F.from_xml(F.concat("x", F.lit(f"</{tag}>")), schema).alias("r")).select("r.*")


def alias_lists(rows: DataFrame, names: Column, synonyms: Column) -> DataFrame:
    """(alias, canonicals): for each name and synonym of a row in lower case the canonical names that it stands for, ascending. A row's
    canonical name is the first of its names that isn't blank; a row without one is left out."""
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    named = rows.select(F.try_element_at(clean(names), F.lit(1)).alias("canonical"), clean(synonyms).alias("s")).where("canonical is not null")
    pairs = named.select("canonical", F.explode(F.concat(F.array("canonical"), "s")).alias("a")).select(F.lower("a").alias("alias"), "canonical")
    return pairs.groupBy("alias").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals"))


def synonym_map(rows: DataFrame, name: str, synonyms: str) -> DataFrame:
    """(synonym, canonical) from names with arrays of synonyms: a synonym of several names is left out, as is one that is
    itself a name."""
    pairs = rows.select(F.col(name).alias("canonical"), F.explode(synonyms).alias("s")).select(F.lower(F.trim("s")).alias("synonym"), "canonical").where("synonym <> ''")
    one = pairs.groupBy("synonym").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("other")).where("canonical = other").drop("other")
    return one.join(rows.select(F.lower(F.trim(name)).alias("synonym")).distinct(), "synonym", "left_anti")
