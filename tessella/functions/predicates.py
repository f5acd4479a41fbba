"""Predicates of a filter specification: {column: [values] or "requested"}, applied by name to any table.

A null cell makes a predicate null, which a filter treats as false; they stay bare, so that comparisons reach
the scan."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import AMINO, UNSAFE_PLURALS

Filters = dict[str, "list | str"]
#: Beyond so many values membership becomes a join instead of a list.
LIST_VALUES = 1000
LETTER = r"\p{L}\p{N}_"


def values_of(filters: Filters, name: str) -> list:
    v = filters.get(name)
    return [] if v is None or isinstance(v, str) else [x for x in v if x is not None and str(x).strip()]


def member(name: str, values: list) -> Column:
    """Membership without regard to case."""
    return F.lower(F.col(name)).isin([str(v).lower() for v in values])


def variants(term: str) -> list[str]:
    """What a term is searched as: itself, without trailing bases, and its plural or singular."""
    t = term.strip().lower()
    found = [t, re.sub(r"(dup|del|ins)[acgt]+$", r"\1", t)]
    if t.endswith("s") and len(t) > 3 and not t.endswith(UNSAFE_PLURALS):
        found.append(t[:-1])
    elif t and not t.endswith("s") and t[-1].isalpha():
        found.append(t + "s")
    return list(dict.fromkeys(found))


def quoted(term: str) -> str:
    return re.sub(r"([.\\+*?\[\]^$(){}=!<>|:#/-])", r"\\\1", term)


def whole_word(name: str, terms: list[str]) -> Column:
    """Any variant of any term as whole words in the text, accents counted as letters."""
    alternatives = "|".join(quoted(v) for t in terms for v in variants(t))
    return F.lower(F.col(name)).rlike(f"(^|[^{LETTER}])({alternatives})($|[^{LETTER}])")


def holds_text(name: str, terms: list[str]) -> Column:
    """A plain part of the text, for names with coded prefixes."""
    return reduce(or_, [F.lower(F.col(name)).contains(t.lower()) for t in terms])


def component(name: str, values: list[str]) -> Column:
    """One of the parts between / ; and , equals a value."""
    wanted = [v.strip().lower() for v in values]
    return F.exists(F.split(F.trim(F.lower(F.col(name))), r"\s*[/;,]\s*"), lambda x: x.isin(wanted))


def protein_pattern(term: str) -> str | None:
    """V600E, p.C634 or R213* as the three-letter text to search as a whole word, None for other shapes."""
    m = re.fullmatch(r"(?:p\.?\s*)?([a-z])(\d+)([a-z*]?)", term.strip().lower())
    if not m or m[1].upper() not in AMINO or (m[3] and m[3].upper() not in AMINO):
        return None
    return rf"\b{AMINO[m[1].upper()]}{m[2]}{AMINO[m[3].upper()] if m[3] else '[a-z]{3}'}\b"


def notation(name: str, terms: list[str]) -> Column:
    """Any term as whole words, or a change of a protein in its three-letter notation."""
    found = [p for p in map(protein_pattern, terms) if p]
    words = whole_word(name, terms)
    return words | F.lower(F.col(name)).rlike("|".join(found)) if found else words


OPERATORS = {
    "<": Column.__lt__, "lt": Column.__lt__, ">": Column.__gt__, "gt": Column.__gt__, "<=": Column.__le__, "lte": Column.__le__, "le": Column.__le__, "≤": Column.__le__,
    ">=": Column.__ge__, "gte": Column.__ge__, "ge": Column.__ge__, "≥": Column.__ge__, "=": Column.__eq__, "==": Column.__eq__, "eq": Column.__eq__,
}


def threshold(name: str, values: list, operator: str | None = None) -> Column | None:
    """A comparison with the first value that is a number; an unknown or missing operator means <=."""
    for v in values:
        try:
            limit = float(v)
        except (TypeError, ValueError):
            continue
        return OPERATORS.get(str(operator or "<=").strip(), Column.__le__)(F.col(name), F.lit(limit))
    return None


def null_tolerant(name: str, values: list[str]) -> Column:
    """In the set, or null, or empty."""
    return F.lower(F.col(name)).isin([v.lower() for v in values]) | F.col(name).isNull() | (F.col(name) == "")


def table_predicates(df: DataFrame, filters: Filters, kinds: dict[str, str] | None = None, any_of: tuple[str, ...] = (), operators: dict[str, str] | None = None) -> list[tuple[str, list, Column]]:
    """(column, values, predicate) for the filters that this table's columns answer to. kinds names how a
    column is matched (member, word, text, component, notation, number); columns of any_of are joined by OR."""
    kinds, operators, types, found, either = kinds or {}, operators or {}, dict(df.dtypes), [], []
    for name in filters:
        values = values_of(filters, name)
        if name not in types or not values or name in operators.values():
            continue
        kind = kinds.get(name, "member")
        if kind == "number":
            if types[name] == "string":
                continue
            limit = values_of(filters, operators.get(name, "")) or [None]
            p = threshold(name, values, limit[0])
        elif types[name] != "string":
            continue
        else:
            p = {"member": member, "word": whole_word, "text": holds_text, "component": component, "notation": notation}[kind](name, values)
        if p is not None:
            (either if name in any_of else found).append((name, values, p))
    if either:
        found.append((" or ".join(n for n, _, _ in either), [v for _, vs, _ in either for v in vs], reduce(or_, [p for _, _, p in either])))
    return found


def filter_table(df: DataFrame, filters: Filters, **how) -> DataFrame:
    """Rows that meet every filter the table answers to. Long lists become a semi join."""
    for name in filters:
        values = values_of(filters, name)
        if len(values) > LIST_VALUES and dict(df.dtypes).get(name) == "string" and (how.get("kinds") or {}).get(name, "member") == "member" and name not in how.get("any_of", ()):
            wanted = df.sparkSession.createDataFrame([(str(v).lower(),) for v in set(values)], "__v string")
            df = df.join(wanted, F.lower(F.col(name)) == F.col("__v"), "left_semi")
            filters = {k: v for k, v in filters.items() if k != name}
    found = table_predicates(df, filters, **how)
    return df.where(reduce(and_, [p for _, _, p in found])) if found else df


def funnel(df: DataFrame, filters: Filters, **how) -> DataFrame:
    """(step, column, rows_before, rows_after, reduction_pct) of the filters in order, in one pass over df."""
    found = table_predicates(df, filters, **how)
    so_far, counts = F.lit(True), [F.count("*").alias("n0")]
    for i, (_, _, p) in enumerate(found):
        so_far = so_far & p
        counts.append(F.count_if(so_far).alias(f"n{i + 1}"))
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("column"), F.col(f"n{i}").alias("rows_before"), F.col(f"n{i + 1}").alias("rows_after")) for i, (n, _, _) in enumerate(found)])
    steps = df.agg(*counts).select(F.explode(rows).alias("s")).select("s.*")
    return steps.withColumn("reduction_pct", F.when(F.col("rows_before") > 0, F.round(100.0 * (F.col("rows_before") - F.col("rows_after")) / F.col("rows_before"), 4)).otherwise(0.0))


def keep_if_any(df: DataFrame, p: Column) -> DataFrame:
    """Rows that meet p; all rows if none does. The test is one aggregate, not a pass that is collected."""
    some = df.agg(F.coalesce(F.bool_or(p), F.lit(False)).alias("__some"))
    return df.crossJoin(F.broadcast(some)).where(~F.col("__some") | F.coalesce(p, F.lit(False))).drop("__some")  # one row


# Filters that depend on what there is.


def relaxed(term: str, names: DataFrame, name: str, most: float = 0.02) -> DataFrame:
    """(term, n): the longest end of the term, word by word, that names hold as words in some rows and in a share of
    `most` at most; no row if there is none. All ends are counted in one job, over distinct names."""
    words = term.lower().split()
    ends = names.sparkSession.createDataFrame([(" ".join(words[k:]), k) for k in range(len(words))], "term string, k int")
    rows = names.groupBy(F.lower(name).alias("name")).agg(F.count("*").alias("m"))
    by_word = rows.withColumn("w", F.explode(F.array_distinct(F.split("name", " "))))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    hit = ends.withColumn("w", F.split("term", " ")[0]).join(by_word, "w").where(padded("name").contains(padded("term")))
    total = names.agg(F.count("*").alias("total"))
    counts = hit.groupBy("term", "k").agg(F.sum("m").alias("n")).crossJoin(F.broadcast(total))  # one row
    return counts.where((F.col("n") > 0) & (F.col("n") <= most * F.col("total"))).agg(F.min(F.struct("k", "term", "n")).alias("x")).where("x is not null").select("x.term", "x.n")


def vocabulary(rows: DataFrame, name: str) -> DataFrame:
    """(v): the distinct values of a column of comma-separated `id|some_value`, in lower case with spaces."""
    raw = rows.select(F.explode(F.split(name, ",")).alias("v"))
    plain = F.lower(F.translate(F.trim(F.regexp_replace("v", r"^[^|]*\|", "")), "_", " "))
    return raw.select(plain.alias("v")).where("v <> ''").distinct()


def in_vocabulary(vocab: DataFrame, terms: list[str]) -> DataFrame:
    """(v): what the terms mean in a vocabulary: values that hold a term or its singular, or are held by it. Empty: drop the filter."""
    forms = sorted({f for t in terms for f in (t.strip().lower(), t.strip().lower().removesuffix("s")) if f})
    if not forms:
        return vocab.limit(0)
    return vocab.where(F.exists(F.array(*[F.lit(f) for f in forms]), lambda x: F.col("v").contains(x) | x.contains(F.col("v"))))


def injected(filters: Filters, column: str, value: str | None, *, entities: tuple[str, ...], tables: set[str], table: str) -> Filters:
    """filters with column = value, if the table is in the plan, some entity is asked for, and the column is not filtered yet."""
    if value is None or table not in tables or values_of(filters, column) or not any(values_of(filters, e) for e in entities):
        return filters
    return filters | {column: [value]}


def buckets_of(groups: Column, modality: str | None = None) -> Column:
    """The true buckets `group:label` of map<group, map<label, boolean>>, of one group if it is named; sorted."""
    entries = F.map_entries(groups)
    chosen = F.filter(entries, lambda e: F.upper(e.key) == modality.upper()) if modality else entries
    labels = F.transform(chosen, lambda e: F.transform(F.filter(F.map_entries(e.value), lambda b: F.coalesce(b.value, F.lit(False))), lambda b: F.concat(e.key, F.lit(":"), b.key)))
    return F.array_sort(F.coalesce(F.flatten(labels), F.array().cast("array<string>")))


def with_buckets(df: DataFrame, name: str, any_of: list[str] | None = None, *, modality: str | None = None, negated: bool = False) -> DataFrame:
    """Rows with some true bucket (one of any_of, if given), or with none if negated; `buckets` lists them."""
    found = buckets_of(F.col(name), modality)
    if any_of:
        wanted = [w.lower() for w in any_of]
        found = F.filter(found, lambda x: F.lower(F.substring_index(x, ":", -1)).isin(wanted))
    rows = df.withColumn("buckets", found)
    rows = rows.where((F.size("buckets") == 0) if negated else (F.size("buckets") > 0))
    return rows.withColumn("buckets", F.array_join("buckets", "; "))


def between(edges: DataFrame, a: str, b: str, named: DataFrame, known: int | None = None) -> DataFrame:
    """Edges with both ends among the named (a column of the name `key`); if fewer than two of them are known, those
    with either end there."""
    keys = named.select("key").distinct()
    if known is not None and known < 2:
        first = edges.join(keys.toDF(a), a, "left_semi")
        return first.unionByName(edges.join(keys.toDF(a), a, "left_anti").join(keys.toDF(b), b, "left_semi").select(edges.columns))
    return edges.join(keys.toDF(a), a, "left_semi").join(keys.toDF(b), b, "left_semi").select(edges.columns)


def pruned(df: DataFrame, owners: dict[str, str], present: set[str]) -> DataFrame:
    """df without the columns whose entity (owners: column -> entity) is not asked about."""
    return df.drop(*[c for c, entity in owners.items() if entity not in present])


def prefix_in(text: str, prefixes: list[tuple[str, str]]) -> str | None:
    """The name prefix of the first phrase that the text holds as words; the list goes from specific to general."""
    words = f" {' '.join(re.findall(r'[a-z0-9]+', text.lower()))} "
    return next((p for phrase, p in prefixes if f" {phrase} " in words), None)


def starts_with_any(name: str, prefixes: list[str]) -> Column:
    return reduce(or_, [F.lower(F.col(name)).startswith(p.lower()) for p in prefixes])
