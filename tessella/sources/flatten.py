"""Nested records to rows: drugs and targets, mechanisms, scores, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.lineage import stored


def parsed(df: DataFrame, text: str, schema: str, name: str = "r") -> DataFrame:
    return df.withColumn(name, F.from_json(text, schema))


def distinct_joined(items: Column, field: str, by: str = "; ") -> Column:
    """Sorted distinct values of a field of structs."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: x[field].cast("string")), lambda x: x.isNotNull() & (x != "")))), by)


def first_of(items: Column, field: str) -> Column:
    return F.try_element_at(items, F.lit(1))[field]


def rows_with_first(df: DataFrame, items: str, nested: str, field: str, status: str) -> DataFrame:
    """One row for each item, empty lists kept; the first nested value and all statuses of the item."""
    out = df.withColumn("item", F.explode_outer(items))
    return out.withColumn("first_value", first_of(F.col(f"item.{nested}"), field)).withColumn("statuses", distinct_joined(F.col(f"item.{nested}"), status))


def item_pairs(df: DataFrame, items: str, nested: str) -> DataFrame:
    """Items by nested items, either kept where the list is empty."""
    return df.withColumn("item", F.explode_outer(items)).withColumn("sub", F.explode_outer(f"item.{nested}"))


def first_name(*names: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(n.cast("string")) != "", n.cast("string")) for n in names])


def holding(items: Column, nested: str, field: str, anchor: Column) -> Column:
    """The items whose nested list has the anchor."""
    return F.filter(items, lambda m: F.coalesce(F.exists(m[nested], lambda t: t[field] == anchor), F.lit(False)))


def score_columns(df: DataFrame, scores: str, names: list[str], prefix: str = "score_") -> DataFrame:
    """[{id, score}] to fixed columns, missing ones 0.0; of an id given twice the greatest counts."""

    def one(name: str) -> Column:
        own = F.filter(F.col(scores), lambda x: x["id"].cast("string") == name)
        return F.coalesce(F.array_max(F.transform(own, lambda x: x["score"].cast("double"))), F.lit(0.0))

    return df.withColumns({prefix + n: one(n) for n in names})


def expression_rows(df: DataFrame, items: str) -> DataFrame:
    """Structured before free-text names, strongest first, in place of the list. The rows are stored before they are sorted, as a
    sort looks at its input twice: for the bounds of its ranges, and for the rows."""
    one = df.withColumn("x", F.explode(items))
    rows = one.withColumn("name", first_name(F.col("x.label"), F.col("x.text"))).withColumn("value", F.col("x.score").cast("double")).drop("x", items)
    return stored(rows, "expression").orderBy(F.desc_nulls_last("value"), "name")


def literature(items: Column, most: int = 5) -> tuple[Column, Column]:
    """The first ids joined, and how many there are."""
    return F.array_join(F.slice(items, 1, most), ", "), F.coalesce(F.size(items), F.lit(0))


def by_aspect(terms: Column, aspect: str) -> Column:
    """Distinct (id, aspect) terms of an aspect, by id."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(terms, lambda t: t["aspect"] == aspect), lambda t: t["id"])))


def preferred_id(ids: Column, sources: list[str]) -> Column:
    """The least id of the first source that has any."""

    def least(source: str) -> Column:
        return F.array_min(F.transform(F.filter(ids, lambda x: x["source"] == source), lambda x: x["id"]))

    return F.coalesce(*[least(s) for s in sources])
