"""Data-quality jobs: orphans, key uniqueness, referential integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ForeignKey = tuple[str, str, str, str]  # fact table, its column, master table, its key


def orphans(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """(fact, fk, rows, orphan_rows, orphan_keys) for every foreign key."""

    def one(fact, fk, master, key):
        known = tables[master].select(F.col(key).alias("__k")).distinct()
        by_key = tables[fact].where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("__k")).agg(F.count("*").alias("n"))
        rows = by_key.join(known.withColumn("__in", F.lit(True)), "__k", "left")
        return rows.agg(F.lit(fact).alias("fact"), F.lit(fk).alias("fk"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("__in").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"), F.count_if(F.col("__in").isNull()).alias("orphan_keys"))

    return reduce(DataFrame.union, [one(*k) for k in keys])


def key_audit(tables: dict[str, DataFrame], primary: dict[str, list[str]]) -> DataFrame:
    """(table, rows, null_keys, distinct_keys, repeated_keys)."""

    def one(name, key):
        null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
        by_key = tables[name].groupBy(*key).agg(F.count("*").alias("n")).withColumn("null", null)
        return by_key.agg(F.lit(name).alias("table"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("null"), F.col("n"))), F.lit(0)).alias("null_keys"), F.count_if(~F.col("null")).alias("distinct_keys"), F.count_if(~F.col("null") & (F.col("n") > 1)).alias("repeated_keys"))

    return reduce(DataFrame.union, [one(n, k) for n, k in primary.items()])


def unreferenced(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """(master, fact, unreferenced): master keys that no fact uses."""

    def one(fact, fk, master, key):
        used = tables[fact].select(F.col(fk).alias("__k")).distinct()
        left = tables[master].select(F.col(key).alias("__k")).distinct().join(used, "__k", "left_anti")
        return left.agg(F.lit(master).alias("master"), F.lit(fact).alias("fact"), F.count("*").alias("unreferenced"))

    return reduce(DataFrame.union, [one(*k) for k in keys])
