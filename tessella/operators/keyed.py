"""Keyed joins and set operations of two results, on trimmed lower-case keys; blank keys never match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import number
from tessella.sources.curate import first_per_key

ID_KEYS = ("gene_id", "drug_id", "disease_id")
NAME_KEYS = ("gene_name", "drug_name", "disease_name")
SCORE = "association_score"


def norm_key(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))


def detect_key(left: DataFrame, right: DataFrame, explicit: str | None = None, ids=ID_KEYS, names=NAME_KEYS) -> tuple[str, str] | None:
    """(column, confidence): explicit, an id, a name, or the first shared column with values on both sides."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        return None
    filled = [df.agg(*[F.count_if(norm_key(F.col(c)).isNotNull()).alias(c) for c in shared]).first() for df in (left, right)]
    usable = [c for c in shared if filled[0][c] and filled[1][c]]
    for confidence, names_ in (("explicit", [explicit]), ("id", ids), ("name", names), ("shared", shared)):
        for c in names_:
            if c in usable:
                return c, confidence
    return None


def suffixed(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Both sides' columns; those of the same name get _left and _right. The key is the normal form's match."""
    both = [c for c in left.columns if c in right.columns and c != key]
    l = left.select(norm_key(F.col(key)).alias("__k"), F.col(key), *[F.col(c).alias(c + "_left" if c in both else c) for c in left.columns if c != key])
    r = right.select(norm_key(F.col(key)).alias("__k"), *[F.col(c).alias(c + "_right" if c in both else c) for c in right.columns if c != key])
    return l.join(r, "__k", how).drop("__k")


def coalesce_suffixes(df: DataFrame) -> DataFrame:
    """x_left unless null or blank, else x_right, as x."""
    out = []
    for c in df.columns:
        if c.endswith("_left") and c[:-5] + "_right" in df.columns:
            out.append(F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(c[:-5] + "_right")).alias(c[:-5]))
        elif not (c.endswith("_right") and c[:-6] + "_left" in df.columns):
            out.append(F.col(c))
    return df.select(*out)


def enrich(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return suffixed(left, right, key, "left")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join whose right side must have one row per key."""
    if not right.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{keys} repeat on the right side")
    return left.join(right, keys, "left")


def both_min(a: Column, b: Column) -> Column:
    """The lesser; null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def best_per_key(df: DataFrame, key: str, score: str = SCORE, more: list[Column] = []) -> DataFrame:
    rest = [F.asc_nulls_last(c) for c in df.columns]
    out = df.where(norm_key(F.col(key)).isNotNull()).withColumn("__k", norm_key(F.col(key)))
    return first_per_key(out, ["__k"], [*more, F.desc_nulls_last(score), *rest]).drop("__k")


def intersect(left: DataFrame, right: DataFrame, key: str, score: str = SCORE) -> DataFrame:
    rows = suffixed(left, right, key, "inner")
    if f"{score}_left" in rows.columns:
        rows = rows.withColumn("__s", both_min(number(F.col(f"{score}_left")), number(F.col(f"{score}_right"))))
        rows = coalesce_suffixes(rows).withColumn(score, F.col("__s")).drop("__s")
    else:
        rows = coalesce_suffixes(rows)
    return best_per_key(rows, key, score)


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows whose key is not on the right. A right side without rows leaves the left as it is; with
    any, rows with blank keys go."""
    keys = right.select(norm_key(F.col(key)).alias("__k")).where("__k is not null").distinct()
    some = right.agg((F.count("*") > 0).alias("__some"))
    kept = left.withColumn("__k", norm_key(F.col(key))).join(keys, "__k", "left_anti").crossJoin(F.broadcast(some))  # one row
    return kept.where("not __some or __k is not null").select(*left.columns)


def union(left: DataFrame, right: DataFrame, key: str, *, best: bool = False, score: str = SCORE) -> DataFrame:
    """One row per key: the left side's first, or the best scored."""
    both = left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    order = [F.desc_nulls_last(score), F.asc("__side")] if best else [F.asc("__side"), F.desc_nulls_last(score)]
    return best_per_key(both, key, score, order).drop("__side")


def capped(df: DataFrame, left_rows: int, score: str = SCORE, most: int = 50_000, ratio: float = 50.0) -> DataFrame:
    """The feature's cap on set results: beyond `most` rows, or `ratio` rows per left row, the best `most`
    stay and are flagged."""
    n = df.count()
    if n <= most and n <= ratio * max(1, left_rows):
        return df.withColumn("truncated", F.lit(False))
    return df.orderBy(F.desc_nulls_last(score), *[F.asc_nulls_last(c) for c in df.columns]).limit(most).withColumn("truncated", F.lit(True))


def by_trust(sources: list[DataFrame], value: str, group: list[str] = []) -> DataFrame:
    """Union of lists in order of trust; a value keeps its most trusted source."""
    parts = [s.withColumn("prio", F.lit(i)) for i, s in enumerate(sources)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*group, F.lower(value).alias("__v")).agg(F.min(F.struct("prio", value)).alias("x")).select(*group, F.col(f"x.{value}").alias(value), "x.prio")


def synonym_canonical(syn: DataFrame, names: DataFrame, key: str, synonym: str, name: str, structural: Column | None = None) -> DataFrame:
    """synonym -> the shortest canonical name; 4 to 80 characters."""
    rows = syn.join(names, key).where(F.length(synonym).between(4, 80))
    rows = rows.where(~structural) if structural is not None else rows
    return rows.groupBy(F.lower(synonym).alias("synonym")).agg(F.min(F.struct(F.length(name).alias("n"), F.col(name).alias("name"))).alias("x")).select("synonym", F.col("x.name").alias("canonical"))


def combine(edges: DataFrame, anchor: str, other: str, a: str, b: str, op: str, score: str = SCORE) -> DataFrame:
    """What is linked to anchor a, and / or / but not to anchor b."""
    left, right = (edges.where(norm_key(F.col(anchor)) == v.strip().lower()).drop(anchor) for v in (a, b))
    return {"intersect": lambda: intersect(left, right, other, score), "difference": lambda: difference(left, right, other), "union": lambda: union(left, right, other, best=True, score=score)}[op]()
