"""Filters that a question's text implies: a name's prefix, tokens of a vocabulary, an organism.

questions: (id, text, filters map<string, array<string>>), of which a whole table is treated at once. A value counts if it is neither
blank nor the word "requested"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.lineage import checkpointed

#: Words of a question that an alias may stand for, and that a token may.
ALIAS_WORD, TOKEN_WORD = r"(?U)\b[a-z][a-z0-9α-ω]+\b", "^[a-z][a-z0-9]{2,}$"


def has_value(values: Column) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.coalesce(~F.lower(F.trim(v)).isin("", "requested"), F.lit(False))), F.lit(False))


def value_of(column: str) -> Column:
    return F.try_element_at("filters", F.lit(column))


def any_value() -> Column:
    return F.coalesce(F.exists(F.map_values("filters"), has_value), F.lit(False))


def put(column: str, values: Column) -> Column:
    """filters with the column's values replaced, or dropped where there are none."""
    rest = F.map_filter(F.coalesce("filters", F.create_map().cast("map<string, array<string>>")), lambda k, _: k != column)
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.map_concat(rest, F.create_map(F.lit(column), values))).otherwise(rest)


def with_prefix(questions: DataFrame, column: str, prefixes: list[tuple[str, str]]) -> DataFrame:
    """Patterns' `%` removed from the column's values; where none counts, the prefix of the first phrase in the text."""
    own = F.filter(F.transform(value_of(column), lambda v: F.trim(F.replace(v, F.lit("%"), F.lit("")))), lambda v: v != "")
    low = F.lower("text")
    found = F.coalesce(*[F.when(low.contains(phrase), F.array(F.lit(prefix))) for phrase, prefix in prefixes], F.lit(None).cast("array<string>"))
    return questions.withColumn("filters", put(column, F.when(has_value(own), own).otherwise(F.coalesce(found, own))))


def with_tokens(questions: DataFrame, column: str, aliases: DataFrame, tokens: DataFrame) -> DataFrame:
    """Where no filter has a value at all: the tokens that the text's words stand for, in their order, those of aliases (word,
    token) first, then those of the vocabulary (token). Words meet both in joins, whatever their size."""
    rows = checkpointed(questions.withColumn("__row", F.monotonically_increasing_id()))
    words = rows.where(~any_value()).select("__row", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(ALIAS_WORD), F.lit(0))).alias("pos", "word"))
    first = words.groupBy("__row", "word").agg(F.min("pos").alias("pos"))
    own = aliases.select(F.col("word"), F.col("token")).distinct()
    known = tokens.select(F.lower("token").alias("word"), "token").groupBy("word").agg(F.min("token").alias("token"))
    hits = first.join(own, "word").select("__row", "token", F.struct(F.lit(0).alias("pass"), "pos").alias("at"))
    hits = hits.union(first.where(F.col("word").rlike(TOKEN_WORD)).join(known, "word").select("__row", "token", F.struct(F.lit(1).alias("pass"), "pos").alias("at")))
    lists = hits.groupBy("__row", "token").agg(F.min("at").alias("at")).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("__found"))
    out = rows.join(lists, "__row", "left").withColumn("__found", F.transform("__found", lambda x: x.token))
    return out.withColumn("filters", F.when(F.size("__found") > 0, put(column, F.col("__found"))).otherwise(F.col("filters"))).drop("__row", "__found")


def with_organism(questions: DataFrame, columns: list[str], several: str, organisms: list[tuple[str, str]]) -> DataFrame:
    """Where the text asks for what several sets share and names an organism: the first such organism, in each of the columns that
    has no value."""
    named = F.coalesce(*[F.when(F.col("text").rlike(form), F.lit(value)) for form, value in organisms], F.lit(None).cast("string"))
    found = F.when(F.col("text").rlike(several), named)
    for c in columns:
        questions = questions.withColumn("filters", F.when(found.isNotNull() & ~has_value(value_of(c)), put(c, F.array(found))).otherwise(F.col("filters")))
    return questions
