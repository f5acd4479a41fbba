"""The bank of worked examples as a stored table, fed by batches or by a stream.

A delivery replaces each (db, stage) slice that it has rows of, and leaves the others. `folder` holds the slices as partitions of
`rows`, and in `epochs` which deliveries of which stream are in. A delivery is noted after its slices are written: one that was cut
off comes again and writes the same slices, one that comes again after it was noted changes nothing. Slices are replaced one
after another, so a reader may see a delivery in part. One writer at a time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessella.operators.retrieval import content_id
from tessella.sources.curate import first_per_key

BY = ("db", "stage")


def examples(rows: DataFrame, stages: tuple[str, ...] | None = None) -> DataFrame:
    """rows (db, stage, question, …) ready for the bank: db in lower case, the question trimmed, an id of the three; without blank ones,
    and of the named stages only."""
    out = rows.withColumns({"db": F.lower(F.trim("db")), "question": F.trim("question")})
    out = out.where("db <> '' and trim(stage) <> '' and question <> ''")
    out = out.where(F.col("stage").isin(*stages)) if stages is not None else out
    return out.withColumn("id", content_id("db", "stage", "question"))


def one_per_id(rows: DataFrame) -> DataFrame:
    """Of the rows of one id the first in the order of all columns."""
    return first_per_key(rows, ["id"], [F.asc_nulls_last(c) for c in sorted(rows.columns)])


def replace(fresh: DataFrame, folder: str) -> None:
    """Writes the slices of fresh (db, stage, id, …) in place of those in the folder. A slice goes to few files, a large one to several tasks."""
    dealt = fresh.sparkSession.sql("select /*+ REBALANCE(db, stage) */ * from {rows}", rows=one_per_id(fresh))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BY).parquet(f"{folder}/rows")


def read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def last_epoch(spark: SparkSession, folder: str, stream: str) -> int:
    """The last delivery of the stream that is in, -1 if none is."""
    try:
        noted = spark.read.schema("stream string, epoch long").parquet(f"{folder}/epochs")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    return noted.where(F.col("stream") == stream).agg(F.coalesce(F.max("epoch"), F.lit(-1)).alias("n")).first()["n"]


def note(spark: SparkSession, folder: str, stream: str, epoch: int) -> None:
    spark.createDataFrame([(stream, epoch)], "stream string, epoch long").coalesce(1).write.mode("append").parquet(f"{folder}/epochs")


def deliver(fresh: DataFrame, folder: str, stream: str, epoch: int) -> bool:
    """Takes a delivery unless it, or a later one of its stream, is in; whether it did."""
    spark = fresh.sparkSession
    if epoch <= last_epoch(spark, folder, stream):
        return False
    replace(fresh, folder)
    note(spark, folder, stream, epoch)
    return True


def feed(fresh: DataFrame, folder: str, stream: str, state: str) -> StreamingQuery:
    """Takes what the stream's source has now, each batch as a delivery, and ends. `stream` names the stream's state: a new state folder
    counts its batches anew and needs a new name."""
    writer = fresh.writeStream.foreachBatch(lambda batch, epoch: deliver(batch, folder, stream, epoch))
    return writer.option("checkpointLocation", state).trigger(availableNow=True).start()
