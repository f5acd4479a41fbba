"""Feedback events as a stream: validation, rate limits, first votes, trust, promotion.

The same functions serve batch and stream; `drained` runs a stream over what is there and stops."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.lineage import shared_folder
from tessella.operators.retrieval import cosine_top_k

LIMIT, WINDOW, LATE = 20, "1 hour", "2 hours"
#: States that the counts of sessions and hours are dealt to; votes of a batch meet in as many groups.
BUCKETS = 1024
#: How long first votes and judged votes are remembered after the last one.
FIRST_LIFE, TRUST_LIFE = "8 days", "90 days"


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def votes(events: DataFrame) -> DataFrame:
    """(session, db, query, verdict, ts) of events: purchases are up, errors down, the rest no votes."""
    rows = events.select(
        F.col("user_id").alias("session"), F.lit("db").alias("db"), F.get_json_object("props", "$.k").alias("query"),
        F.when(F.col("event_type") == "purchase", "up").when(F.col("event_type") == "error", "down").alias("verdict"), F.col("ts").cast("timestamp").alias("ts"),
    )
    return valid(rows)


def valid(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("verdict").isin("up", "down") & (F.trim("query") != "") & (F.trim("db") != ""))


def hourly(rows: DataFrame, key: str = "session", limit: int = LIMIT) -> DataFrame:
    """(key, hour, n, rejected) by tumbling hours; on a stream, late rows beyond the watermark are left out."""
    rows = rows.withWatermark("ts", LATE) if rows.isStreaming else rows
    out = rows.groupBy(F.window("ts", WINDOW), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("window.start").alias("hour"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))


def admitted(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Each session's first votes of an hour, up to the limit; the rest are rejected. On a stream the counts of an hour are
    state, given up once the watermark has passed it, and votes of one batch are taken in order of time. Counts are dealt
    to states by buckets: one for each session and hour would cost a call of Python for every few votes."""
    order = ["ts", *[c for c in rows.columns if c != "ts"]]
    if not rows.isStreaming:
        w = Window.partitionBy("session", F.date_trunc("hour", "ts")).orderBy(*order)
        return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")

    def first(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        passed = state.getCurrentWatermarkMs() // 1000 - 3600
        taken = {(s, h): n for s, h, n in zip(*state.get) if h > passed} if state.exists else {}
        votes, fits = pd.concat(list(batches)).sort_values(order, kind="stable"), []
        for one in zip(votes["session"].astype(object).where(votes["session"].notna(), None), votes["__hour"].tolist()):
            n = taken.get(one, 0)
            fits.append(n < limit)
            taken[one] = min(n + 1, limit)
        state.update((*[list(x) for x in zip(*taken)], list(taken.values())))
        state.setTimeoutTimestamp(max(max(h for _, h in taken) * 1000 + 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield votes[columns][fits]

    columns = rows.columns
    hour = F.coalesce(F.unix_timestamp(F.date_trunc("hour", "ts")), F.lit(0))
    bucket = F.pmod(F.xxhash64("session", hour), F.lit(BUCKETS)).cast("int")
    bucket = F.when(F.col("session").isNull(), -1 - bucket).otherwise(bucket)  # pandas makes floats of numbers beside nulls
    dealt = rows.withWatermark("ts", LATE).withColumns({"__bucket": bucket, "__hour": hour})
    counts = f"sessions array<{dict(rows.dtypes)['session']}>, hours array<long>, taken array<int>"
    return dealt.groupBy("__bucket").applyInPandasWithState(first, rows.schema, counts, "append", "EventTimeTimeout")


def first_seen(rows: DataFrame, life: str = FIRST_LIFE) -> DataFrame:
    """(db, query, first_ts, last_ts): the first vote, forgotten once `life` has gone by without another; a row for each time."""
    rows = rows.withWatermark("ts", LATE) if rows.isStreaming else rows
    lives = rows.groupBy("db", "query", F.session_window("ts", life)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return lives.select("db", "query", "first_ts", "last_ts")


def trust(correct: Column, total: Column) -> Column:
    """Few correct after five votes 0.1; from twenty votes up to 1; in between less. No votes count as one."""
    n = F.when(total.isNull() | (total == 0), 1).otherwise(total)
    r = F.coalesce(correct, F.lit(0)) / n
    return F.when((n >= 5) & (r < 0.3), 0.1).when(n >= 20, F.least(F.lit(1.0), 0.3 + 0.7 * r)).otherwise(0.3 + 0.4 * r)


def session_trust(judged: DataFrame, now=None, life: str = TRUST_LIFE) -> DataFrame:
    """(session, correct, total, trust) from judged votes (session, correct boolean, ts): whether a judge confirmed them,
    whatever they said. What is older than a gap of `life` without a judged vote is forgotten, all of it by `now` if the
    last one is."""
    rows = judged.withWatermark("ts", LATE) if judged.isStreaming else judged
    lives = rows.groupBy("session", F.session_window("ts", life).alias("w")).agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    lives = lives.where(F.col("w.end") > F.lit(now).cast("timestamp")) if now is not None else lives
    last = lives.groupBy("session").agg(F.max(F.struct("w.end", "correct", "total")).alias("x")) if not judged.isStreaming else lives.select("session", F.struct("w.end", "correct", "total").alias("x"))
    return last.select("session", "x.correct", "x.total", F.round(trust(F.col("x.correct"), F.col("x.total")), 6).alias("trust"))


def promoted(rows: DataFrame, trusts: DataFrame, now, *, sessions: int = 3, least_trust: float = 2.0, hours: int = 48, near: DataFrame | None = None, life: str = FIRST_LIFE) -> DataFrame:
    """(db, query) with votes up from enough sessions, enough trust together (sessions that nobody judged have that of none),
    long enough since the first vote that is remembered, and not among the near duplicates of what is in the bank (db, query)."""
    up = rows.where("verdict = 'up'").groupBy("db", "query", "session").agg(F.min("ts").alias("ts")).join(trusts.select("session", "trust"), "session", "left")
    weight = F.coalesce("trust", F.round(trust(F.lit(0), F.lit(1)), 6))
    sums = up.groupBy("db", "query").agg(F.count("*").alias("sessions"), F.sum(weight).alias("trust"))
    first = first_seen(rows, life).groupBy("db", "query").agg(F.max("first_ts").alias("first_ts"))
    old = F.col("first_ts") <= F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours")
    out = sums.join(first, ["db", "query"]).where((F.col("sessions") >= sessions) & (F.round("trust", 6) >= least_trust) & old).withColumn("trust", F.round("trust", 4))
    return out.join(near.select("db", "query").distinct(), ["db", "query"], "left_anti") if near is not None else out


def near_bank(candidates: DataFrame, bank: DataFrame, least: float = 0.92) -> DataFrame:
    """(db, query) of the candidates (db, query, v) that come as near as that to a vector of the bank (id, v)."""
    asked = candidates.select(F.concat_ws("\x1f", "db", "query").alias("qid"), F.col("v").alias("q"), "db", "query")
    hit = cosine_top_k(asked.select("qid", "q"), bank, 1, least=least)
    return asked.join(hit.select("qid"), "qid", "left_semi").select("db", "query")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The stream's result over all that its source has now, as a table of the last state."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/rows")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
