"""Feedback streams (group L): streams are drained and compared with SQL over the same events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.operators.lineage import shared_folder
from tessella.streaming import bank as B
from tessella.streaming import feedback as S

from .registry import query

VOTES = "votes as (select user_id as session, 'db' as db, json_extract_string(props, '$.k') as query, case event_type when 'purchase' then 'up' else 'down' end as verdict, ts from events where event_type in ('purchase', 'error'))"
#: A judge agrees with votes up on values of 50 and more, and with votes down on the others.
JUDGED = f"""{VOTES}, judged as (select user_id as session, (event_type = 'purchase') = (value >= 50) as correct, ts from events where event_type in ('purchase', 'error'))"""
TRUST = f"""{JUDGED}, s as (select session, count(*) filter (where correct) as correct, count(*) as total from judged group by 1),
tr as (select *, round(case when total >= 5 and correct / total < 0.3 then 0.1 when total >= 20 then least(1.0, 0.3 + 0.7 * correct / total) else 0.3 + 0.4 * correct / total end, 6) as trust from s)"""


def lives(gap: str) -> str:
    """lives: the first and last vote of each (db, query) between gaps of that length."""
    return f"""g as (select *, case when ts - lag(ts) over w <= interval '{gap}' then 0 else 1 end as new from votes window w as (partition by db, query order by ts)),
    i as (select *, sum(new) over (partition by db, query order by ts rows unbounded preceding) as n from g),
    lives as (select db, query, min(ts) as first_ts, max(ts) as last_ts from i group by db, query, n)"""


def naive(df, name):
    return df.withColumn(name, F.col(name).cast("timestamp_ntz"))


def votes(t):
    schema = t.events.schema
    return S.votes(S.source(t.spark, f"{t.folder}/events.parquet*", schema))


@query("rate_limit", f"with {VOTES} select session, date_trunc('hour', ts) as hour, count(*) as n, greatest(count(*) - 20, 0) as rejected from votes group by all")
def _(t):
    return naive(S.drained(S.hourly(votes(t))), "hour")


@query("rate_limit_batch", "select user_id, date_trunc('hour', ts) as hour, count(*) as n, greatest(count(*) - 3, 0) as rejected from events group by all")
def _(t):
    return naive(S.hourly(t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", 3), "hour")


def judged(t):
    e = S.source(t.spark, f"{t.folder}/events.parquet*", t.events.schema).where("event_type in ('purchase', 'error')")
    return e.select(F.col("user_id").alias("session"), ((F.col("event_type") == "purchase") == (F.col("value") >= 50)).alias("correct"), F.col("ts").cast("timestamp").alias("ts"))


ADMITTED = f"with {VOTES} select session, query, verdict, ts from votes qualify row_number() over (partition by session, date_trunc('hour', ts) order by ts, session, db, query, verdict) <= 1"


@query("admitted", ADMITTED)
def _(t):
    return naive(S.admitted(S.votes(t.events), 1).select("session", "query", "verdict", "ts"), "ts")


@query("admitted_stream", ADMITTED)
def _(t):
    return naive(S.drained(S.admitted(votes(t), 1), "append").select("session", "query", "verdict", "ts"), "ts")


@query("first_seen", f"with {VOTES}, {lives('8 days')} select * from lives")
def _(t):
    return naive(naive(S.drained(S.first_seen(votes(t))), "first_ts"), "last_ts")


@query("first_seen_again", f"with {VOTES}, {lives('2 hours')} select * from lives")
def _(t):
    return naive(naive(S.first_seen(S.votes(t.events), "2 hours"), "first_ts"), "last_ts")


@query("trust", f"with {TRUST} select session, correct, total, trust from tr")
def _(t):
    return S.drained(S.session_trust(judged(t)))


@query(
    "promotion",
    f"""with {TRUST}, up as (select distinct v.db, v.query, v.session, coalesce(trust, 0.3) as trust from votes v left join tr using (session) where verdict = 'up'),
    {lives("8 days")}, f as (select db, query, max(first_ts) as first_ts from lives group by all)
    select up.db, up.query, count(*) as sessions, round(sum(trust), 4) as trust, min(first_ts) as first_ts from up join f using (db, query)
    where up.query not in (select (vec_id % 10)::varchar from embeddings a where exists (select 1 from embeddings b where b.vec_id % 10 = 3 and list_cosine_similarity(a.embedding, b.embedding) >= 0.92))
    group by up.db, up.query having count(*) >= 3 and round(sum(trust), 6) >= 2.0 and min(first_ts) <= timestamp '2024-01-20'""",
)
def _(t):
    batch = S.votes(t.events)
    trusts = S.session_trust(t.events.where("event_type in ('purchase', 'error')").select(F.col("user_id").alias("session"), ((F.col("event_type") == "purchase") == (F.col("value") >= 50)).alias("correct"), F.col("ts").cast("timestamp").alias("ts")))
    asked = t.embeddings.select(F.lit("db").alias("db"), (F.col("vec_id") % 10).cast("string").alias("query"), F.col("embedding").alias("v"))
    bank = t.embeddings.where("vec_id % 10 = 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return naive(S.promoted(batch, trusts, "2024-01-22 00:00:00", near=S.near_bank(asked, bank)), "first_ts")


@query("valid_votes", f"with {VOTES} select session, query, verdict, ts as ts from votes")
def _(t):
    return naive(S.drained(votes(t), "append").select("session", "query", "verdict", "ts"), "ts")


STORED = """select lower(p_brand) as db, p_type as stage, p_name as question, sha256(lower(p_brand) || chr(31) || p_type || chr(31) || p_name) as id, min(p_size) as answer, false as pin from part
    where (lower(p_brand), p_type) not in (select lower(p_brand), p_type from part where p_size > 45 and p_type = 'SMALL') group by all
    union all select lower(p_brand), p_type, p_name, sha256(lower(p_brand) || chr(31) || p_type || chr(31) || p_name), min(p_size), true from part where p_size > 45 and p_type = 'SMALL' group by all"""


@query("bank_stored", STORED)
def _(t):
    """Two streams feed the bank, the second with some larger parts only; both come a second time and change nothing."""
    folder = f"{shared_folder(t.spark)}/bank-{uuid.uuid4().hex}"
    parts = S.source(t.spark, f"{t.folder}/part.parquet*", t.part.schema)
    rows = parts.select(F.col("p_brand").alias("db"), F.col("p_type").alias("stage"), F.col("p_name").alias("question"), F.col("p_size").alias("answer"))
    first, second = rows.withColumn("pin", F.lit(False)), rows.where("answer > 45 and stage = 'SMALL'").withColumn("pin", F.lit(True))
    for turn in range(2):  # with new state, so that the same batches are delivered again
        for name, fresh in (("first", first), ("second", second)):
            B.feed(B.examples(fresh), folder, name, f"{folder}/state-{turn}-{name}").awaitTermination()
    return B.read(t.spark, folder, B.examples(second).schema)
