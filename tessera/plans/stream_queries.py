"""Streams over the tables, drained: what the watermark has passed in the end is the result.

The allowed lateness is none, so of the newest millisecond nothing is passed on but what the watermark, in whole milliseconds, has reached.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import Registry
from tessera.sources import views as V
from tessera.streaming import stateful

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_EVENTS = """WITH e AS (SELECT user_id AS src, event_id AS id, epoch_us(ts) AS us FROM events),
      p AS (SELECT * FROM e WHERE us <= (SELECT max(us) // 1000 * 1000 FROM e))"""
ALWAYS = 10**9


def events(spark, d):
    """The event table as a stream (src, ts, id), one source for each user; a pattern as path also takes a table that is one file."""
    schema = V.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").select(F.col("user_id").alias("src"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))


@query(
    "streamed_deltas",
    _EVENTS + """, o AS (SELECT *, us - lag(us) OVER w AS delta, coalesce(id < max(id) OVER (PARTITION BY src ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE)::BIGINT AS late FROM p WINDOW w AS (PARTITION BY src ORDER BY us, id))
      SELECT src, id, delta, sum(late) OVER (PARTITION BY src ORDER BY us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS overtaken FROM o""",
)
def streamed_deltas(spark, d):
    """Distances between a user's events in the order of time, and how many of those before were numbered after a later one."""
    return stateful.drained(spark, lambda: stateful.deltas(events(spark, d).withColumn("arrived", F.col("id")), late="0 seconds"), "deltas")


@query(
    "streamed_tracks",
    _EVENTS + """, k AS (SELECT src, id, us, list_distinct(list_transform(range(id % 5 % 4), lambda k: 'T' || ((id + k * 7) % 6)::VARCHAR)) AS ids FROM p),
      b AS (SELECT *, last_value(CASE WHEN len(ids) > 0 THEN ids END IGNORE NULLS) OVER w AS before FROM k WINDOW w AS (PARTITION BY src ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      t AS (SELECT src, id, us, list_contains(ids, track) AS here, last_value(CASE WHEN list_contains(ids, track) THEN us END IGNORE NULLS) OVER (PARTITION BY src, track ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
            FROM k, (SELECT 'T' || range::VARCHAR AS track FROM range(6))),
      m AS (SELECT id, max(us - seen) FILTER (NOT here) AS missing FROM t GROUP BY id)
      SELECT src, id, len(ids)::BIGINT AS n, len(ids) > 0 AND before IS NOT NULL AND NOT coalesce(list_has_any(ids, before), FALSE) AS reacquired, missing FROM b JOIN m USING (id)""",
)
def streamed_tracks(spark, d):
    """The faces of each user's samples: how many, whether none of the last ones is among them, the time that the longest missing one is away."""
    n = (F.col("id") % 5 % 4).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.lit("T"), ((F.col("id") + k * 7) % 6).cast("string"))))
    return stateful.drained(spark, lambda: stateful.tracks(events(spark, d).withColumn("tracks", ids), forget_seconds=ALWAYS, late="0 seconds"), "tracks")
