"""Queries of the streaming jobs, over the events table as a file stream that is read to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import bindings as B
from ..sources.settled import shared_dir
from ..streaming import feeds as S
from .registry import register


def _place(spark) -> str:
    return f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"


def _run(spark, start, read):
    at = _place(spark)
    query = start(f"{at}/out", f"{at}/checkpoint")
    query.awaitTermination()
    return read(f"{at}/out")


def _files(spark):
    return lambda p: spark.read.parquet(p)


@register("apply_change_feed", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def _(spark, d):
    s = S.read_events(spark, d)
    return _run(spark, lambda p, c: S.apply_change_feed(s, p, c, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", ["user_id", "ts", "event_id", "value"]), lambda p: S.latest_state(spark, p, S.newest(["user_id"], ["ts", "event_id"]))).drop("ts")


@register("presence", "SELECT document_id, user_id, event_id FROM (SELECT *, user_id % 20 AS document_id, row_number() OVER (PARTITION BY user_id % 20, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def _(spark, d):
    s = S.read_events(spark, d).withColumn("document_id", F.col("user_id") % 20)
    return _run(spark, lambda p, c: S.presence(s, p, c), lambda p: S.present(spark, p)).select("document_id", "user_id", "event_id")


@register("still_present", "SELECT document_id, user_id, event_id FROM (SELECT *, user_id % 20 AS document_id, row_number() OVER (PARTITION BY user_id % 20, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def _(spark, d):
    s = S.read_events(spark, d).withColumn("document_id", F.col("user_id") % 20)
    (now,) = B.read(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()
    return S.still_present(_run(spark, lambda p, c: S.presence(s, p, c), lambda p: S.present(spark, p)), F.lit(now), "3 days").select("document_id", "user_id", "event_id")


@register("activity_stream", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 30")
def _(spark, d):
    s = S.read_events(spark, d)
    return _run(spark, lambda p, c: S.activity_stream(s, p, c), lambda p: S.recent(spark, p)).select("event_id", "user_id", "event_type")


@register("incremental_index", "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1) SELECT user_id AS section_id, term, count(*) AS tf FROM (SELECT user_id, unnest(regexp_extract_all(event_type || ' ' || props, '[a-z0-9]+')) AS term FROM l) GROUP BY 1, 2")
def _(spark, d):
    s = S.read_events(spark, d)
    return _run(spark, lambda p, c: S.incremental_index(s, p, c), lambda p: S.indexed(spark, p)).select("section_id", "term", "tf")


@register("snapshot_plus_increments", "SELECT 's' || n_nationkey AS subscriber, user_id, event_id, event_type FROM events JOIN nation ON user_id % 25 = n_nationkey")
def _(spark, d):
    s = S.read_events(spark, d)
    teams = B.read(spark, d, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("subscriber"), "n_nationkey")
    visible = B.read(spark, d, "events").select("user_id").distinct().join(teams, F.col("user_id") % 25 == F.col("n_nationkey")).select("subscriber", "user_id")
    return _run(spark, lambda p, c: S.snapshot_plus_increments(s, visible, p, c), _files(spark))


@register("cache_invalidation_keys", "SELECT DISTINCT unnest(['published', 'document-' || user_id]) AS tag FROM events WHERE event_type = 'purchase'")
def _(spark, d):
    s = S.read_events(spark, d)
    return _run(spark, lambda p, c: S.cache_invalidation_keys(s, p, c), _files(spark))


@register("debounce", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g),
  s AS (SELECT user_id, run, max(ts) AS z, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS edits FROM r GROUP BY 1, 2) SELECT user_id, event_id, edits FROM s WHERE z + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)""")
def _(spark, d):
    s = S.read_events(spark, d)
    return _run(spark, lambda p, c: S.debounce(s, p, c), _files(spark))


#: Each user's events in time, folded one after the other; those of type error are rows moved by somebody else.
@register("fold_edits", """WITH RECURSIVE e AS (
    SELECT user_id AS section_id, event_id, event_type = 'error' AS moved, CASE WHEN event_type = 'error' THEN props ELSE event_type END AS content, epoch_us(ts) AS us,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  f AS (
    SELECT section_id, 0 AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS outcome, NULL::VARCHAR AS content, NULL::BIGINT AS at, NULL::BIGINT AS seen FROM (SELECT DISTINCT section_id FROM e)
    UNION ALL SELECT f.section_id, e.n, e.event_id,
      CASE WHEN e.moved OR e.content = f.content THEN NULL WHEN f.seen IS DISTINCT FROM f.at THEN 'row' ELSE 'written' END,
      CASE WHEN e.moved OR e.content = f.content THEN e.content WHEN f.seen IS DISTINCT FROM f.at THEN f.content ELSE e.content END,
      CASE WHEN e.moved THEN e.us WHEN e.content = f.content OR f.seen IS DISTINCT FROM f.at THEN f.at ELSE e.us END,
      CASE WHEN e.moved THEN f.seen WHEN e.content = f.content OR f.seen IS DISTINCT FROM f.at THEN f.at ELSE e.us END
    FROM f JOIN e ON e.section_id = f.section_id AND e.n = f.n + 1)
  SELECT section_id, event_id, outcome, content FROM f WHERE outcome IS NOT NULL""")
def _(spark, d):
    moved = F.col("event_type") == "error"
    s = S.read_events(spark, d).select(F.col("user_id").alias("section_id"), "event_id", "ts", moved.alias("moved"), F.when(moved, F.col("props")).otherwise(F.col("event_type")).alias("content"))
    return _run(spark, lambda p, c: S.fold_edits(s, p, c), _files(spark))


@register("visits", """WITH e AS (SELECT *, user_id % 20 AS document_id, epoch_ms(ts) AS ms FROM events),
  g AS (SELECT *, CASE WHEN lag(ms) OVER w IS NULL OR ms - lag(ms) OVER w > 1800000 OR lag(event_type) OVER w = 'error' THEN 1 ELSE 0 END AS new
    FROM e WINDOW w AS (PARTITION BY document_id, user_id ORDER BY ms, event_id)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY document_id, user_id ORDER BY ms, event_id) AS visit FROM g),
  v AS (SELECT document_id, user_id, visit, arg_min(event_id, (ms, event_id)) AS event_id, count(*) AS signs, max(ms) AS last, arg_max(event_type, (ms, event_id)) = 'error' AS gone,
    max(visit) OVER (PARTITION BY document_id, user_id) = visit AS final FROM r GROUP BY 1, 2, 3)
  SELECT document_id, user_id, event_id, signs, CASE WHEN gone THEN 'left' ELSE 'silence' END AS ended_by FROM v
  WHERE gone OR NOT final OR last + 1800000 < (SELECT epoch_ms(max(ts)) FROM events) - 60000""")
def _(spark, d):
    s = S.read_events(spark, d).withColumn("document_id", F.col("user_id") % 20)
    return _run(spark, lambda p, c: S.visits(s, p, c), _files(spark))
