"""Period snapshots and sessions over the user events."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumikata.operators import sequences as s
from kumikata.plans.runtime import table
from kumikata.queries.seq import _SMOOTH
from kumikata.sources.views import EV, events
from kumikata.streaming import snapshots as n


def _told(spark, d, cadence):
    out = n.snapshots(table(spark, d, "events"), cadence, "user_id", "ts", "value")
    return out.withColumn("total", F.round("total", 4)).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")})


def _sessions(spark, d):
    out = n.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("start", "end")})


def _hourly(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_format(F.window("ts", "1 hour")["start"], "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type").agg(F.count("*").alias("events"), F.round(F.avg("value"), 5).alias("mean"))


QUERIES = {
    "daily_snapshots": lambda spark, d: _told(spark, d, "daily"),
    "weekly_snapshots": lambda spark, d: _told(spark, d, "weekly"),
    "session_windows": _sessions,
    "snapshot_prune": lambda spark, d: n.keep_newest(_told(spark, d, "daily"), "user_id", 3).select("user_id", "start", "events"),
    "hourly_series": _hourly,
    "position_segments": lambda spark, d: s.segments(s.smooth(events(spark, d), "match_id", "i", "type").withColumn("c", F.when(F.col("ok"), 1.0).otherwise(0.5)), "match_id", "i", "smoothed", 1, "c").withColumn("confidence", F.round("confidence", 6)).drop("segment"),
}
_D = "SELECT user_id, 'daily' AS cadence, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS events, round(sum(value), 4) AS total, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL"
ORACLES = {
    "daily_snapshots": _D,
    "weekly_snapshots": "SELECT user_id, 'weekly' AS cadence, strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('week', ts) + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS events, round(sum(value), 4) AS total, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL",
    "session_windows": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS \"end\", count(*) AS events FROM s GROUP BY user_id, k",
    "snapshot_prune": f"SELECT user_id, start, events FROM ({_D}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start DESC) <= 3",
    "hourly_series": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events, round(avg(value), 5) AS mean FROM events GROUP BY 1, 2",
    "position_segments": f"WITH {EV}, {_SMOOTH}, g AS (SELECT *, sum(CASE WHEN p = smoothed THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY i) AS seg FROM (SELECT *, lag(smoothed) OVER (PARTITION BY match_id ORDER BY i) AS p FROM sm)) SELECT g.match_id, smoothed, min(g.i)::INT AS first, max(g.i)::INT AS last, count(*) AS frames, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END), 6) AS confidence FROM g JOIN ev ON ev.match_id = g.match_id AND ev.i = g.i GROUP BY g.match_id, seg, smoothed",
}
