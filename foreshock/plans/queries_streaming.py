"""Queries that run as streams over the given tables until all rows are processed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foreshock.config import Geometry
from foreshock.plans.catalog import query, sql, sql_out
from foreshock.plans.queries_alerts import RULES, _rule_sql, rules
from foreshock.sources import landing
from foreshock.sources.tables import work_dir
from foreshock.streaming import online

GEOM = Geometry(2.0, 0.75, 2.0)
LEVEL, GAP = 100.0, 7200
STATS = ["mean", "standard_deviation", "maximum", "minimum"]


def _folder(spark) -> str:
    return f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"


def _signal_stream(spark, sf_dir):
    names = ", ".join(f"'{kind}', '{signal}'" for signal, kind in landing.SIGNAL_TYPES.items())
    rows = online.reading_stream(spark, sf_dir, "events.parquet")
    return rows.filter(F.col("event_type").isin(*landing.SIGNAL_TYPES.values())).selectExpr(
        "station", "ts", f"map({names})[event_type] AS stream", "value AS x"
    )


@query(
    "stream_ingest",
    sql("SELECT station, idx, event_type, arg_max(value, event_id) AS value FROM ev GROUP BY station, idx, event_type"),
)
def stream_ingest(spark, sf_dir):
    base, keys = _folder(spark), ("station", "idx", "event_type")
    rows = online.reading_stream(spark, sf_dir, "events.parquet").select("station", "idx", "event_type", "value", "event_id")
    online.drain_batches(rows, online.ingest_step(f"{base}/out", keys, "event_id"), f"{base}/checkpoint")
    return online.read_ingested(spark, f"{base}/out", keys).drop("event_id")


# Emitted are the windows that end no later than the watermark, one day before the last reading.
_STREAM_WIN = f"""sig AS (SELECT station, us, CASE event_type {" ".join(f"WHEN '{k}' THEN '{s}'" for s, k in landing.SIGNAL_TYPES.items())} END AS stream, value AS x
   FROM ev WHERE event_type IN ({", ".join(f"'{k}'" for k in landing.SIGNAL_TYPES.values())})),
slide AS (SELECT station, stream, (us // 43200000000 + g.h) * 43200 AS win_end, x FROM sig, (SELECT unnest([1, 2, 3, 4]) AS h) g),
sstat AS (SELECT station, stream, win_end, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS standard_deviation, max(x) AS maximum, min(x) AS minimum
   FROM slide GROUP BY ALL HAVING win_end * 1000000 <= (SELECT max(us) - 86400000000 FROM sig))"""


@query(
    "stream_windows",
    sql(_STREAM_WIN, sql_out("SELECT station, stream, win_end, n, mean, standard_deviation, maximum, minimum FROM sstat", "station, stream, win_end, n", STATS)),
)
def stream_windows(spark, sf_dir):
    base = _folder(spark)
    stats = online.window_stats(_signal_stream(spark, sf_dir), GEOM)
    online.drain(stats, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stats.schema).parquet(f"{base}/out")


@query(
    "stream_scores",
    sql(
        _STREAM_WIN
        + f""", smean AS (SELECT station, stream, win_end, mean AS value FROM sstat), svotes AS ({_rule_sql("smean")})""",
        sql_out(
            f"SELECT station, win_end, CASE WHEN count(*) = {RULES} THEN avg(pred) ELSE -1 END AS consensus FROM svotes GROUP BY station, win_end",
            "station, win_end",
            ["consensus"],
        ),
    ),
)
def stream_scores(spark, sf_dir):
    base = _folder(spark)
    stats = online.window_stats(_signal_stream(spark, sf_dir), GEOM).drop("standard_deviation", "maximum", "minimum")
    online.drain_batches(stats, online.score_step(rules(spark), RULES, f"{base}/out"), f"{base}/checkpoint")
    scored = spark.read.parquet(f"{base}/out").select("station", "win_end", "consensus")
    return scored.fillna(-1.0, ["consensus"])


@query(
    "stream_sessions",
    sql(
        f"""hot AS (SELECT station, us FROM ev WHERE value > {LEVEL}),
        runs AS (SELECT *, sum(fresh) OVER (PARTITION BY station ORDER BY us) AS island FROM (
          SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY station ORDER BY us) <= {GAP * 1_000_000} THEN 0 ELSE 1 END AS fresh FROM hot))""",
        f"""SELECT station, min(us) AS start_us, max(us) + {GAP * 1_000_000} AS stop_us, count(*) AS n FROM runs GROUP BY station, island
            HAVING max(us) + {GAP * 1_000_000} <= (SELECT max(us) - 86400000000 FROM hot)""",
    ),
)
def stream_sessions(spark, sf_dir):
    base = _folder(spark)
    hot = online.reading_stream(spark, sf_dir, "events.parquet").filter(F.col("value") > LEVEL).select("station", "ts")
    sessions = online.alert_sessions(hot, GAP)
    online.drain(sessions, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(sessions.schema).parquet(f"{base}/out")
