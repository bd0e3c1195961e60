"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from foreshock.sources.landing import EVENT_LEVEL, EVENT_TYPE, SIGNAL_TYPES, USERS_PER_STATION

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Output form: doubles to a common precision (six places, or ten digits when large), counts as BIGINT. Null, NaN and
    infinite values stay what they are."""

    def column(f: T.StructField) -> str:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            scale = f"pow(10D, floor(log10(abs({c}))) - 9)"
            return (
                f"CASE WHEN isnan({c}) OR abs({c}) = double('infinity') THEN {c} WHEN abs({c}) < 1e5D THEN floor({c} * 1e6D + 0.501D) / 1e6D "
                f"ELSE floor({c} / {scale} + 0.501D) * {scale} END AS {c}"
            )
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return f"CAST({c} AS BIGINT) AS {c}"
        return c

    return df.selectExpr(*[column(f) for f in df.schema.fields])


def sql_num(x: str) -> str:
    """The same output form in the checking SQL."""
    return (
        f"(CASE WHEN NOT isfinite(({x})::DOUBLE) THEN {x} WHEN abs({x}) < 1e5 THEN floor(({x})*1e6+0.501)/1e6 "
        f"ELSE floor(({x})/pow(10.0, floor(log10(abs({x})))-9)+0.501)*pow(10.0, floor(log10(abs({x})))-9) END)"
    )


def sql_out(body: str, keys: str, doubles: list[str]) -> str:
    """Wrap a SELECT so that its double columns come out in the common form."""
    cols = ", ".join(f'{sql_num(chr(34) + d + chr(34))} AS "{d}"' for d in doubles)
    return f"SELECT {keys}{', ' if keys and cols else ''}{cols} FROM ({body}) z"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _snap(x: str) -> str:
    return f"floor(({x})*1e6+0.501)/1e6"


_SIG = list(SIGNAL_TYPES)
_MEANS = ", ".join(
    f"{_snap(f'avg(CASE WHEN event_type = {kind!r} THEN value END)')} AS {s}" for s, kind in SIGNAL_TYPES.items()
)
_KINDS = ", ".join(repr(k) for k in SIGNAL_TYPES.values())
_PREV = "OVER (PARTITION BY station ORDER BY idx ROWS UNBOUNDED PRECEDING)"
_NEXT = "OVER (PARTITION BY station ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_SIDES = ", ".join(
    f"last_value(CASE WHEN {s} IS NOT NULL THEN idx END IGNORE NULLS) {_PREV} AS pi_{s}, "
    f"last_value({s} IGNORE NULLS) {_PREV} AS pv_{s}, "
    f"first_value(CASE WHEN {s} IS NOT NULL THEN idx END IGNORE NULLS) {_NEXT} AS ni_{s}, "
    f"first_value({s} IGNORE NULLS) {_NEXT} AS nv_{s}"
    for s in _SIG
)
_FILL = ", ".join(
    f"CASE WHEN pi_{s} = idx OR ni_{s} IS NULL THEN pv_{s} "
    f"ELSE pv_{s} + (nv_{s} - pv_{s}) * ((idx - pi_{s}) / (ni_{s} - pi_{s})) END AS {s}"
    for s in _SIG
)

# Shared steps of the checking SQL: readings, bins, grid, filled series, long series, windows, window rows.
BASE_SQL = f"""WITH ev AS (
  SELECT user_id // {USERS_PER_STATION} AS station, epoch_us(ts) AS us, epoch_us(ts) // 600000000 AS idx,
         event_type, value, event_id FROM events),
bins AS (SELECT station, idx, {_MEANS} FROM ev WHERE event_type IN ({_KINDS}) GROUP BY station, idx),
ext AS (SELECT station, min(idx) AS lo, max(idx) AS hi,
         greatest({", ".join(f"min(idx) FILTER ({s} IS NOT NULL)" for s in _SIG)}) AS t_all FROM bins GROUP BY station),
grid AS (SELECT g.station, g.idx, g.lo, g.hi, g.t_all, {", ".join(f"b.{s}" for s in _SIG)}
         FROM (SELECT station, lo, hi, t_all, unnest(generate_series(lo, hi)) AS idx FROM ext) g
         LEFT JOIN bins b ON b.station = g.station AND b.idx = g.idx),
sides AS (SELECT *, {_SIDES} FROM grid),
filled AS (SELECT station, idx, lo, hi, t_all, {_FILL} FROM sides),
series AS (SELECT station, idx, t_all AS t0, hi AS t1, {", ".join(f"{_snap(s)} AS {s}" for s in _SIG)}
           FROM filled WHERE idx >= t_all),
long AS ({" UNION ALL ".join(f"SELECT station, t0, t1, idx, '{s}' AS stream, {s} AS x FROM series" for s in _SIG)}),
marks AS (SELECT station, us AS te_us FROM ev WHERE event_type = '{EVENT_TYPE}' AND value >= {EVENT_LEVEL}),
win AS (SELECT station, k, t0 + 288 + k * 72 AS e, (t0 + 288 + k * 72) * 600 AS win_end FROM
        (SELECT station, t0, unnest(generate_series(0, (t1 - t0 - 288) // 72 - 1)) AS k
         FROM (SELECT DISTINCT station, t0, t1 FROM series))),
wx AS (SELECT w.station, w.k, w.e, w.win_end, s.stream, s.idx - (w.e - 288) AS pos, s.x
       FROM win w JOIN long s ON s.station = w.station AND s.idx >= w.e - 288 AND s.idx < w.e),
lab AS (SELECT w.station, w.k, w.e, w.win_end,
        coalesce(max(CASE WHEN m.te_us > w.win_end * 1000000 AND m.te_us < (w.win_end + 172800) * 1000000
                     THEN 1.0 ELSE 0.0 END), 0.0) AS label
        FROM win w LEFT JOIN marks m ON m.station = w.station GROUP BY ALL)
"""


def sql(rest: str, body: str | None = None) -> str:
    """Checking SQL: the shared steps, more steps (optional), and the final SELECT."""
    if body is None:
        return BASE_SQL + rest
    return BASE_SQL + ", " + rest + "\n" + body
