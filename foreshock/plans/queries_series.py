"""Queries: scans, time, ingest, grid, transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreshock.config import SIGNALS, Geometry
from foreshock.functions import times
from foreshock.functions.numbers import snap
from foreshock.operators import explore, grid, transforms
from foreshock.operators.windows import window_bounds
from foreshock.plans.catalog import query, sql, sql_out
from foreshock.sources import landing, tables, waveforms

BASES = list(SIGNALS)
T_I, T_F = "2024-01-08 00:00:00", "2024-01-22 12:00:00"
REFETCH, STORED_TO = "2024-01-18 00:00:00", "2024-01-20 06:00:00"
FALLBACK_MIN = 6


def _us(text: str) -> int:
    return int(times.to_seconds(text)) * 1_000_000


@query(
    "scan_range",
    sql(
        "SELECT station, us, event_type, value FROM ev "
        f"WHERE us >= {_us(T_I)} AND us < {_us(T_F)} AND event_type IN ('click', 'view')"
    ),
)
def scan_range(spark, sf_dir):
    events = landing.table(spark, sf_dir, "events", landing.EVENTS_SCHEMA)
    inside = (F.col("ts") >= F.lit(T_I).cast("timestamp_ntz")) & (F.col("ts") < F.lit(T_F).cast("timestamp_ntz"))
    wanted = events.filter(inside & F.col("event_type").isin("click", "view"))
    return landing.as_readings(wanted).select("station", "us", "event_type", "value")


@query("series_range", sql("SELECT station, idx, rsam, dsar FROM series WHERE idx < t1"))
def series_range(spark, sf_dir):
    return tables.time_range(landing.series(spark, sf_dir)).select("station", "idx", "rsam", "dsar")


@query("data_extent", sql("SELECT station, min(us) AS first, max(us) AS last FROM ev GROUP BY station"))
def data_extent(spark, sf_dir):
    return grid.data_extent(landing.readings(spark, sf_dir), "us")


@query("event_list", sql("SELECT station, te_us // 1000000 * 1000000 AS te_us FROM marks"))
def event_list(spark, sf_dir):
    moment = F.timestamp_micros("te_us")
    lines = landing.marked_events(spark, sf_dir).select(
        "station", F.date_format(moment, "yyyy MM dd HH mm ss").alias("value")
    )
    return tables.parse_event_lines(lines)


@query(
    "parse_times",
    sql(
        """SELECT event_id, coalesce(CAST(epoch(CASE event_id % 4
             WHEN 0 THEN date_trunc('second', make_timestamp(us)) WHEN 1 THEN date_trunc('day', make_timestamp(us))
             WHEN 2 THEN date_trunc('second', make_timestamp(us)) END) AS BIGINT), -1) AS seconds FROM ev"""
    ),
)
def parse_times(spark, sf_dir):
    kind, ts = F.col("event_id") % 4, F.col("ts")
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 2, F.date_format(ts, "yyyy MM dd HH mm ss"))
        .otherwise(F.date_format(ts, "dd/MM/yyyy"))
    )
    return landing.readings(spark, sf_dir).select(
        "event_id", F.coalesce(F.unix_seconds(times.parse_time(text)), F.lit(-1)).alias("seconds")
    )


@query(
    "local_time",
    sql(
        """SELECT event_id, strftime(make_timestamp(us) + INTERVAL 13 HOUR, '%Y-%m-%d %H:%M:%S') AS local,
           strftime(date_trunc('day', make_timestamp(us)), '%Y-%m-%d') AS midnight,
           hour(make_timestamp(us)) // 2 * 2 AS two_hours,
           strftime(make_timestamp(us) + INTERVAL 13 HOUR, '%H:%M %d') AS tick FROM ev"""
    ),
)
def local_time(spark, sf_dir):
    local = times.local_time(F.col("ts"))
    return landing.readings(spark, sf_dir).select(
        "event_id",
        F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local"),
        F.date_format(F.date_trunc("DAY", "ts"), "yyyy-MM-dd").alias("midnight"),
        F.hour(times.floor_hours(F.col("ts"))).cast("bigint").alias("two_hours"),
        times.tick_label(local, "HH:mm dd").alias("tick"),
    )


@query(
    "clamp_range",
    sql(
        f"""SELECT station, first, (first + 599) // 600 AS e0,
            greatest((last - first) // 43200, 0) AS nw FROM (
            SELECT station, greatest((t0 + 288) * 600, {_us(T_I) // 10**6}) AS first,
                   least(t1 * 600, {_us("2030-01-01") // 10**6}) AS last
            FROM (SELECT DISTINCT station, t0, t1 FROM series))"""
    ),
)
def clamp_range(spark, sf_dir):
    first, e0, count = window_bounds(Geometry(), times.to_seconds(T_I), times.to_seconds("2030-01-01"))
    return grid_extent(landing.series(spark, sf_dir)).select(
        "station", first.cast("bigint").alias("first"), e0.cast("bigint").alias("e0"), count.alias("nw")
    )


def grid_extent(series):
    return series.groupBy("station").agg(F.max("t0").alias("t0"), F.max("t1").alias("t1"))


@query(
    "round_grid",
    sql(
        """SELECT event_id, s // 86400 * 86400 + CAST(round_even((s % 86400) / 600, 0) AS BIGINT) * 600 AS start_s
           FROM (SELECT event_id, us // 1000000 AS s FROM ev)"""
    ),
)
def round_grid(spark, sf_dir):
    seconds = F.unix_seconds("ts")
    return landing.readings(spark, sf_dir).select("event_id", times.nearest_grid(seconds).alias("start_s"))


@query(
    "dedup_last",
    sql("SELECT station, idx, event_type, arg_max(value, event_id) AS value FROM ev GROUP BY station, idx, event_type"),
)
def dedup_last(spark, sf_dir):
    rows = landing.readings(spark, sf_dir).select("station", "idx", "event_type", "value", "event_id")
    return grid.dedup_last(rows, ("station", "idx", "event_type"), "event_id").drop("event_id")


@query("grid_reindex", sql("SELECT station, idx, rsam, mf, hf, dsar FROM grid"))
def grid_reindex(spark, sf_dir):
    return grid.grid_reindex(landing.bins(spark, sf_dir)).select("station", "idx", *SIGNALS)


@query(
    "interpolate_linear",
    sql(sql_out("SELECT station, idx, rsam, mf, hf, dsar FROM filled", "station, idx", BASES)),
)
def interpolate_linear(spark, sf_dir):
    return grid.interpolate_linear(landing.bins(spark, sf_dir)).select("station", "idx", *SIGNALS)


_SMOOTH = """CASE WHEN (idx - {t0}) % 144 = 0 AND idx > {t0} AND (idx - {t0}) // 144 < ({t1} - {t0} + 1) // 144
     THEN 0.5 * (lag(dsar) OVER (PARTITION BY station ORDER BY idx) + lead(dsar) OVER (PARTITION BY station ORDER BY idx))
     ELSE dsar END AS dsar"""


@query(
    "midnight_smooth",
    sql(sql_out(f"SELECT station, idx, {_SMOOTH.format(t0='t0', t1='t1')} FROM series", "station, idx", ["dsar"])),
)
def midnight_smooth(spark, sf_dir):
    return grid.midnight_smooth(landing.series(spark, sf_dir)).select("station", "idx", "dsar")


def _merge_sql() -> str:
    kinds = landing.SIGNAL_TYPES
    stored = ", ".join(f"floor(avg(value) FILTER (event_type = '{k}')*1e6+0.501)/1e6 AS {s}" for s, k in kinds.items())
    fetched = ", ".join(f"max(value) FILTER (event_type = '{k}') AS {s}" for s, k in kinds.items())
    names = ", ".join(repr(k) for k in kinds.values())
    prev, nxt = "(PARTITION BY station ORDER BY idx ROWS UNBOUNDED PRECEDING)", (
        "(PARTITION BY station ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    )
    sides = ", ".join(
        f"last_value(CASE WHEN {s} IS NOT NULL THEN idx END IGNORE NULLS) OVER {prev} AS pi_{s}, "
        f"last_value({s} IGNORE NULLS) OVER {prev} AS pv_{s}, "
        f"first_value(CASE WHEN {s} IS NOT NULL THEN idx END IGNORE NULLS) OVER {nxt} AS ni_{s}, "
        f"first_value({s} IGNORE NULLS) OVER {nxt} AS nv_{s}"
        for s in SIGNALS
    )
    fill = ", ".join(
        f"CASE WHEN pi_{s} = idx OR ni_{s} IS NULL THEN pv_{s} "
        f"ELSE pv_{s} + (nv_{s} - pv_{s}) * ((idx - pi_{s}) / (ni_{s} - pi_{s})) END AS {s}"
        for s in SIGNALS
    )
    steps = f"""both_loads AS (
      SELECT station, idx, 0 AS seq, {stored} FROM ev
      WHERE event_type IN ({names}) AND us < {_us(STORED_TO)} GROUP BY station, idx
      UNION ALL SELECT station, idx, 1 AS seq, {fetched} FROM ev
      WHERE event_type IN ({names}) AND us >= {_us(REFETCH)} GROUP BY station, idx),
    latest AS (SELECT * FROM both_loads QUALIFY row_number() OVER (PARTITION BY station, idx ORDER BY seq DESC) = 1),
    span AS (SELECT station, min(idx) AS lo, max(idx) AS hi FROM latest GROUP BY station),
    dense AS (SELECT g.station, g.idx, g.lo, g.hi, {", ".join(f"l.{s}" for s in SIGNALS)}
      FROM (SELECT station, lo, hi, unnest(generate_series(lo, hi)) AS idx FROM span) g
      LEFT JOIN latest l ON l.station = g.station AND l.idx = g.idx),
    full_series AS (SELECT station, idx, lo, hi, {fill} FROM (SELECT *, {sides} FROM dense))"""
    body = f"SELECT station, idx, rsam, mf, hf, {_SMOOTH.format(t0='lo', t1='hi')} FROM full_series"
    return sql(steps, sql_out(body, "station, idx", BASES))


@query("ingest_merge", _merge_sql())
def ingest_merge(spark, sf_dir):
    rows = landing.readings(spark, sf_dir)
    stored = landing.binned(rows.filter(F.col("us") < _us(STORED_TO)))
    kinds = landing.SIGNAL_TYPES
    again = rows.filter((F.col("us") >= _us(REFETCH)) & F.col("event_type").isin(*kinds.values()))
    fetched = again.groupBy("station", "idx").agg(
        *[F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(s) for s, k in kinds.items()]
    )
    return tables.ingest_merge(stored, fetched).select("station", "idx", *SIGNALS)


@query(
    "source_fallback",
    sql(
        f"""held AS (SELECT station, us // 86400000000 AS day FROM ev WHERE event_type = 'click'
                     GROUP BY ALL HAVING count(*) >= {FALLBACK_MIN})""",
        """SELECT e.station, e.us // 86400000000 AS day, e.event_id, e.value,
             CASE WHEN e.event_type = 'click' THEN 'primary' ELSE 'fallback' END AS source
           FROM ev e LEFT JOIN held h ON h.station = e.station AND h.day = e.us // 86400000000
           WHERE (e.event_type = 'click' AND h.day IS NOT NULL) OR (e.event_type = 'view' AND h.day IS NULL)""",
    ),
)
def source_fallback(spark, sf_dir):
    rows = landing.readings(spark, sf_dir).select(
        "station", F.floor(F.col("us") / 86400000000).alias("day"), "event_id", "value", "event_type", F.lit(1).alias("samples")
    )
    one, two = (rows.filter(F.col("event_type") == k).drop("event_type") for k in ("click", "view"))
    return tables.with_fallback(one, two, FALLBACK_MIN).drop("samples")


@query(
    "year_panel",
    sql(
        """SELECT s.station, year(make_timestamp(s.idx * 600000000)) AS year, s.idx, s.rsam, s.dsar,
             (SELECT count(*) FROM marks m WHERE m.station = s.station AND m.te_us // 600000000 = s.idx) AS marks
           FROM series s"""
    ),
)
def year_panel(spark, sf_dir):
    panel = explore.year_panel(landing.series(spark, sf_dir), landing.marked_events(spark, sf_dir), ["rsam", "dsar"])
    return panel.select("station", "year", "idx", "rsam", "dsar", "marks")


@query(
    "transform_inv",
    sql(
        sql_out(
            "SELECT station, idx, " + ", ".join(f"1 / {s} AS inv_{s}" for s in SIGNALS) + " FROM series",
            "station, idx",
            [f"inv_{s}" for s in SIGNALS],
        )
    ),
)
def transform_inv(spark, sf_dir):
    return transforms.with_streams(landing.series(spark, sf_dir), [f"inv_{s}" for s in SIGNALS]).drop("t0", "t1")


@query(
    "transform_diff",
    sql(
        sql_out(
            "SELECT station, idx, "
            + ", ".join(
                f"coalesce({s} - lag({s}) OVER (PARTITION BY station ORDER BY idx), 0) AS diff_{s}" for s in SIGNALS
            )
            + " FROM series",
            "station, idx",
            [f"diff_{s}" for s in SIGNALS],
        )
    ),
)
def transform_diff(spark, sf_dir):
    return transforms.with_streams(landing.series(spark, sf_dir), [f"diff_{s}" for s in SIGNALS]).drop("t0", "t1")


@query(
    "transform_log",
    sql(
        sql_out(
            "SELECT station, idx, "
            + ", ".join(f"CASE WHEN {s} > 0 THEN log10({s}) END AS log_{s}" for s in SIGNALS)
            + " FROM series",
            "station, idx",
            [f"log_{s}" for s in SIGNALS],
        )
    ),
)
def transform_log(spark, sf_dir):
    return transforms.with_streams(landing.series(spark, sf_dir), [f"log_{s}" for s in SIGNALS]).drop("t0", "t1")


_NUTTALL = "(0.3635819 - 0.4891775 * cos(2*pi()*q/72) + 0.1365995 * cos(4*pi()*q/72) - 0.0106411 * cos(6*pi()*q/72))"


@query(
    "transform_stft",
    sql(
        f"""taper AS (SELECT q, w / sum(w) OVER () AS w FROM (SELECT q, {_NUTTALL} AS w FROM range(72) t(q))),
        turns AS (SELECT a.station, a.idx, {", ".join(
            f"sum(b.{s} * w * cos(2*pi()*{k}*q/72)) AS c{k}_{s}, sum(b.{s} * w * sin(2*pi()*{k}*q/72)) AS s{k}_{s}"
            for s in SIGNALS for k in (16, 17))}
          FROM series a JOIN series b ON b.station = a.station AND b.idx > a.idx - 72 AND b.idx <= a.idx
          JOIN taper t ON t.q = 71 - (a.idx - b.idx) GROUP BY a.station, a.idx)""",
        sql_out(
            "SELECT station, idx, "
            + ", ".join(
                f"(sqrt(c16_{s}*c16_{s} + s16_{s}*s16_{s}) + sqrt(c17_{s}*c17_{s} + s17_{s}*s17_{s})) / 2 AS stft_{s}"
                for s in SIGNALS
            )
            + " FROM turns",
            "station, idx",
            [f"stft_{s}" for s in SIGNALS],
        ),
    ),
)
def transform_stft(spark, sf_dir):
    return transforms.with_streams(landing.series(spark, sf_dir), [f"stft_{s}" for s in SIGNALS]).drop("t0", "t1")


def embedding_blocks(spark, sf_dir):
    """Embeddings read as waveform rows: one second of samples each, one station per label."""
    raw = landing.table(spark, sf_dir, "embeddings", "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    return raw.select(
        F.col("label").cast("bigint").alias("station"), F.col("vec_id").alias("start_s"), F.col("embedding").alias("samples")
    )


def island_blocks(spark, sf_dir):
    """The same with a gap of three seconds after every hundred, a thousand rows a station."""
    vec = F.col("start_s")
    return embedding_blocks(spark, sf_dir).select(
        F.floor(vec / 1000).alias("station"), (vec + 3 * F.floor(vec / 100)).alias("start_s"), "samples"
    )


@query(
    "block_mean_abs",
    "WITH s AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS p FROM embeddings) "
    + sql_out(
        "SELECT vec_id AS start_s, CAST(label AS BIGINT) AS station, p // 16 AS block, avg(abs(CAST(v AS DOUBLE))) * 1e9 AS mean_abs "
        "FROM s GROUP BY ALL",
        "start_s, station, block",
        ["mean_abs"],
    ),
)
def block_mean_abs(spark, sf_dir):
    means = waveforms.block_means(F.col("samples"), 16)
    return embedding_blocks(spark, sf_dir).select("start_s", "station", F.posexplode(means).alias("block", "mean_abs"))


def _impulse_sql(rate: float) -> str:
    """Impulse responses of the bands by their recursions, as reversed lists ``h`` by ``band``: a row per band and sample."""
    rows, size = [], 1 + waveforms.memory(rate)
    for name, band in waveforms.BANDS.items():
        gain, sections, _ = waveforms.band_pass_sections(*band, rate)
        rows.append(f"('{name}', {gain!r}::DOUBLE, " + ", ".join(f"{a1!r}::DOUBLE, {a2!r}::DOUBLE" for a1, a2 in sections) + ")")
    n = len(sections)
    names = ", ".join(f"a{k}, b{k}" for k in range(n))
    state = ", ".join(f"x{k}, u{k}, y{k}, v{k}" for k in range(n))  # inputs and outputs one and two samples ago
    zeros = ", ".join(["0::DOUBLE"] * (4 * n))
    inner = f"SELECT *, CASE WHEN t = -1 THEN gain ELSE 0 END AS i0 FROM imp WHERE t < {size - 1}"
    for k in range(n):
        inner = f"SELECT *, i{k} - u{k} - a{k} * y{k} - b{k} * v{k} AS i{k + 1} FROM ({inner})"
    moved = ", ".join(f"i{k}, x{k}, i{k + 1}, y{k}" for k in range(n))
    return f"""coef(band, gain, {names}) AS (VALUES {", ".join(rows)}),
imp(band, gain, {names}, t, {state}, out) AS (
  SELECT band, gain, {names}, -1::BIGINT, {zeros}, 0::DOUBLE FROM coef UNION ALL
  SELECT band, gain, {names}, t + 1, {moved}, i{n} FROM ({inner})),
resp AS (SELECT band, list(out ORDER BY t DESC) AS h FROM imp WHERE t >= 0 GROUP BY band)"""


_RATE, _SIZE = 64, 1 + waveforms.memory(64.0)
_BAND_SQL = f"""WITH RECURSIVE {_impulse_sql(64.0)},
rows_ AS (SELECT vec_id // 1000 AS station, vec_id + 3 * (vec_id // 100) AS start_s, embedding FROM embeddings),
ends_ AS (SELECT *, start_s // 86400 AS day, lag(start_s + len(embedding) / {_RATE}) OVER (PARTITION BY station, start_s // 86400 ORDER BY start_s) AS until FROM rows_),
isl AS (SELECT *, last_value(CASE WHEN until IS NULL OR abs(start_s - until) > 0.5 / {_RATE} THEN start_s END IGNORE NULLS)
  OVER (PARTITION BY station, day ORDER BY start_s) AS island FROM ends_),
smp AS (SELECT station, island, start_s, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS q FROM isl),
steps AS (SELECT *, coalesce((v + lag(v) OVER w) / {2 * _RATE}, 0) AS grown, row_number() OVER w - 1 AS t FROM smp WINDOW w AS (PARTITION BY station, island ORDER BY start_s, q)),
areas AS (SELECT *, sum(grown) OVER (PARTITION BY station, island ORDER BY t) AS area FROM steps),
lists AS (SELECT station, island, list(v ORDER BY t) AS x, list(area - mean ORDER BY t) AS d
  FROM (SELECT *, avg(area) OVER (PARTITION BY station, island) AS mean FROM areas) GROUP BY station, island),
signals AS (SELECT station, island, 'v' AS kind, x FROM lists UNION ALL SELECT station, island, 'd', d FROM lists),
padded AS (SELECT station, island, kind, band, len(x) AS n, list_concat(list_transform(range({_SIZE - 1}), lambda z: 0::DOUBLE), x) AS x, h
  FROM signals, resp WHERE kind = 'v' OR band <> 'rsam'),
filtered AS (SELECT station, island, kind, band, t, list_dot_product(x[t + 1 : t + {_SIZE}], h) AS y
  FROM (SELECT *, unnest(range(n // {10 * _RATE} * {10 * _RATE})) AS t FROM padded)),
blocks AS (SELECT station, island, t // {10 * _RATE} AS pos, kind, band, avg(abs(y)) AS size FROM filtered GROUP BY ALL),
wide AS (SELECT station, island, pos, {", ".join(f"max(size) FILTER (kind = 'v' AND band = '{b}') * 1e9 AS {b}" for b in waveforms.BANDS)},
  max(size) FILTER (kind = 'd' AND band = 'mf') / max(size) FILTER (kind = 'd' AND band = 'hf') AS dsar FROM blocks GROUP BY ALL),
placed AS (SELECT *, (island // 86400 * 86400 + round_even((island % 86400) / 10.0, 0) * 10)::BIGINT // 10 + pos AS idx FROM wide)
"""


@query(
    "band_reduce",
    _BAND_SQL + sql_out(
        "SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY station, idx ORDER BY island) = 1", "station, idx", ["rsam", "mf", "hf", "dsar"]
    ),
)
def band_reduce(spark, sf_dir):
    """Band signals of every embedding station, at 64 samples a second in blocks of 10 seconds."""
    return waveforms.reduce_days(island_blocks(spark, sf_dir), rate=64.0, block_seconds=10)


@query(
    "band_ratio",
    sql(
        sql_out(
            "SELECT station, idx // 6 AS block, avg(abs(mf)) / avg(abs(hf)) AS ratio FROM series GROUP BY ALL",
            "station, block",
            ["ratio"],
        )
    ),
)
def band_ratio(spark, sf_dir):
    return waveforms.band_ratio(landing.series(spark, sf_dir), 6)
