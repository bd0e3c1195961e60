"""Queries: predictions, consensus, alerts, scores, exploration tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreshock.config import SIGNALS, Geometry
from foreshock.operators import alerts, consensus, evaluate, explore, features_agg, selection, store, trees
from foreshock.plans.catalog import query, sql, sql_num, sql_out, tidy
from foreshock.plans.queries_models import _FW, GEOM, features, labelled
from foreshock.sources import landing
from foreshock.sources.tables import cut_lineage

# A fixed rule set to vote with: model m looks at the window mean of stream m mod 4 and at one of ten levels.
RULES = 40
ALERT, SHADE = 0.6, 0.75
HIRES = Geometry(2.0, 0.75, 2.0).at_data_rate()


def rules(spark):
    names = ", ".join(f"'{s}__mean'" for s in SIGNALS)
    return spark.range(RULES).selectExpr(
        "id AS model_id", f"element_at(array({names}), CAST(id % 4 + 1 AS INT)) AS feature", "30D + (id div 4) * 4D AS threshold",
        "0D AS left_vote", "1D AS right_vote",
    ).transform(trees.stump_rules)


def means(spark, sf_dir, geom=GEOM):
    wide = features_agg.window_sums(landing.series(spark, sf_dir), geom, SIGNALS, ["mean"])
    return store.melt(tidy(wide))


def votes_of(spark, sf_dir, geom=GEOM):
    return trees.predict_stumps(means(spark, sf_dir, geom), rules(spark))


def consensus_of(spark, sf_dir, geom=GEOM):
    return consensus.consensus(votes_of(spark, sf_dir, geom), RULES)


def _rule_sql(source: str) -> str:
    return f"""SELECT m.model_id, w.station, w.win_end, (CASE WHEN w.value > 30 + (m.model_id // 4) * 4 THEN 1 ELSE 0 END)::DOUBLE AS pred
      FROM {source} w JOIN (SELECT unnest(range({RULES})) AS model_id) m
      ON w.stream = list_extract([{", ".join(f"'{s}'" for s in SIGNALS)}], m.model_id % 4 + 1)"""


_MEAN = f"mw AS (SELECT station, win_end, stream, {sql_num('v')} AS value FROM (SELECT station, win_end, stream, avg(x) AS v FROM wx GROUP BY ALL))"
_VOTES = f"{_MEAN}, votes AS ({_rule_sql('mw')})"
_CONS = f"""{_VOTES}, cons AS (SELECT station, win_end, avg(pred) AS consensus,
   (win_end - min(win_end) OVER (PARTITION BY station)) // 43200 AS i FROM votes GROUP BY station, win_end)"""


def _islands(source: str, test: str) -> str:
    """Alert intervals in SQL: split where exceedances are more than four windows apart."""
    part = "station, j" if "j" in source else "station"
    return f"""SELECT {part}, min(i) AS i0, max(i) + 4.0::DOUBLE AS i1 FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY {part} ORDER BY i) AS island FROM (
        SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY {part} ORDER BY i) <= 4 THEN 0 ELSE 1 END AS fresh
        FROM {source} WHERE {test})) GROUP BY {part}, island"""


_ALERTS = f"""{_CONS}, begun AS (SELECT station, min(win_end) AS t0, max(win_end) AS t1, count(*) AS n FROM cons GROUP BY station),
alerted AS (SELECT a.*, t0 + i0 * 43200 AS start, t0 + i1 * 43200 AS stop FROM ({_islands("cons", f"consensus > {ALERT}")}) a JOIN begun USING (station))"""


@query("predict_long", sql(_VOTES, "SELECT model_id, station, win_end, pred FROM votes"))
def predict_long(spark, sf_dir):
    return votes_of(spark, sf_dir)


@query("predict_missing", sql(_VOTES, "SELECT model_id, station, win_end FROM votes WHERE model_id % 3 = 0 OR win_end >= 1705700000"))
def predict_missing(spark, sf_dir):
    wanted = votes_of(spark, sf_dir)
    held = wanted.filter("model_id % 3 <> 0 AND win_end < 1705700000")
    return consensus.predict_missing(wanted, held)


@query(
    "model_set_check",
    sql(
        _VOTES,
        "SELECT max(model_id) AS last, count(*) AS n, count(*) FILTER (NOT fitted) AS unfitted, max(model_id) = count(*) - 1 AS gapless, "
        "count(*) FILTER (NOT fitted) = 0 AS complete FROM (SELECT model_id, max(pred) > 0 AS fitted FROM votes GROUP BY model_id)",
    ),
)
def model_set_check(spark, sf_dir):
    """The set is what voted; a model that never votes 1 counts as unfitted here."""
    votes = votes_of(spark, sf_dir)
    return consensus.model_set_check(votes, votes.filter("pred > 0"))


@query("consensus", sql(_CONS, sql_out("SELECT station, win_end, consensus FROM cons", "station, win_end", ["consensus"])))
def consensus_query(spark, sf_dir):
    return consensus_of(spark, sf_dir)


_HIRES = f"""hwin AS (SELECT station, t0 + 288 + k AS e FROM (SELECT station, t0, unnest(generate_series(0, t1 - t0 - 289)) AS k
   FROM (SELECT DISTINCT station, t0, t1 FROM series))),
hmean AS (SELECT station, win_end, stream, {sql_num('v')} AS value FROM (
  SELECT w.station, w.e * 600 AS win_end, s.stream, avg(s.x) AS v FROM hwin w JOIN long s
  ON s.station = w.station AND s.idx >= w.e - 288 AND s.idx < w.e GROUP BY ALL)),
hvotes AS ({_rule_sql('hmean')})"""


@query(
    "hires_consensus",
    sql(_HIRES, sql_out("SELECT station, win_end, avg(pred) AS consensus FROM hvotes GROUP BY station, win_end", "station, win_end", ["consensus"])),
)
def hires_consensus(spark, sf_dir):
    return consensus_of(spark, sf_dir, HIRES)


@query("alert_islands", sql(_ALERTS, "SELECT station, i0, i1, start, stop::DOUBLE AS stop FROM alerted"))
def alert_islands(spark, sf_dir):
    return alerts.alert_islands(consensus_of(spark, sf_dir), GEOM, ALERT)


@query(
    "alert_match",
    sql(
        _ALERTS,
        "SELECT m.station, m.te_us, coalesce(a.start, -1) AS start FROM marks m LEFT JOIN alerted a ON a.station = m.station "
        "AND m.te_us > a.start * 1000000 AND m.te_us <= a.stop * 1000000",
    ),
)
def alert_match(spark, sf_dir):
    found = alerts.alert_islands(consensus_of(spark, sf_dir), GEOM, ALERT)
    matched = alerts.alert_match(found, landing.marked_events(spark, sf_dir))
    return matched.withColumn("start", F.coalesce("start", F.lit(-1)))


_SWEEP = f"""{_CONS}, begun AS (SELECT station, min(win_end) AS t0, max(win_end) AS t1, count(*) AS n FROM cons GROUP BY station),
over_j AS (SELECT c.station, g.j, c.i, c.consensus FROM cons c, (SELECT unnest(range(1, 101)) AS j) g WHERE c.consensus > g.j / 100),
isl AS (SELECT a.*, t0 + i0 * 43200 AS start, t0 + i1 * 43200 AS stop FROM ({_islands("over_j", "true")}) a JOIN begun USING (station)),
agg AS (SELECT station, j, count(*) AS alerts, sum(i1 - i0) AS length FROM isl GROUP BY station, j),
times AS (SELECT station, te_us, count(*) AS m FROM marks GROUP BY station, te_us),
hit AS (SELECT i.station, i.j, i.start, m.te_us, m.m FROM isl i JOIN times m ON m.station = i.station
        AND m.te_us > i.start * 1000000 AND m.te_us <= i.stop * 1000000),
hagg AS (SELECT station, j, sum(m) AS hits, max(held) AS held FROM (SELECT DISTINCT h.station, h.j, te_us, m, held FROM hit h
  JOIN (SELECT station, j, count(DISTINCT start) AS held FROM hit GROUP BY station, j) n ON n.station = h.station AND n.j = h.j) GROUP BY station, j),
ev_n AS (SELECT station, count(*) AS events, max(te_us) AS last_te FROM marks GROUP BY station),
skip AS (SELECT i.station, i.j, 1 AS skipped FROM isl i JOIN ev_n e ON e.station = i.station
  WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.station = i.station AND h.j = i.j AND h.te_us = e.last_te)
  GROUP BY i.station, i.j, e.last_te HAVING max(i.start) * 1000000 > e.last_te),
conf AS (SELECT c.station, g.j, count(*) FILTER (c.consensus > g.j / 100 AND label > 0) AS tp, count(*) FILTER (c.consensus > g.j / 100 AND label <= 0) AS fp,
  count(*) FILTER (c.consensus <= g.j / 100 AND label > 0) AS fn, count(*) FILTER (c.consensus <= g.j / 100 AND label <= 0) AS tn
  FROM cons c JOIN lab l ON l.station = c.station AND l.win_end = c.win_end, (SELECT unnest(range(1, 101)) AS j) g GROUP BY c.station, g.j),
scores AS (SELECT b.station, f.j / 100 AS threshold,
   CASE WHEN a.alerts > 0 THEN a.alerts - coalesce(h.held, 0) - coalesce(s.skipped, 0) ELSE 0 END AS "FP",
   CASE WHEN a.alerts > 0 THEN coalesce(e.events, 0) - coalesce(h.hits, 0) ELSE coalesce(e.events, 0) END AS "FN",
   CASE WHEN a.alerts > 0 THEN coalesce(h.hits, 0) ELSE 0 END AS "TP",
   CASE WHEN a.alerts > 0 THEN CAST(trunc((b.n - a.length) / (a.length / a.alerts)) AS BIGINT) - (coalesce(e.events, 0) - coalesce(h.hits, 0)) ELSE 100000000 END AS "TN",
   CASE WHEN a.alerts > 0 THEN a.length * 43200 / (b.t1 - b.t0) ELSE 0 END AS alert_fraction,
   CASE WHEN a.alerts > 0 AND (f.tp + f.fp) * (f.tp + f.fn) * (f.tn + f.fp) * (f.tn + f.fn) > 0
     THEN (f.tp * f.tn - f.fp * f.fn) / sqrt((f.tp + f.fp)::DOUBLE * (f.tp + f.fn) * (f.tn + f.fp) * (f.tn + f.fn)) ELSE 0 END AS "MCC"
   FROM begun b JOIN conf f ON f.station = b.station LEFT JOIN agg a ON a.station = b.station AND a.j = f.j
   LEFT JOIN hagg h ON h.station = b.station AND h.j = f.j LEFT JOIN skip s ON s.station = b.station AND s.j = f.j
   LEFT JOIN ev_n e ON e.station = b.station
   UNION ALL SELECT b.station, 0, 100000000, 0, coalesce(e.events, 0), 1, 1, 0 FROM begun b LEFT JOIN ev_n e ON e.station = b.station)"""

_COUNTS = 'station, "FP"::BIGINT AS "FP", "FN"::BIGINT AS "FN", "TP"::BIGINT AS "TP", "TN"::BIGINT AS "TN"'


def _sweep(spark, sf_dir):
    return evaluate.threshold_sweep(
        consensus_of(spark, sf_dir), labelled(spark, sf_dir), landing.marked_events(spark, sf_dir), GEOM
    )


@query("threshold_sweep", sql(_SWEEP, sql_out("SELECT * FROM scores", _COUNTS, ["threshold", "alert_fraction", "MCC"])))
def threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query("alert_score", sql(_SWEEP, sql_out("SELECT * FROM scores WHERE abs(threshold - 0.6) < 0.001", _COUNTS, ["threshold", "alert_fraction", "MCC"])))
def alert_score(spark, sf_dir):
    return evaluate.alert_score(
        consensus_of(spark, sf_dir), labelled(spark, sf_dir), landing.marked_events(spark, sf_dir), GEOM, ALERT
    )


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), -1)"


_SQUARE = '(("TP"+"FP")::DOUBLE * ("TP"+"FN") * ("TN"+"FP") * ("TN"+"FN"))'
_CURVES = {
    "mcc": f"coalesce(CASE WHEN {_SQUARE} > 0 THEN (\"TP\"::DOUBLE * \"TN\" - \"FP\"::DOUBLE * \"FN\") / sqrt(greatest({_SQUARE}, 0)) END, -1)",
    "f1": _ratio('2 * "TP"', '2 * "TP" + "FP" + "FN"'),
    "accuracy": _ratio('"TP" + "TN"', '"TP" + "TN" + "FP" + "FN"'),
    "false_positive_rate": _ratio('"FP"', '"FP" + "TN"'),
    "true_positive_rate": _ratio('"TP"', '"TP" + "FN"'),
    "false_alert_rate": _ratio('"FP"', '"FP" + "TP"'),
}


@query(
    "score_curves",
    sql(
        _SWEEP,
        sql_out(
            f'SELECT station, threshold, {", ".join(f"{e} AS {c}" for c, e in _CURVES.items())}, "FN"::BIGINT AS missed, alert_fraction FROM scores',
            "station, missed",
            ["threshold", *_CURVES, "alert_fraction"],
        ),
    ),
)
def score_curves(spark, sf_dir):
    return evaluate.score_curves(_sweep(spark, sf_dir)).fillna(-1.0, list(_CURVES))


@query(
    "alert_flag",
    sql(
        _CONS,
        f"""SELECT c.station, coalesce(max(CASE WHEN c.consensus > {ALERT} THEN 1 ELSE 0 END) FILTER (c.win_end > n.now - 172800), -1)::BIGINT AS in_alert
            FROM cons c JOIN (SELECT station, max(us) // 1000000 AS now FROM ev GROUP BY station) n ON n.station = c.station GROUP BY c.station""",
    ),
)
def alert_flag(spark, sf_dir):
    cons = consensus_of(spark, sf_dir)
    now = landing.readings(spark, sf_dir).groupBy("station").agg(F.floor(F.max("us") / 1_000_000).alias("now"))
    return alerts.alert_flag(cons, cons, now, GEOM, ALERT)


@query(
    "alert_cover",
    sql(
        _CONS,
        f"""SELECT station, year(make_timestamp(start * 1000000)) AS year, start, stop FROM (
              SELECT station, min(win_end) AS start, max(win_end) + 172800 AS stop FROM (
                SELECT *, sum(fresh) OVER (PARTITION BY station ORDER BY i) AS island FROM (
                  SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY station ORDER BY i) <= 4 THEN 0 ELSE 1 END AS fresh
                  FROM cons WHERE consensus > {SHADE})) GROUP BY station, island)""",
    ),
)
def alert_cover(spark, sf_dir):
    return alerts.alert_cover(consensus_of(spark, sf_dir), GEOM, SHADE)


# ---- exploration -----------------------------------------------------------------------------------------

_LOGS = f"{_FW}, logs AS (SELECT station, win_end, feature, log10(CASE WHEN value > 0 THEN value END) AS x FROM feats WHERE value > 0)"
PAIRS = ["rsam__mean", "mf__mean", "hf__maximum", "dsar__standard_deviation"]


@query(
    "feature_hist",
    sql(
        _LOGS
        + """, calm AS (SELECT l.feature, l.x FROM logs l JOIN lab USING (station, win_end) WHERE label < 1),
        lim AS (SELECT feature, avg(x) - 3 * stddev_pop(x) AS low FROM calm GROUP BY feature),
        kept AS (SELECT c.* FROM calm c JOIN lim USING (feature) WHERE x > low),
        rng AS (SELECT feature, min(x) AS lo, max(x) AS hi, (SELECT CAST(floor(sqrt(count(*) / 2)) AS BIGINT) FROM lab WHERE label < 1) AS bins
                FROM kept GROUP BY feature)""",
        sql_out(
            """SELECT feature, bin, lo + bin * (hi - lo) / bins AS "left", (hi - lo) / bins AS width, n FROM (
                 SELECT feature, lo, hi, bins, least(CAST(floor((x - lo) / (hi - lo) * bins) AS BIGINT), bins - 1) AS bin, count(*) AS n
                 FROM kept JOIN rng USING (feature) GROUP BY ALL)""",
            "feature, bin, n",
            ["left", "width"],
        ),
    ),
)
def feature_hist(spark, sf_dir):
    feats = cut_lineage(features(spark, sf_dir).select("station", "win_end", "feature", "value"))
    return explore.feature_hist(feats, cut_lineage(labelled(spark, sf_dir)))


@query(
    "event_values",
    sql(
        _LOGS,
        sql_out(
            """SELECT l.station, m.te_us, l.win_end, g.feature, g.x FROM lab l JOIN marks m ON m.station = l.station
               JOIN logs g ON g.station = l.station AND g.win_end = l.win_end
               WHERE l.label > 0 AND abs(m.te_us - l.win_end * 1000000) < 432000000000""",
            "station, te_us, win_end, feature",
            ["x"],
        ),
    ),
)
def event_values(spark, sf_dir):
    return explore.event_values(features(spark, sf_dir), labelled(spark, sf_dir), landing.marked_events(spark, sf_dir))


_TRIM = _LOGS + """, qs AS (SELECT feature, quantile_cont(x, 0.005) AS a, quantile_cont(x, 0.995) AS b FROM logs GROUP BY feature),
trimmed AS (SELECT l.* FROM logs l JOIN qs USING (feature) WHERE x > a AND x < b)"""


@query("quantile_trim", sql(_TRIM, sql_out("SELECT station, win_end, feature, x FROM trimmed", "station, win_end, feature", ["x"])))
def quantile_trim(spark, sf_dir):
    return explore.quantile_trim(cut_lineage(features(spark, sf_dir)))


_WIDE = _TRIM + ", wide AS (SELECT * FROM (SELECT station, win_end, " + ", ".join(
    f"max(x) FILTER (feature = '{n}') AS f{i}" for i, n in enumerate(PAIRS)
) + " FROM trimmed GROUP BY station, win_end) WHERE " + " AND ".join(f"f{i} IS NOT NULL" for i in range(len(PAIRS))) + ")"


def _pair_logs(spark, sf_dir):
    kept = selection.keep_features(features(spark, sf_dir), PAIRS)
    return cut_lineage(explore.quantile_trim(cut_lineage(kept)))


_PAIRS = [(i, j) for i in range(len(PAIRS)) for j in range(i)]


@query(
    "feature_corr",
    sql(
        _WIDE,
        sql_out(
            " UNION ALL ".join(
                f"SELECT '{PAIRS[i]}' AS feature_a, '{PAIRS[j]}' AS feature_b, corr(f{i}, f{j}) AS corr FROM wide" for i, j in _PAIRS
            ),
            "feature_a, feature_b",
            ["corr"],
        ),
    ),
)
def feature_corr(spark, sf_dir):
    return explore.feature_corr(_pair_logs(spark, sf_dir), PAIRS)


def _bin(i: int) -> str:
    return f"least(CAST(floor((f{i} - (SELECT min(f{i}) FROM wide)) / (SELECT max(f{i}) - min(f{i}) FROM wide) * 20) AS BIGINT), 19)"


@query(
    "pair_counts",
    sql(
        _WIDE,
        " UNION ALL ".join(
            f"SELECT '{PAIRS[i]}' AS feature_a, '{PAIRS[j]}' AS feature_b, {_bin(i)} AS bin_a, {_bin(j)} AS bin_b, count(*) AS n FROM wide GROUP BY ALL"
            for i, j in _PAIRS
        ),
    ),
)
def pair_counts(spark, sf_dir):
    return explore.pair_counts(_pair_logs(spark, sf_dir), PAIRS)
