"""Queries: labels, feature store, sampling, selection, models."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from foreshock.config import SIGNALS, Geometry
from foreshock.functions.names import feature_line
from foreshock.functions.numbers import log10_signed
from foreshock.operators import consensus as votes
from foreshock.operators import features_agg, features_arrow, forests, labels, linear, models, packed, sampling, selection, store, trees, windows
from foreshock.plans.catalog import query, sql, sql_num, sql_out, tidy
from foreshock.sources import landing
from foreshock.sources.tables import cut_lineage, work_dir

GEOM = Geometry(window=2.0, overlap=0.75, look_forward=2.0)
N_MODELS, SEED, TOP = 100, 0, 20
EXCLUDED = [("2024-01-10 00:00:00", "2024-01-12 12:00:00"), ("2024-01-20 00:00:00", "2024-01-21 00:00:00")]
SPLIT_AT = 1705700000  # epoch seconds between two windows, for the incremental queries

BASIC = {
    "mean": "avg(x)",
    "standard_deviation": "stddev_pop(x)",
    "maximum": "max(x)",
    "minimum": "min(x)",
    "abs_energy": "sum(x*x)",
    "skewness": "skewness(x)",
    "mean_abs_change": "avg(abs(x - l1))",
}
CALCS = list(BASIC)
_FW = f"""fw AS (SELECT station, win_end, stream, {", ".join(f"{sql_num(c)} AS {c}" for c in CALCS)} FROM (
  SELECT station, win_end, stream, {", ".join(f"{e} AS {c}" for c, e in BASIC.items())} FROM (
    SELECT *, lag(x) OVER (PARTITION BY station, win_end, stream ORDER BY pos) AS l1 FROM wx)
  GROUP BY station, win_end, stream)),
feats AS ({" UNION ALL ".join(f"SELECT station, win_end, stream, '{c}' AS calculator, stream || '__{c}' AS feature, {c} AS value FROM fw" for c in CALCS)})"""


def windows_of(spark, sf_dir):
    return windows.window_dates(landing.series(spark, sf_dir), GEOM)


def labelled(spark, sf_dir):
    return labels.label_windows(windows_of(spark, sf_dir), landing.marked_events(spark, sf_dir), GEOM)


def features(spark, sf_dir, calculators=CALCS):
    """Long features, rounded so that equal windows give equal values in any order of summation."""
    wide = features_agg.window_sums(landing.series(spark, sf_dir), GEOM, SIGNALS, calculators)
    return store.melt(tidy(wide)).drop("params")


def samples(spark, sf_dir):
    return sampling.undersample(labelled(spark, sf_dir), N_MODELS, SEED)


# ---- labels and range filters ----------------------------------------------------------------------------


@query("label_windows", sql("SELECT station, k, win_end, label FROM lab"))
def label_windows(spark, sf_dir):
    return labelled(spark, sf_dir).drop("e")


@query(
    "feature_label_matrix",
    sql(
        sql_out(
            f"""SELECT w.station, w.win_end, l.label, {", ".join(
                f"avg(x) FILTER (stream = '{s}') AS {s}__mean, stddev_pop(x) FILTER (stream = '{s}') AS {s}__standard_deviation, "
                f"max(x) FILTER (stream = '{s}') AS {s}__maximum" for s in SIGNALS)}
              FROM wx w JOIN lab l ON l.station = w.station AND l.win_end = w.win_end GROUP BY w.station, w.win_end, l.label""",
            "station, win_end, label",
            [f"{s}__{c}" for s in SIGNALS for c in ("mean", "standard_deviation", "maximum")],
        )
    ),
)
def feature_label_matrix(spark, sf_dir):
    calcs = ["mean", "standard_deviation", "maximum"]
    series = landing.series(spark, sf_dir)
    wide = store.widen(
        store.melt(features_agg.window_sums(series, GEOM, SIGNALS, calcs)), [f"{s}__{c}" for s in SIGNALS for c in calcs]
    )
    return wide.join(labelled(spark, sf_dir).select("station", "win_end", "label"), ["station", "win_end"])


_OUTSIDE = " AND ".join(
    f"NOT (win_end >= epoch(TIMESTAMP '{a}') AND win_end < epoch(TIMESTAMP '{b}'))" for a, b in EXCLUDED
)


@query("exclude_ranges", sql(f"SELECT station, win_end, label FROM lab WHERE {_OUTSIDE}"))
def exclude_ranges(spark, sf_dir):
    return labels.exclude_ranges(labelled(spark, sf_dir), EXCLUDED).select("station", "win_end", "label")


@query(
    "exclude_around_events",
    sql(
        """SELECT station, win_end, label FROM lab l WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.station = l.station
           AND l.win_end * 1000000 >= m.te_us - 86400000000 AND l.win_end * 1000000 < m.te_us + 86400000000)"""
    ),
)
def exclude_around_events(spark, sf_dir):
    near = labels.around_events(landing.marked_events(spark, sf_dir), 1.0)
    return labels.exclude_range_table(labelled(spark, sf_dir), near).select("station", "win_end", "label")


@query(
    "event_neighbourhood",
    sql(
        """SELECT l.station, m.te_us, l.win_end FROM lab l JOIN marks m ON m.station = l.station
           WHERE l.label > 0 AND abs(m.te_us - l.win_end * 1000000) < 432000000000"""
    ),
)
def event_neighbourhood(spark, sf_dir):
    near = labels.event_neighbourhood(labelled(spark, sf_dir), landing.marked_events(spark, sf_dir))
    return near.select("station", "te_us", "win_end")


# ---- features and their store ----------------------------------------------------------------------------


@query("features_basic", sql(_FW, "SELECT station, win_end, stream, calculator, feature, value FROM feats"))
def features_basic(spark, sf_dir):
    return features(spark, sf_dir)


@query(
    "calc_subset",
    sql(_FW, "SELECT station, win_end, feature, value FROM feats WHERE calculator IN ('mean', 'skewness')"),
)
def calc_subset(spark, sf_dir):
    picked = selection.pick_calculators(CALCS, only=["mean", "skewness"])
    return features(spark, sf_dir, picked).select("station", "win_end", "feature", "value")


@query(
    "drop_features",
    sql(
        _FW,
        "SELECT station, win_end, feature, value FROM feats WHERE feature <> 'rsam__mean' AND calculator <> 'skewness' "
        "AND feature NOT LIKE 'mf%imum'",
    ),
)
def drop_features(spark, sf_dir):
    dropped = selection.drop_features(features(spark, sf_dir), ["rsam__mean", "skewness", "mf*imum"], CALCS)
    return dropped.select("station", "win_end", "feature", "value")


@query(
    "keep_features",
    sql(_FW, "SELECT station, win_end, feature, value FROM feats WHERE feature IN ('rsam__mean', 'hf__maximum')"),
)
def keep_features(spark, sf_dir):
    kept = selection.keep_features(features(spark, sf_dir), ["rsam__mean", "hf__maximum", "no__such"])
    return kept.select("station", "win_end", "feature", "value")


@query(
    "impute",
    sql(
        _FW
        + """, raw AS (SELECT station, win_end, feature, floor(value / 25) - 1 AS f FROM feats),
        logs AS (SELECT station, win_end, feature, CASE WHEN f > 0 THEN log10(f) END AS v, f FROM raw),
        st AS (SELECT feature, min(v) AS lo, median(v) AS med FROM logs GROUP BY feature)""",
        sql_out(
            "SELECT station, win_end, l.feature, coalesce(CASE WHEN f < 0 THEN med WHEN f = 0 THEN lo ELSE v END, 0) AS value "
            "FROM logs l JOIN st ON st.feature = l.feature",
            "station, win_end, feature",
            ["value"],
        ),
    ),
)
def impute(spark, sf_dir):
    raw = features(spark, sf_dir).select("station", "win_end", "feature", (F.floor(F.col("value") / 25) - 1).alias("f"))
    logs = raw.select("station", "win_end", "feature", log10_signed(F.col("f")).alias("value"))
    return store.impute(cut_lineage(logs))


@query("feature_rows_missing", sql(f"SELECT station, k, win_end FROM win WHERE win_end < {SPLIT_AT}"))
def feature_rows_missing(spark, sf_dir):
    held = store.trim_store(features(spark, sf_dir, ["mean"]), ti=SPLIT_AT)
    return store.missing_windows(windows_of(spark, sf_dir), held).select("station", "k", "win_end")


@query(
    "feature_cols_missing",
    sql(
        f"""SELECT station, win_end, calculator FROM win, (SELECT unnest(['mean', 'maximum', 'minimum']) AS calculator)
            WHERE calculator = 'minimum' OR (calculator = 'maximum' AND win_end < {SPLIT_AT})"""
    ),
)
def feature_cols_missing(spark, sf_dir):
    rows = features(spark, sf_dir, ["mean", "maximum"])
    held = rows.filter((F.col("calculator") == "mean") | (F.col("win_end") >= SPLIT_AT))
    return store.missing_calculators(["mean", "maximum", "minimum"], held)


@query(
    "feature_store_trim",
    sql(
        _FW,
        f"SELECT station, win_end, feature, value FROM feats WHERE win_end >= 1704900000 AND win_end < {SPLIT_AT} "
        "AND calculator IN ('mean', 'maximum')",
    ),
)
def feature_store_trim(spark, sf_dir):
    """The features go to a store by month and calculator; the read prunes both."""
    path = f"{work_dir(spark)}/features-{uuid.uuid4().hex}"
    store.write_features(features(spark, sf_dir), path)
    held = store.read_features(spark, path, 1704900000, SPLIT_AT, ["mean", "maximum"])
    return held.select("station", "win_end", "feature", "value")


@query(
    "feature_union",
    sql(
        _FW,
        f"SELECT station, win_end, feature, CASE WHEN calculator = 'mean' AND win_end < {SPLIT_AT} THEN -1 ELSE value END AS value "
        "FROM feats WHERE calculator IN ('mean', 'maximum')",
    ),
)
def feature_union(spark, sf_dir):
    """Stored rows (marked by value -1) are kept, everything else is appended."""
    new = features(spark, sf_dir, ["mean", "maximum"]).select("station", "win_end", "feature", "value")
    held = features(spark, sf_dir, ["mean"]).filter(F.col("win_end") < SPLIT_AT)
    return store.union_features(held.select("station", "win_end", "feature", F.lit(-1.0).alias("value")), new)


@query(
    "feature_matrix_check",
    sql("SELECT station, win_end, 'labels' AS side FROM lab WHERE win_end < 1704900000"),
)
def feature_matrix_check(spark, sf_dir):
    part = features(spark, sf_dir, ["mean"]).filter(F.col("win_end") >= 1704900000)
    return labels.unmatched_rows(part, labelled(spark, sf_dir))


# ---- sampling --------------------------------------------------------------------------------------------

_SAMPLE = f"""sizes AS (SELECT least(count(*) FILTER (label > 0), count(*) FILTER (label <= 0)) AS small FROM lab),
drawn AS (SELECT model_id, l.station, l.win_end, l.label,
   row_number() OVER (PARTITION BY model_id, label ORDER BY md5(concat_ws(':', model_id + {SEED}, l.station, l.win_end))) AS place,
   count(*) OVER (PARTITION BY model_id, label) AS size
   FROM lab l, (SELECT unnest(range({N_MODELS})) AS model_id)),
sample AS (SELECT model_id, station, win_end, label FROM drawn, sizes
           WHERE place <= CAST(floor(small / 0.75) AS BIGINT))"""


@query("undersample", sql(_SAMPLE, "SELECT model_id, station, win_end, label FROM sample"))
def undersample(spark, sf_dir):
    return samples(spark, sf_dir)


@query(
    "class_weights",
    sql(
        _SAMPLE,
        sql_out(
            "SELECT model_id, label, count(*) AS n_class, (sum(count(*)) OVER (PARTITION BY model_id))::DOUBLE / (2 * count(*)) AS weight "
            "FROM sample GROUP BY model_id, label",
            "model_id, label, n_class",
            ["weight"],
        ),
    ),
)
def class_weights(spark, sf_dir):
    return sampling.class_weights(samples(spark, sf_dir))


@query(
    "shuffle_split",
    sql(
        _SAMPLE,
        f"""SELECT model_id, fold, station, win_end, label,
            row_number() OVER (PARTITION BY model_id, fold ORDER BY md5(concat_ws(':', model_id + {SEED}, fold, station, win_end)))
              <= ceil(count(*) OVER (PARTITION BY model_id, fold) * 0.25) AS test
            FROM sample, (SELECT unnest(range(5)) AS fold)""",
    ),
)
def shuffle_split(spark, sf_dir):
    return sampling.shuffle_split(samples(spark, sf_dir), seed=SEED)


# ---- selection -------------------------------------------------------------------------------------------

_RANKED = f"""{_FW}, {_SAMPLE},
sv AS (SELECT s.model_id, s.station, s.win_end, s.label, f.feature, f.value FROM sample s
       JOIN feats f ON f.station = s.station AND f.win_end = s.win_end),
vals AS (SELECT model_id, feature, value, count(*) FILTER (label <= 0) AS n0, count(*) FILTER (label > 0) AS n1
         FROM sv GROUP BY model_id, feature, value),
ranked AS (SELECT *, coalesce(sum(n0) OVER w, 0) AS below0, coalesce(sum(n1) OVER w, 0) AS below1 FROM vals
           WINDOW w AS (PARTITION BY model_id, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sums AS (SELECT model_id, feature, sum(n0) AS c0, sum(n1) AS c1,
         sum(n1 * (below0 + below1 + (n0 + n1 + 1) / 2)) - sum(n1) * (sum(n1) + 1) / 2 AS u,
         sum(CAST(n0 + n1 AS DOUBLE) * (n0 + n1) * (n0 + n1) - (n0 + n1)) AS ties FROM ranked GROUP BY model_id, feature),
mw AS (SELECT model_id, feature, CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1, u,
       (greatest(u, c0 * c1 - u) - c0 * c1 / 2 - 0.5)
         / sqrt(c0 * c1 / 12 * ((c0 + c1) + 1 - ties / ((c0 + c1) * (c0 + c1 - 1)))) AS z FROM sums),
picked AS (SELECT model_id, feature, rank FROM (SELECT *, row_number() OVER (PARTITION BY model_id
           ORDER BY abs(z) DESC, feature) AS rank FROM mw) WHERE rank <= {TOP})"""


def stored_inputs(spark, sf_dir):
    """Samples and features, each written once: selection and training read them several times."""
    return cut_lineage(samples(spark, sf_dir)), cut_lineage(features(spark, sf_dir))


def statistics(drawn, feats):
    return selection.mann_whitney(selection.ranked_values(drawn, feats))


def selected(spark, sf_dir):
    return selection.select_topk(selection.p_values(statistics(*stored_inputs(spark, sf_dir))), TOP)


@query(
    "mann_whitney",
    sql(_RANKED, sql_out("SELECT model_id, feature, c0, c1, u, z FROM mw", "model_id, feature, c0, c1", ["u", "z"])),
)
def mann_whitney(spark, sf_dir):
    return statistics(*stored_inputs(spark, sf_dir)).select("model_id", "feature", "c0", "c1", "u", "z")


# Fisher's exact test (all tables no likelier than this one) where a feature has two values, else the tail of the normal distribution: a
# series near the middle, a continued fraction beyond.
_LOGS = "-(lgamma(k + 1) + lgamma(a1 + a0 - k + 1) + lgamma(c1 - k + 1) + lgamma(c0 - a0 - a1 + k + 1))"
_PVALUES = f"""tails AS (SELECT model_id, feature, c0, c1, abs(z) / sqrt(2) AS x FROM mw WHERE isfinite(z)),
sides2 AS (SELECT model_id, feature, count(*) AS n_values, arg_min(n0, value)::BIGINT AS a0, arg_min(n1, value)::BIGINT AS a1 FROM ranked GROUP BY ALL),
tabled AS (SELECT t.model_id, t.feature, list({_LOGS}) AS logs, any_value({re.sub(r"\bk\b", "a1", _LOGS)}) AS own
  FROM (SELECT t.*, s.a0, s.a1, unnest(generate_series(greatest(0, a1 + a0 - c0), least(a1 + a0, c1))) AS k
        FROM tails t JOIN sides2 s USING (model_id, feature) WHERE n_values = 2) t GROUP BY t.model_id, t.feature),
fisher AS (SELECT model_id, feature, least(1, list_sum(list_transform(list_filter(logs, lambda l: exp(l - own) <= 1 + 1e-7), lambda l: exp(l - list_max(logs))))
  / list_sum(list_transform(logs, lambda l: exp(l - list_max(logs))))) AS p FROM tabled),
normal AS (SELECT model_id, feature, CASE
   WHEN x < 2.5 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(70), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * x * exp(2 * n * ln(greatest(x, 1e-300)) - lgamma(n + 1)) / (2 * n + 1)))
   ELSE exp(-x * x) / sqrt(pi()) / list_reduce(list_prepend(x::DOUBLE, list_transform(range(80, 0, -1), lambda n: n::DOUBLE)), lambda f, n: x + n / 2 / f) END AS p FROM tails),
pv AS (SELECT n.model_id, n.feature, coalesce(f.p, n.p) AS p_value FROM normal n LEFT JOIN fisher f USING (model_id, feature)),
placed AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY p_value, feature) AS rank, count(*) OVER (PARTITION BY model_id) AS m FROM pv),
passing AS (SELECT *, p_value <= 0.05 * rank / (m * list_sum(list_transform(range(1, m + 1), lambda i: 1 / i))) AS ok FROM placed),
flagged AS (SELECT model_id, feature, p_value, rank, rank <= coalesce(max(CASE WHEN ok THEN rank END) OVER (PARTITION BY model_id), 0) AS relevant FROM passing)"""


@query("fdr_flag", sql(_RANKED + ", " + _PVALUES, sql_out("SELECT * FROM flagged", "model_id, feature, rank, relevant", ["p_value"])))
def fdr_flag(spark, sf_dir):
    return selection.fdr_flag(selection.p_values(statistics(*stored_inputs(spark, sf_dir))))


@query("select_topk", sql(_RANKED, "SELECT model_id, rank, feature FROM picked"))
def select_topk(spark, sf_dir):
    return selected(spark, sf_dir).select("model_id", "rank", "feature")


@query("feature_frequency", sql(_RANKED, "SELECT feature, count(*) AS n FROM picked GROUP BY feature"))
def feature_frequency(spark, sf_dir):
    return selection.feature_frequency(selected(spark, sf_dir))


@query("distinct_calculators", sql(_RANKED, "SELECT DISTINCT split_part(feature, '__', 2) AS calculator FROM picked"))
def distinct_calculators(spark, sf_dir):
    return selection.distinct_calculators(selected(spark, sf_dir))


@query(
    "parse_feature_lines",
    sql(_FW, "SELECT station, win_end, feature, value AS p_value FROM feats"),
)
def parse_feature_lines(spark, sf_dir):
    """Every feature row written as a list line, with a blank inside the name, and read back."""
    text = F.concat(F.col("value").cast("string"), F.lit(" "), F.replace("feature", F.lit("__"), F.lit("  ")))
    p_value, name = feature_line(F.col("line"))
    lines = features(spark, sf_dir).select("station", "win_end", text.alias("line"))
    return lines.select("station", "win_end", F.replace(name, F.lit(" "), F.lit("__")).alias("feature"), p_value.alias("p_value"))


# ---- models ----------------------------------------------------------------------------------------------

_TRAIN = _RANKED + """, tr AS (SELECT sv.* FROM sv JOIN picked p ON p.model_id = sv.model_id AND p.feature = sv.feature)"""

_STUMP = _TRAIN + """, cw AS (SELECT model_id, count(*) FILTER (label <= 0) AS c0, count(*) FILTER (label > 0) AS c1,
   count(*) / (2 * count(*) FILTER (label <= 0)) AS w0, count(*) / (2 * count(*) FILTER (label > 0)) AS w1 FROM sample GROUP BY model_id),
cuts AS (SELECT r.model_id, r.feature, r.value, (below0 + n0) * w0 AS a0, (below1 + n1) * w1 AS a1,
   (c0 - below0 - n0) * w0 AS b0, (c1 - below1 - n1) * w1 AS b1,
   lead(r.value) OVER (PARTITION BY r.model_id, r.feature ORDER BY r.value) AS above
   FROM ranked r JOIN picked p ON p.model_id = r.model_id AND p.feature = r.feature JOIN cw ON cw.model_id = r.model_id),
stump AS (SELECT * FROM cuts WHERE above IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY
   round(2*a0*a1/(a0+a1) + 2*b0*b1/(b0+b1), 9), feature, value) = 1),
stump_votes AS (SELECT s.model_id, f.station, f.win_end,
   CASE WHEN f.value <= (s.value + s.above) / 2 THEN (CASE WHEN a1 > a0 THEN 1.0 ELSE 0.0 END)::DOUBLE
        ELSE (CASE WHEN b1 > b0 THEN 1.0 ELSE 0.0 END)::DOUBLE END AS pred
   FROM stump s JOIN feats f ON f.feature = s.feature)"""


def _training(spark, sf_dir):
    """Features, training rows and samples of the model set."""
    drawn, feats = stored_inputs(spark, sf_dir)
    chosen = selection.select_topk(selection.p_values(statistics(drawn, feats)), TOP)
    return feats, cut_lineage(models.training_rows(drawn, feats, chosen)), drawn


def _packed_training(spark, sf_dir):
    """The same with one row per window for all models."""
    drawn, feats = stored_inputs(spark, sf_dir)
    vectors = packed.window_vectors(feats)
    sampled = packed.sampled_windows(drawn, feats, vectors)
    chosen = selection.select_topk(selection.p_values(statistics(sampled, feats)), TOP)
    return vectors, models.training_rows(sampled, feats, chosen), drawn


def stumps(spark, sf_dir):
    """Stumps of the model set, features and samples. Values are ranked once, for the test and the splits."""
    drawn, feats = stored_inputs(spark, sf_dir)
    ranked = cut_lineage(selection.ranked_values(drawn, feats))
    chosen = selection.select_topk(selection.p_values(selection.mann_whitney(ranked)), TOP)
    return trees.stumps_from_ranks(ranked, chosen, sampling.class_weights(drawn)), feats, drawn


def stump_votes(spark, sf_dir):
    rules, feats, drawn = stumps(spark, sf_dir)
    return trees.predict_stumps(feats, cut_lineage(trees.stump_rules(rules))), drawn


@query(
    "train_stumps",
    sql(
        _STUMP,
        sql_out(
            "SELECT model_id, feature, (value + above) / 2 AS threshold, (CASE WHEN a1 > a0 THEN 1 ELSE 0 END)::DOUBLE AS left_vote, "
            "(CASE WHEN b1 > b0 THEN 1 ELSE 0 END)::DOUBLE AS right_vote FROM stump",
            "model_id, feature, left_vote, right_vote",
            ["threshold"],
        ),
    ),
)
def train_stumps(spark, sf_dir):
    return stumps(spark, sf_dir)[0]


@query("train_vote", sql(_STUMP, "SELECT model_id, station, win_end, pred FROM stump_votes"))
def train_vote(spark, sf_dir):
    return stump_votes(spark, sf_dir)[0]


@query(
    "balanced_accuracy",
    sql(
        _STUMP,
        sql_out(
            """SELECT model_id, (avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) FILTER (label > 0)
                 + avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) FILTER (label <= 0)) / 2 AS score
               FROM stump_votes v JOIN sample s USING (model_id, station, win_end) GROUP BY model_id""",
            "model_id",
            ["score"],
        ),
    ),
)
def balanced_accuracy(spark, sf_dir):
    cast, drawn = stump_votes(spark, sf_dir)
    return models.balanced_accuracy(cast.join(drawn.hint("merge"), ["model_id", "station", "win_end"]), ["model_id"])


@query("train_consensus", sql(_STUMP, sql_out("SELECT station, win_end, avg(pred) AS consensus FROM stump_votes GROUP BY ALL", "station, win_end", ["consensus"])))
def train_consensus(spark, sf_dir):
    return votes.consensus(stump_votes(spark, sf_dir)[0], N_MODELS)


def _grown_sql(depth: int, max_features: int) -> str:
    """Trees level by level: per node the best split of a few features, then each row goes to a child."""
    steps = ["cw AS (SELECT model_id, count(*) / (2 * count(*) FILTER (label <= 0)) AS w0, count(*) / (2 * count(*) FILTER (label > 0)) AS w1 FROM sample GROUP BY model_id)",
             "t0 AS (SELECT *, 1::BIGINT AS node FROM tr)"]
    side = "2*{0}0*{0}1/({0}0+{0}1)".format
    for d in range(depth):
        steps.append(f"""v{d} AS (SELECT model_id, node, feature, value, count(*) FILTER (label <= 0) AS n0, count(*) FILTER (label > 0) AS n1 FROM t{d} GROUP BY ALL),
r{d} AS (SELECT v.*, sum(n0) OVER w AS l0, sum(n1) OVER w AS l1, sum(n0) OVER p AS c0, sum(n1) OVER p AS c1, lead(value) OVER w AS above FROM v{d} v
   WINDOW w AS (PARTITION BY model_id, node, feature ORDER BY value), p AS (PARTITION BY model_id, node, feature)),
k{d} AS (SELECT r.*, l0 * w0 AS a0, l1 * w1 AS a1, (c0 - l0) * w0 AS b0, (c1 - l1) * w1 AS b1 FROM r{d} r JOIN cw USING (model_id)
   WHERE above IS NOT NULL AND c0 > 0 AND c1 > 0),
f{d} AS (SELECT model_id, node, feature FROM (SELECT DISTINCT model_id, node, feature FROM k{d})
   QUALIFY row_number() OVER (PARTITION BY model_id, node ORDER BY md5(concat_ws(':', model_id, node, feature))) <= {max_features}),
s{d} AS MATERIALIZED (SELECT model_id, node, feature, (value + above) / 2 AS cut, (CASE WHEN a1 > a0 THEN 1 ELSE 0 END)::DOUBLE AS lv,
   (CASE WHEN b1 > b0 THEN 1 ELSE 0 END)::DOUBLE AS rv FROM k{d} JOIN f{d} USING (model_id, node, feature)
   QUALIFY row_number() OVER (PARTITION BY model_id, node ORDER BY round({side("a")} + {side("b")}, 9), feature, value, a0, a1, b0, b1) = 1),
t{d + 1} AS MATERIALIZED (SELECT t.* EXCLUDE (node), m.child AS node FROM t{d} t JOIN (SELECT x.model_id, x.station, x.win_end, x.node * 2 + (x.value > s.cut)::BIGINT AS child
   FROM t{d} x JOIN s{d} s USING (model_id, node, feature)) m USING (model_id, station, win_end))""")
    steps.append("p0 AS (SELECT DISTINCT s.model_id, f.station, f.win_end, 1::BIGINT AS node, NULL::DOUBLE AS vote FROM s0 s, (SELECT DISTINCT station, win_end FROM feats) f)")
    for d in range(depth):
        steps.append(f"""p{d + 1} AS (SELECT p.model_id, p.station, p.win_end, CASE WHEN s.node IS NULL THEN -1 ELSE p.node * 2 + (f.value > s.cut)::BIGINT END AS node,
   CASE WHEN s.node IS NULL THEN p.vote WHEN f.value > s.cut THEN s.rv ELSE s.lv END AS vote
   FROM p{d} p LEFT JOIN s{d} s ON s.model_id = p.model_id AND s.node = p.node
   LEFT JOIN feats f ON f.station = p.station AND f.win_end = p.win_end AND f.feature = s.feature)""")
    return ", ".join(steps)


@query(
    "tree_vote",
    sql(
        _TRAIN + ", " + _grown_sql(3, 4),
        sql_out(
            f"SELECT station, win_end, CASE WHEN count(vote) >= {N_MODELS} THEN avg(vote) END AS consensus FROM p3 GROUP BY station, win_end",
            "station, win_end", ["consensus"],
        ),
    ),
)
def tree_vote(spark, sf_dir):
    """Consensus of depth-3 trees on four random features a node."""
    feats, rows, _ = _packed_training(spark, sf_dir)
    rules = trees.grow_trees(rows, depth=3, max_features=4)
    return votes.consensus(trees.predict_rules(feats, rules), N_MODELS)


def _forest_sql(trees: int, depth: int, max_features: int) -> str:
    """Forests level by level: rows of each tree's bootstrap with their counts, the best split of a few features a node, and
    the share of the upper class at the end of each path."""
    draws = ", ".join(f"({t}, {pow(forests.NEXT, t + 1, forests.PRIME)})" for t in range(trees))
    number = "list_sum(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(md5(concat_ws(':', model_id, station, win_end)), i::INT, 1)) - 1) * (16 ** (8 - i))::BIGINT))::BIGINT"
    side = "2*{0}0*{0}1/({0}0+{0}1)".format
    node = "model_id, tree, node"
    steps = [
        "cw AS (SELECT model_id, count(*) / (2 * count(*) FILTER (label <= 0)) AS w0, count(*) / (2 * count(*) FILTER (label > 0)) AS w1 FROM sample GROUP BY model_id)",
        f"""drawn_rows AS (SELECT *, {" + ".join(f"(u >= {c})::BIGINT" for c in forests.COPIES)} AS n
  FROM (SELECT model_id, station, win_end, tree, {number} % {forests.PRIME} * a % {forests.PRIME} AS u FROM sample, (VALUES {draws}) d(tree, a)))""",
        "t0 AS MATERIALIZED (SELECT tr.*, tree, n, 1::BIGINT AS node FROM tr JOIN drawn_rows USING (model_id, station, win_end) WHERE n > 0)",
        """p0 AS (SELECT r.*, f.station, f.win_end FROM (SELECT model_id, tree, 1::BIGINT AS node,
   sum(n * w1) FILTER (label > 0) / (sum(n * w1) FILTER (label > 0) + coalesce(sum(n * w0) FILTER (label <= 0), 0)) AS share
   FROM t0 JOIN cw USING (model_id) GROUP BY ALL) r, (SELECT DISTINCT station, win_end FROM feats) f)""",
    ]
    for d in range(depth):
        steps.append(f"""v{d} AS (SELECT {node}, feature, value, coalesce(sum(n) FILTER (label <= 0), 0) AS n0, coalesce(sum(n) FILTER (label > 0), 0) AS n1 FROM t{d} GROUP BY ALL),
r{d} AS (SELECT v.*, sum(n0) OVER w AS l0, sum(n1) OVER w AS l1, sum(n0) OVER p AS c0, sum(n1) OVER p AS c1, lead(value) OVER w AS above FROM v{d} v
   WINDOW w AS (PARTITION BY {node}, feature ORDER BY value), p AS (PARTITION BY {node}, feature)),
k{d} AS (SELECT r.*, l0 * w0 AS a0, l1 * w1 AS a1, (c0 - l0) * w0 AS b0, (c1 - l1) * w1 AS b1 FROM r{d} r JOIN cw USING (model_id)
   WHERE above IS NOT NULL AND c0 > 0 AND c1 > 0),
f{d} AS (SELECT {node}, feature FROM (SELECT DISTINCT {node}, feature FROM k{d})
   QUALIFY row_number() OVER (PARTITION BY {node} ORDER BY md5(concat_ws(':', {node}, feature))) <= {max_features}),
s{d} AS MATERIALIZED (SELECT {node}, feature, (value + above) / 2 AS cut, a1 / (a0 + a1) AS ls, b1 / (b0 + b1) AS rs FROM k{d} JOIN f{d} USING ({node}, feature)
   QUALIFY row_number() OVER (PARTITION BY {node} ORDER BY round({side("a")} + {side("b")}, 9), feature, value) = 1),
t{d + 1} AS MATERIALIZED (SELECT t.* EXCLUDE (node), m.child AS node FROM t{d} t JOIN (SELECT x.model_id, x.tree, x.station, x.win_end, x.node * 2 + (x.value > s.cut)::BIGINT AS child
   FROM t{d} x JOIN s{d} s USING ({node}, feature)) m USING (model_id, tree, station, win_end)),
p{d + 1} AS (SELECT p.model_id, p.tree, CASE WHEN s.node IS NULL THEN -1 ELSE p.node * 2 + (f.value > s.cut)::BIGINT END AS node,
   CASE WHEN s.node IS NULL THEN p.share WHEN f.value > s.cut THEN s.rs ELSE s.ls END AS share, p.station, p.win_end
   FROM p{d} p LEFT JOIN s{d} s USING ({node}) LEFT JOIN feats f ON f.station = p.station AND f.win_end = p.win_end AND f.feature = s.feature)""")
    return ", ".join(steps)


def _forest_votes(spark, sf_dir, code, points):
    feats, rows, drawn = _packed_training(spark, sf_dir)
    folded = cut_lineage(sampling.shuffle_split(drawn, seed=SEED))
    return forests.forest_votes(feats, cut_lineage(forests.search_forests(rows, folded, points, code)[0]))


@query(
    "rf_vote",
    sql(
        _TRAIN + ", " + _forest_sql(10, 3, 4),
        "SELECT model_id, station, win_end, (round(avg(coalesce(share, 0)), 9) > 0.5)::DOUBLE AS pred FROM p3 GROUP BY model_id, station, win_end",
    ),
)
def rf_vote(spark, sf_dir):
    """Random forests of ten trees, the smallest of the grid, on the square root of the features at each node."""
    point = {"n_estimators": 10, "max_depth": 3, "criterion": "gini", "max_features": "sqrt"}
    return _forest_votes(spark, sf_dir, "RF", [point])


@query("tree_search_vote")
def tree_search_vote(spark, sf_dir):
    """Trees, the whole grid on all folds of all models; checked against growing each point alone in the tests."""
    return _forest_votes(spark, sf_dir, "DT", models.grid_points("DT"))


@query(
    "nb_vote",
    sql(
        _TRAIN
        + """, mom AS (SELECT model_id, feature, avg(value) FILTER (label > 0) AS m1, var_pop(value) FILTER (label > 0) AS v1,
               avg(value) FILTER (label <= 0) AS m0, var_pop(value) FILTER (label <= 0) AS v0, var_pop(value) AS v,
               count(*) FILTER (label > 0) AS n1, count(*) FILTER (label <= 0) AS n0 FROM tr GROUP BY ALL),
        sm AS (SELECT model_id, feature, m0, m1, v0 + eps AS v0, v1 + eps AS v1, n0, n1 FROM mom
               JOIN (SELECT model_id, max(v) * 1e-9 AS eps FROM mom GROUP BY model_id) USING (model_id))""",
        """SELECT model_id, station, win_end, (CASE WHEN sum(0.5 * ln(v0 / v1) + (value - m0)*(value - m0) / (2 * v0)
             - (value - m1)*(value - m1) / (2 * v1)) + max(ln(n1 / n0)) > 0 THEN 1 ELSE 0 END)::DOUBLE AS pred
           FROM feats JOIN sm USING (feature) GROUP BY model_id, station, win_end""",
    ),
)
def nb_vote(spark, sf_dir):
    feats, rows, _ = _training(spark, sf_dir)
    return models.bayes_votes(feats, models.fit_bayes(rows))


@query(
    "knn_vote",
    sql(
        _TRAIN
        + """, gaps AS (SELECT t.model_id, t.station AS s, t.win_end AS w, t.label, f.station, f.win_end, sum(pow(abs(f.value - t.value), 2)) AS d
               FROM tr t JOIN feats f ON f.feature = t.feature GROUP BY ALL)""",
        """SELECT model_id, station, win_end, (CASE WHEN sum(2 * label - 1) > 0 THEN 1 ELSE 0 END)::DOUBLE AS pred FROM (
             SELECT *, row_number() OVER (PARTITION BY model_id, station, win_end ORDER BY d, s, w) AS place FROM gaps)
           WHERE place <= 3 GROUP BY model_id, station, win_end""",
    ),
)
def knn_vote(spark, sf_dir):
    feats, rows, _ = _packed_training(spark, sf_dir)
    return models.neighbour_votes(models.input_rows(feats, rows), models.neighbour_blocks(rows), k=3, p=2)


def _linear_votes(spark, sf_dir, kind):
    feats, rows, drawn = _packed_training(spark, sf_dir)
    folded = cut_lineage(sampling.shuffle_split(drawn, seed=SEED))
    return linear.linear_votes(feats, linear.search_linear(rows, folded, kind, models.grid_points(kind))[0])


@query("logistic_vote")
def logistic_vote(spark, sf_dir):
    """Logistic regression, the whole grid on all folds of all models; checked against a plain solver in the tests."""
    return _linear_votes(spark, sf_dir, "LR")


@query("svm_vote")
def svm_vote(spark, sf_dir):
    """Linear support vectors, likewise."""
    return _linear_votes(spark, sf_dir, "SVM")


@query("feat_fft")
def feat_fft(spark, sf_dir):
    return _arrow(spark, sf_dir, ["fft_coefficient", "fft_aggregated", "spkt_welch_density"])


@query("feat_ar")
def feat_ar(spark, sf_dir):
    return _arrow(spark, sf_dir, ["partial_autocorrelation", "ar_coefficient", "augmented_dickey_fuller"])


@query("feat_entropy")
def feat_entropy(spark, sf_dir):
    return _arrow(spark, sf_dir, ["approximate_entropy", "sample_entropy"])


@query("feat_drift")
def feat_drift(spark, sf_dir):
    return _arrow(spark, sf_dir, ["friedrich_coefficients", "max_langevin_fixed_point"])


@query("feat_trend_pvalue")
def feat_trend_pvalue(spark, sf_dir):
    return _arrow(spark, sf_dir, ["linear_trend_pvalue"])


def _arrow(spark, sf_dir, calculators):
    arrays = windows.window_arrays(landing.series(spark, sf_dir), GEOM, SIGNALS)
    return features_arrow.window_arrow_features(arrays, calculators).select("station", "win_end", "feature", "value")
