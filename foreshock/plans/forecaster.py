"""The whole workflow as one object: features, training, forecast, scores. Every step is a DataFrame."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.config import CHUNK, SIGNALS, STEP_SECONDS, Geometry
from foreshock.functions.times import index_time, to_seconds
from foreshock.operators import alerts, consensus, evaluate, explore, forests, grid, labels, linear, models, sampling, selection, store, windows
from foreshock.operators.transforms import SEGMENT, check_streams, with_streams
from foreshock.plans.extract import ALL_CALCULATORS, extract_features
from foreshock.sources import tables
from foreshock.sources.tables import cut_lineage

_LOADERS = {"NN": MultilayerPerceptronClassificationModel}
_TREES = ("DT", "RF")


class SensorSeries:
    """Gap-free signals of stations and their known events."""

    def __init__(self, series: DataFrame, events: DataFrame, signals: Sequence[str] = SIGNALS, path: str | None = None, name: str = ""):
        """``path`` is where the series is stored, if it is; ``name`` tells apart series that share a forecaster's folder."""
        self.series, self.events, self.signals, self.path, self.name = series, events, tuple(signals), path, name

    @classmethod
    def from_files(cls, spark: SparkSession, series_path: str, events_path: str, name: str = "") -> "SensorSeries":
        return cls(tables.read_series(spark, series_path), tables.read_event_list(spark, events_path), path=series_path, name=name)

    def read_by(self, runs: DataFrame, before: int = 0) -> DataFrame:
        """The part of the series that runs of windows read, with ``before`` rows ahead of each. Of a stored series only the months
        they lie in are scanned; the calendar bounds the list of months."""
        series = self.series
        if self.path is not None:
            months = windows.run_chunks(runs, before).select(
                F.explode(F.array(*(F.date_format(index_time(F.col("chunk") * CHUNK + at), "yyyy-MM") for at in (0, CHUNK - 1)))).alias("month")
            )
            series = tables.read_series(series.sparkSession, self.path, sorted(r["month"] for r in months.distinct().collect()))
        return windows.prune_series(series, runs, before)

    def extent(self) -> DataFrame:
        return grid.data_extent(self.series)

    def update(self, fetched: DataFrame, path: str) -> "SensorSeries":
        """Merge newly fetched rows (``station, idx, signals``), fill gaps, store and return the series."""
        merged = cut_lineage(tables.ingest_merge(self.series, fetched, self.signals))
        tables.write_series(merged, path)
        return SensorSeries(tables.read_series(merged.sparkSession, path), self.events, self.signals, path, self.name)

    def get_data(self, ti=None, tf=None) -> DataFrame:
        return tables.time_range(self.series, ti, tf)

    def streams(self, names: Sequence[str]) -> DataFrame:
        return with_streams(self.series, names, self.signals)

    def year_panel(self, names: Sequence[str] = ("rsam",)) -> DataFrame:
        return explore.year_panel(self.streams(names), self.events, names)

_SELECTED = "model_id BIGINT, rank INT, feature STRING, p_value DOUBLE"
_RUNS = "run STRING, choice STRING, classifier STRING, n_models BIGINT, trained_us BIGINT"


class EventForecaster:
    """Forecast model of one window geometry. ``root`` is the folder (on a cluster: shared) for its tables, a new one where
    none is given. Tables are kept by series name, geometry and streams, models by classifier and training choices (range, numbers, seed, exclusions,
    features asked for, grid), and votes by training run, so a folder may serve several forecasters, a new one finds the models of an earlier
    one, and training anew leaves old votes behind. Values that are not finite are filled by the statistics of the run's training
    features wherever its models vote, so a window has the same features in every request."""

    def __init__(
        self, data: SensorSeries, window: float, overlap: float, look_forward: float,
        ti=None, tf=None, data_streams: Sequence[str] = SIGNALS, root: str | None = None,
    ):
        check_streams(data_streams, data.signals)
        self.data, self.geom, self.streams = data, Geometry(window, overlap, look_forward), tuple(data_streams)
        self.spark = data.series.sparkSession
        self.ti, self.tf = (None if t is None else to_seconds(t) for t in (ti, tf))
        self._check_range()
        self.root = root or os.path.join(tables.work_dir(self.spark), f"forecaster-{uuid.uuid4().hex}")
        self.classifier: str | None = None
        self.n_models = 0
        self.run: str | None = None
        self.choice: str | None = None

    def _check_range(self) -> None:
        """A requested range must lie inside the data; the extent is two numbers over all stations."""
        if self.ti is None and self.tf is None:
            return
        first, last = self.data.series.agg(F.min("t0"), F.max("t1")).first()
        if self.tf is not None and self.tf > last * STEP_SECONDS:
            raise ValueError(f"the range asked for ends at {self.tf}, after the last reading at {last * STEP_SECONDS}")
        if self.ti is not None and self.ti < first * STEP_SECONDS:
            raise ValueError(f"the range asked for begins at {self.ti}, before the first reading at {first * STEP_SECONDS}")

    def _path(self, *names: str) -> str:
        kind = f"{self.data.name or 'series'}_w{self.geom.window}_o{self.geom.overlap}_f{self.geom.look_forward}_{'-'.join(self.streams)}"
        return os.path.join(self.root, kind, *names)

    def _stored(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException:
            return None

    # ---- features ----------------------------------------------------------------------------------------

    def window_labels(self, ti=None, tf=None) -> DataFrame:
        """Windows of a period with their labels."""
        dates = windows.window_dates(self.data.series, self.geom, ti, tf)
        return labels.label_windows(dates, self.data.events, self.geom)

    def get_features(
        self, ti=None, tf=None, drop_features: Iterable[str] = (), compute_only_features: Iterable[str] = (),
        statistics: DataFrame | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """Imputed long features and labels of a period; without stored ``statistics`` the period's own fill its gaps. What the store
        lacks is computed and appended, from the rows of the series that the missing windows hold."""
        features, labelled = self._raw_features(ti, tf, drop_features, compute_only_features)
        return store.impute(features, statistics=statistics), labelled

    def _raw_features(
        self, ti=None, tf=None, drop_features: Iterable[str] = (), compute_only_features: Iterable[str] = ()
    ) -> tuple[DataFrame, DataFrame]:
        ti, tf = (self.ti if ti is None else to_seconds(ti)), (self.tf if tf is None else to_seconds(tf))
        drop, only = list(drop_features), list(compute_only_features)
        wanted = selection.pick_calculators(ALL_CALCULATORS, only, drop)
        labelled = self.window_labels(ti, tf)
        path = self._path("features")
        first, last = labelled.agg(F.min("win_end"), F.max("win_end")).first()  # prunes months
        until = None if last is None else last + 1
        if self._stored("features", store.FIELDS) is None:
            store.write_features(extract_features(self._derived(), self.geom, self.streams, wanted, (), ti, tf), path)
        else:
            held = store.read_features(self.spark, path, first, until, wanted)
            pairs = labelled.select("station", "k", "e", "win_end", F.explode(F.array(*[F.lit(c) for c in wanted])).alias("calculator"))
            have = held.select("station", "win_end", "calculator").distinct()
            missing = cut_lineage(pairs.join(have, ["station", "win_end", "calculator"], "left_anti"))
            for calculators, some in self._missing_sets(missing):
                runs = cut_lineage(windows.window_runs(some, self.geom))
                store.write_features(self._extract_runs(runs, calculators, ti, tf), path)
        rows = store.read_features(self.spark, path, first, until, wanted)
        features = rows.join(labelled.select("station", "win_end"), ["station", "win_end"], "left_semi")
        return selection.drop_features(features, drop, ALL_CALCULATORS), labelled

    def _missing_sets(self, missing: DataFrame) -> list[tuple[list[str], DataFrame]]:
        """Calculators that lack the same windows, with these. A row per calculator comes to the driver."""
        digest = F.sum(F.xxhash64("station", "win_end").cast("decimal(38,0)"))
        sets: dict[tuple, list[str]] = {}
        for r in missing.groupBy("calculator").agg(F.count("*").alias("n"), digest.alias("digest")).orderBy("calculator").collect():
            sets.setdefault((r["n"], r["digest"]), []).append(r["calculator"])
        return [(names, missing.filter(F.col("calculator") == names[0])) for names in sets.values()]

    def _extract_runs(self, runs: DataFrame, calculators: list[str], ti, tf) -> DataFrame:
        """Features of runs of windows. Streams look back a segment at most, so that much is read ahead of each run."""
        part = with_streams(self.data.read_by(runs, SEGMENT), self.streams, self.data.signals)
        return extract_features(part, self.geom, self.streams, calculators, (), ti, tf, runs)

    def _derived(self) -> DataFrame:
        return with_streams(self.data.series, self.streams, self.data.signals)

    # ---- training ----------------------------------------------------------------------------------------

    def train(
        self, ti=None, tf=None, Nfts: int = 20, Ncl: int = 100, retrain: bool = False, classifier: str = "DT",
        random_seed: int = 0, drop_features: Iterable[str] = (), exclude_dates: Sequence[tuple] = (),
        use_only_features: Sequence[str] = (), compute_only_features: Iterable[str] = (), grid: list[dict] | None = None,
    ) -> DataFrame:
        """Train a set of models and return how often each feature is used. Kept models are reused unless
        ``retrain``. ``grid`` replaces the classifier's search grid."""
        points = grid or models.grid_points(classifier)
        drop_features, compute_only_features = list(drop_features), list(compute_only_features)
        asked = [
            None if ti is None and self.ti is None else to_seconds(self.ti if ti is None else ti),
            None if tf is None and self.tf is None else to_seconds(self.tf if tf is None else tf),
            Nfts, Ncl, random_seed, sorted(drop_features), [[str(d) for d in pair] for pair in exclude_dates],
            list(use_only_features), sorted(compute_only_features), points,
        ]
        if classifier in _TREES:
            asked.append(forests.FITTED)  # sets stored as other tables are not read
        self.classifier, self.n_models = classifier, Ncl
        self.choice = f"{classifier}_{hashlib.sha256(json.dumps(asked).encode()).hexdigest()[:16]}"
        held = None if retrain else self._stored(f"selected_{self.choice}", _SELECTED)
        if held is not None and self._has_model() and self._find_run(self.choice):
            return selection.feature_frequency(held)
        features, labelled = self._raw_features(ti, tf, drop_features, compute_only_features)
        statistics = store.impute_statistics(features)
        statistics.write.mode("overwrite").parquet(self._path(f"statistics_{self.choice}"))
        features = store.impute(features, statistics=self._statistics())
        if use_only_features:
            features = selection.keep_features(features, use_only_features)
            Nfts = len(use_only_features) + 1
        labelled = labels.training_range(labels.exclude_ranges(labelled, exclude_dates), ti, tf)
        features = cut_lineage(features)
        samples = cut_lineage(sampling.undersample(labelled, Ncl, random_seed))
        stats = selection.mann_whitney(selection.ranked_values(samples, features))
        picked = cut_lineage(selection.select_topk(selection.p_values(stats), Nfts))
        tables.write_feature_lists(picked, self._path(f"selected_{self.choice}"))
        rows = cut_lineage(models.training_rows(samples, features, picked))
        folds = sampling.shuffle_split(samples, seed=random_seed)
        self._fit(rows, samples, folds, points, Nfts)
        self.run = uuid.uuid4().hex
        run = self.spark.createDataFrame([(self.run, self.choice, classifier, Ncl, time.time_ns() // 1000)], _RUNS)
        run.write.mode("append").parquet(self._path("runs"))
        return selection.feature_frequency(picked)

    def _statistics(self) -> DataFrame:
        """What fills gaps of the trained models' features."""
        return self.spark.read.schema(store.STATISTICS).parquet(self._path(f"statistics_{self.choice}"))

    def _find_run(self, choice: str | None = None) -> bool:
        """Take up the latest training run, of any choices or of these."""
        runs = self._stored("runs", _RUNS)
        if runs is None:
            return False
        latest = (runs if choice is None else runs.filter(F.col("choice") == choice)).orderBy(F.desc("trained_us")).first()
        if latest is None:
            return False
        self.run, self.choice, self.classifier, self.n_models = latest["run"], latest["choice"], latest["classifier"], latest["n_models"]
        return True

    def _has_model(self) -> bool:
        name = f"models_{self.choice}"
        if self.classifier not in _LOADERS:
            try:
                self.spark.read.parquet(self._path(name))
                return True
            except AnalysisException:
                return False
        try:
            self._load_estimators()
            return True
        except (AnalysisException, Py4JJavaError) as error:
            if "does not exist" in str(error) or "PATH_NOT_FOUND" in str(error):
                return False
            raise

    def _fit(self, rows: DataFrame, samples: DataFrame, folds: DataFrame, points: list[dict], n_features: int) -> None:
        path = self._path(f"models_{self.choice}")
        if self.classifier in _TREES:
            fitted, searched = forests.search_forests(rows, folds, points, self.classifier)
            searched.write.mode("overwrite").parquet(self._path(f"search_{self.choice}"))
            fitted.write.mode("overwrite").parquet(path)
        elif self.classifier == "NB":
            models.fit_bayes(rows, points[0]["var_smoothing"]).write.mode("overwrite").parquet(path)
        elif self.classifier == "KNN":
            best = models.search_neighbours(rows, folds, points)
            blocks = models.neighbour_blocks(rows)
            blocks.join(best, "model_id").write.mode("overwrite").parquet(path)
        elif self.classifier in linear.LOSSES:
            fitted, searched = linear.search_linear(rows, folds, self.classifier, points)
            searched.write.mode("overwrite").parquet(self._path(f"search_{self.choice}"))
            fitted.write.mode("overwrite").parquet(path)
        else:
            weights = sampling.class_weights(samples)
            fitted = models.fit_estimators(rows, weights, folds, self.classifier, self.n_models, n_features, points)
            for number, model in fitted.items():
                model.write().overwrite().save(os.path.join(path, f"{number:04d}"))

    def _members(self) -> DataFrame:
        """Numbers of the models that are stored."""
        if self.classifier in _LOADERS:
            return self.spark.range(len(self._load_estimators())).withColumnRenamed("id", "model_id")
        return self.spark.read.parquet(self._path(f"models_{self.choice}")).select("model_id").distinct()

    def _load_estimators(self) -> dict:
        base, loader = self._path(f"models_{self.choice}"), _LOADERS[self.classifier]
        return {n: loader.load(os.path.join(base, f"{n:04d}")) for n in range(self.n_models)}

    # ---- forecast ----------------------------------------------------------------------------------------

    def votes(self, features: DataFrame, picked: DataFrame) -> DataFrame:
        """Votes of all trained models on long features."""
        path = self._path(f"models_{self.choice}")
        if self.classifier in _TREES:
            return forests.forest_votes(features, self.spark.read.parquet(path))
        if self.classifier == "NB":
            return models.bayes_votes(features, self.spark.read.parquet(path))
        if self.classifier in linear.LOSSES:
            return linear.linear_votes(features, self.spark.read.parquet(path))
        inputs = models.input_rows(features, picked)
        if self.classifier == "KNN":
            return models.searched_neighbour_votes(inputs, self.spark.read.parquet(path))
        return models.estimator_votes(inputs, self._load_estimators())

    def _picked(self) -> DataFrame:
        if self.classifier is None and not self._find_run():
            raise ValueError("no fitted models yet: call train() first")
        picked = self._stored(f"selected_{self.choice}", _SELECTED)
        if picked is None:
            raise ValueError("no fitted models yet: call train() first")
        return picked

    def use_model(self, root: str, choice: str | None = None) -> "EventForecaster":
        """Take up the models that another folder holds for this geometry and these streams: the latest run, or that of ``choice``.
        Features and votes stay in this forecaster's folder."""
        other = EventForecaster.__new__(EventForecaster)
        other.__dict__.update(self.__dict__, root=root, run=None, classifier=None, choice=None)
        if not other._find_run(choice) or other._stored(f"selected_{other.choice}", _SELECTED) is None:
            raise ValueError(f"no fitted models in {root}")
        consensus.require_model_set(consensus.model_set_check(other._picked(), other._members()))
        self.run, self.choice, self.classifier, self.n_models = other.run, other.choice, other.classifier, other.n_models
        self._picked, self.votes, self._statistics = other._picked, other.votes, other._statistics
        return self

    def forecast(self, ti=None, tf=None, recalculate: bool = False, _predictions: str = "predictions") -> DataFrame:
        """Consensus ``station, win_end, consensus``. Stored votes are kept; only missing ones are computed."""
        picked, _predictions = self._picked(), f"{_predictions}_{self.run}"
        calculators = [r["calculator"] for r in selection.distinct_calculators(picked).collect()]
        features, labelled = self.get_features(ti, tf, (), calculators, self._statistics())
        held = None if recalculate else self._stored(_predictions, "model_id BIGINT, win_end BIGINT, pred DOUBLE, station BIGINT")
        wanted = labelled.select(
            "station", "win_end", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.n_models - 1).cast("bigint"))).alias("model_id")
        )
        if held is None:
            votes = cut_lineage(self.votes(features, picked))
        else:
            missing = cut_lineage(consensus.predict_missing(wanted, held))
            todo = features.join(missing.select("station", "win_end").distinct(), ["station", "win_end"], "left_semi")
            votes = cut_lineage(self.votes(todo, picked).join(missing, ["model_id", "station", "win_end"], "left_semi"))
        mode = "overwrite" if held is None else "append"
        votes.write.mode(mode).partitionBy("station").parquet(self._path(_predictions))
        all_votes = tables.read_predictions(self.spark, self._path(_predictions)).join(
            wanted, ["model_id", "station", "win_end"], "left_semi"
        )
        return consensus.consensus(all_votes, self.n_models)

    def hires_forecast(self, ti=None, tf=None, recalculate: bool = True, save_alerts: str | None = None, now: int | None = None) -> DataFrame:
        """Consensus at the step of the data, from only the calculators the models use. With ``save_alerts``
        the alert state of the last look-forward before ``now`` (epoch seconds) is appended there."""
        self._picked()
        fine = EventForecaster.__new__(EventForecaster)
        fine.__dict__.update(self.__dict__, geom=self.geom.at_data_rate(), root=self._path("hires"))
        fine._picked, fine.votes, fine._statistics = self._picked, self.votes, self._statistics
        ys = fine.forecast(ti, tf, recalculate)
        if save_alerts is not None:
            clock = now if now is not None else self.data.series.groupBy("station").agg((F.max("t1") * STEP_SECONDS).alias("now"))
            flags = alerts.alert_flag(ys, self.data.series.select("station"), clock, self.geom)
            tables.append_alert_flag(flags, save_alerts)
        return ys

    # ---- scores and tables behind the figures ------------------------------------------------------------

    def accuracy(self, ys: DataFrame) -> DataFrame:
        """Score table over 101 thresholds."""
        scored = labels.label_windows(ys.select("station", "win_end"), self.data.events, self.geom)
        return evaluate.threshold_sweep(ys, scored, self.data.events, self.geom)

    def curves(self, ys: DataFrame) -> DataFrame:
        return evaluate.score_curves(self.accuracy(ys))

    def alert_spans(self, ys: DataFrame, threshold: float = 0.75) -> DataFrame:
        return alerts.alert_cover(ys, self.geom, threshold)

    def top_features(self, N: int = 10) -> list[str]:
        """Names of the most used features, most used first."""
        return [r["feature"] for r in selection.feature_frequency(self._picked()).limit(N).collect()]

    def feature_tables(self, ti=None, tf=None, N: int = 10) -> tuple[DataFrame, DataFrame]:
        """Histograms of the top features over quiet windows, and their values near events."""
        features, labelled = self._top(ti, tf, N)
        return explore.feature_hist(features, labelled), explore.event_values(features, labelled, self.data.events)

    def feature_correlation(self, ti=None, tf=None, N: int = 20) -> DataFrame:
        features, _ = self._top(ti, tf, N)
        return explore.feature_corr(explore.quantile_trim(features), self.top_features(N))

    def _top(self, ti, tf, N: int) -> tuple[DataFrame, DataFrame]:
        names = self.top_features(N)
        features, labelled = self.get_features(ti, tf, (), sorted({n.split("__")[1] for n in names}))
        kept = selection.keep_features(features, names).select("station", "win_end", "feature", "value")
        return kept, labelled
