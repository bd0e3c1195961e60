from foreshock.plans import queries_alerts, queries_features, queries_models, queries_series, queries_streaming  # noqa: F401
from foreshock.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
