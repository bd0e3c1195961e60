"""Window features that need linear algebra, a transform or pairwise distances: Arrow batches of windows.

Spark distributes the windows; a task sees one batch of ``ARRAY<DOUBLE>`` windows at a time, stacks it, and
returns one array of values per window, which is unrolled to long rows on the JVM side.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.functions.kernels import FEATURE_OF, KERNELS
from foreshock.operators.features_agg import KEYS

NAMES = tuple(KERNELS)
#: Windows that the kernels hold at once. Designs of a window are many times its size, and those of a whole Arrow batch fit no cache.
BATCH = 64


def _labels(calculator: str) -> list[tuple[str, str]]:
    """Calculator and params of each output value of a kernel, in order."""
    shape = KERNELS[calculator](np.arange(32, dtype=float).reshape(1, -1) % 7)
    return [(name, p) for name in FEATURE_OF.get(calculator, (calculator,)) for p in shape]


def window_arrow_features(arrays: DataFrame, calculators: Iterable[str]) -> DataFrame:
    """Long features ``station, win_end, stream, calculator, params, feature, value`` of ``window_arrays`` rows.

    Values that do not exist for a window come out as NaN, as in the library of feature definitions.
    """
    wanted = list(calculators)
    bad = [c for c in wanted if c not in KERNELS]
    if bad:
        raise ValueError(f"unknown calculators {bad}")
    labels = [pair for c in wanted for pair in _labels(c)]

    @F.pandas_udf("array<double>")
    def values(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        found = []
        for at in range(0, len(x), BATCH):
            batch = np.stack(x.iloc[at : at + BATCH].to_numpy()).astype(float)
            columns = []
            for c in wanted:
                columns += [v for out in [KERNELS[c](batch)] for v in out.values()] * len(FEATURE_OF.get(c, (c,)))
            found.extend(np.stack(columns, axis=1))
        return pd.Series(found)

    names = ", ".join(f"named_struct('calculator', '{c}', 'params', '{p}')" for c, p in labels)
    computed = arrays.select(*KEYS, values("x").alias("vals"))
    return computed.selectExpr(
        "station", "win_end", "stream", f"inline(arrays_zip(array({names}), vals)) AS (what, value)"
    ).selectExpr(
        "station", "win_end", "stream", "what.calculator", "what.params",
        "concat_ws('__', stream, what.calculator, nullif(what.params, '')) AS feature", "value",
    )
