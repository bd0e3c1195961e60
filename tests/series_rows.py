"""Series for tests."""


def make_series(spark, values: dict[int, list[list[float]]], start: int = 2_800_000):
    """Gridded series: station -> rows of (rsam, mf, hf, dsar) from grid index ``start``."""
    data = [
        (station, start + i, start, start + len(rows) - 1, *map(float, r)) for station, rows in values.items() for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, "station BIGINT, idx BIGINT, t0 BIGINT, t1 BIGINT, rsam DOUBLE, mf DOUBLE, hf DOUBLE, dsar DOUBLE")
