from __future__ import annotations

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def raster_of(spark, values, tile="t"):
    """A raster of one tile from a 2-D array; NaN is missing."""
    from gridloom.schema import Raster, Resolution

    a = np.asarray(values, dtype=float)
    rows = [(tile, y, x, None if np.isnan(a[y, x]) else float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return Raster(spark.createDataFrame(rows, "tile_id string, y int, x int, v double"), Resolution(a.shape[1], a.shape[0]))


def array_of(raster, band=None):
    """A raster of one tile as a 2-D array; missing is NaN."""
    out = np.full((raster.size.height, raster.size.width), np.nan)
    rows = raster.df.select("y", "x", band or raster.single).collect()
    assert len(rows) == out.size
    for y, x, v in rows:
        out[y, x] = np.nan if v is None else v
    return out
