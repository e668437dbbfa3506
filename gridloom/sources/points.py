"""Point tables: any DataFrame by naming its columns, and views of the driver's tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Named = str | Column


def _column(value: Named) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _double(value: Named) -> Column:
    number = _column(value).cast("double")
    return F.when(~F.isnan(number), number)


def point_table(
    df: DataFrame, x: Named, y: Named, z: Named, *, point_id: Named, tile_id: Named | None = None, fields: Mapping[str, Named] | None = None
) -> DataFrame:
    """The canonical point table: ids and doubles, NaN as NULL.  Column pruning reaches the scan.

    Without ``tile_id`` all points are of tile ``0``.  ``fields`` names scalar fields.
    """
    tile = F.lit("0") if tile_id is None else _column(tile_id).cast("string")
    return df.select(
        tile.alias("tile_id"), _column(point_id).cast("bigint").alias("point_id"), *[_double(c).alias(n) for n, c in zip("xyz", (x, y, z), strict=True)],
        *[_double(c).alias(n) for n, c in (fields or {}).items()],
    )


def read_points(spark: SparkSession, path: str, x: str = "x", y: str = "y", z: str = "z", *, point_id: str = "point_id", tile_id: str | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """A point table from Parquet."""
    return point_table(spark.read.parquet(path), x, y, z, point_id=point_id, tile_id=tile_id, fields={f: f for f in fields})


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as points: the first three components place a vector, the fourth is its intensity, the label is the tile."""
    part = [F.col("embedding")[i] for i in range(4)]
    return point_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), *part[:3], point_id="vec_id", tile_id="label", fields={"intensity": part[3]})


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as points: customer, day and price; the status is the tile."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return point_table(df, "o_custkey", day, "o_totalprice", point_id="o_orderkey", tile_id="o_orderstatus")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as points: second, user and value; the event type is the tile."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return point_table(df, F.unix_timestamp("ts"), "user_id", "value", point_id="event_id", tile_id="event_type")
