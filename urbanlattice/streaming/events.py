"""Point events as a stream: counted by area and time window, late ones up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.spatial_join import envelope_join, intersects


def counts_by_area(points: DataFrame, areas: DataFrame, width: str, late: str, size: float, time: str = "ts") -> DataFrame:
    """(window, area, n): events (x, y, ``time``) of a stream in each of ``areas`` (id, geom; static) by time windows of ``width``.

    The areas are joined by grid cells of ``size``, as in batch. A point on a shared edge counts in both areas. Events later
    than ``late`` behind the newest one are left out, which bounds the state to the windows still open."""
    at = G.hold(points.withWatermark(time, late).select(F.col(time).alias("_ts"), G.point(F.col("x"), F.col("y")).alias("_p")), "l_env", G.envelope(F.col("_p")))
    held = G.hold(areas.select(F.col("id").alias("area"), F.col("geom").alias("_a")), "r_env", G.envelope(F.col("_a")))
    pairs = envelope_join(at, held, size).where(intersects("_p", "_a"))
    return pairs.groupBy(F.window("_ts", width).alias("window"), "area").agg(F.count(F.lit(1)).alias("n"))
