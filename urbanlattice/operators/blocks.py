"""Features of blocks of touching buildings in windows around objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buildings import near_pairs, zero_filled

#: A member's columns and the names that their means and deviations carry.
MEASURES = {"BlockLength": "block_length", "BlockTotalFootprintArea": "block_footprint_area", "AvBlockFootprintArea": "block_av_footprint_area", "BlockOrientation": "block_orientation"}


def blocks_distance_based(df: DataFrame, members: DataFrame, sizes=(100.0, 500.0), mode: str = "bbox", count: bool = True, means=tuple(MEASURES), deviations=tuple(MEASURES)) -> DataFrame:
    """Number of blocks, and means and sample deviations of their measures, in buffers around (id, geom); 0 where there's none.

    ``members``: id, geom, BlockId, BlockLength and the other MEASURES of each building. A block counts once if any of its
    buildings meets the buffer; a building on its own is no block. All sizes come from the pairs of the largest."""
    asked = list(dict.fromkeys([*means, *deviations]))
    blocks = members.where("BlockLength > 1").select("id", "geom", "BlockId", *[F.col(c).cast("double").alias(c) for c in asked])
    pairs, near = near_pairs(df, blocks, list(sizes), mode)
    # one row a block and object, before anything is averaged
    once = pairs.groupBy("id", "r_BlockId").agg(*[F.max(near(b)).alias(f"_near_{b:g}") for b in sizes], *[F.first(f"r_{c}").alias(c) for c in asked])
    aggs = []
    for b in sizes:
        at = F.col(f"`_near_{b:g}`")
        aggs += [F.sum(at.cast("double")).alias(f"blocks_within_buffer_{b:g}")] if count else []
        aggs += [F.avg(F.when(at, F.col(c))).alias(f"av_{MEASURES[c]}_within_buffer_{b:g}") for c in means]
        aggs += [F.stddev_samp(F.when(at, F.col(c))).alias(f"std_{MEASURES[c]}_within_buffer_{b:g}") for c in deviations]
    return zero_filled(df, once.groupBy("id").agg(*aggs))
