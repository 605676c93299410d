"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Sums come in any order: both sides round. Adding 0 turns -0 into 0."""
    return df.select(*[(F.round(F.col(f"`{c}`"), places) + 0.0).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])
