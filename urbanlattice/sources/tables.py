"""Tabular sources and sinks: CSV with WKT, trips, boundaries, city paths, run statistics."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G


def read_csv_wkt(spark: SparkSession, path, schema: str, geometry_col: str = "geometry") -> DataFrame:
    """CSV with a WKT column, parsed to ``geom``. Paths may be lists or globs."""
    df = spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True)
    return df.withColumn("geom", G.from_wkt(F.col(geometry_col))).drop(geometry_col)


def write_csv_wkt(df: DataFrame, path: str, geometry_col: str = "geometry", partition_by=()) -> None:
    """The geometry as WKT; ``partition_by``: country, region, city and the like."""
    out = df.withColumn(geometry_col, G.as_wkt(F.col("geom"))).drop("geom")
    w = out.write.mode("overwrite").option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


TRIPS = "tripid string, tripdistancemeters double, lengthoftrip double, startdate string, enddate string, startloclat double, startloclon double, endloclat double, endloclon double, providertype string"


def read_trips(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """One CSV as two point tables: origins and destinations."""
    df = spark.read.csv(path, header=True, schema=TRIPS)
    keep = ["tripid", "tripdistancemeters", "lengthoftrip", "startdate", "enddate", "providertype"]
    at = lambda lon, lat: df.select(*keep, G.point(F.col(lon), F.col(lat)).alias("geom"))
    return at("startloclon", "startloclat"), at("endloclon", "endloclat")


def lau(areas: DataFrame, extra: DataFrame) -> DataFrame:
    """Areas with what is known of them besides, by LAU_ID; those of which nothing is known have no row."""
    return areas.join(extra, "LAU_ID")


def read_lau(spark: SparkSession, path: str, extra: str, schema: str, extra_schema: str) -> DataFrame:
    """Local areas of a shapefile (fields of ``schema``) joined with a CSV (``extra_schema``) on LAU_ID."""
    from .vector import read_shapefiles

    return lau(read_shapefiles(spark, path, schema).drop("source_file"), spark.read.csv(extra, header=True, schema=extra_schema))


def nuts(local: DataFrame) -> DataFrame:
    """Regions: local areas dissolved by NUTS_ID, with the other columns of the least LAU_ID."""
    from ..operators.graph import dissolve

    others = [c for c in local.columns if c not in ("NUTS_ID", "geom")]
    first = local.groupBy("NUTS_ID").agg(F.min_by(F.struct(*others), "LAU_ID").alias("_f")).select("NUTS_ID", "_f.*")
    return dissolve(local.select("NUTS_ID", "geom"), "NUTS_ID").join(first, "NUTS_ID")


SHEET = "gadm_code string, country_name string, level_city string, all_levels string, local_crs string"


def read_gadm(spark: SparkSession, root: str, code: str, schema: str, levels: str = "all", sheet: str = "gadm_table.csv") -> tuple[DataFrame, str, list[str] | str, str]:
    """(boundaries of a country's city level, country, its levels or the city level, its local system), by the sheet's row.

    ``schema``: the boundary file's fields, NAME_0 and so on. Of several rows of a code the first in the sheet counts."""
    from .vector import read_shapefiles

    # columns are found by their names, in whatever order the sheet has them
    rows = spark.read.csv(f"{root}/{sheet}", header=True).select(*[F.col(c.split()[0]) for c in SHEET.split(", ")]).where(F.col("gadm_code") == code).head(1)
    if not rows:
        raise ValueError(f"no row of {code} in {sheet}")
    r = rows[0]
    shapes = read_shapefiles(spark, f"{root}/{r['country_name']}/gadm36_{code}_{r['level_city']}.*", schema).drop("source_file")
    return shapes, r["country_name"], levels_of(r["all_levels"]) if levels == "all" else r["level_city"], r["local_crs"]


def city_paths(spark: SparkSession, root: str, country: str, filename: str, variant: str = "paths") -> list[str]:
    """Files of a country's cities, from its path list (plain, osm, failed or ua variant: one base path a line)."""
    rows = spark.read.text(f"{root}/{country}/{variant}_{country}.txt").where("trim(value) != ''").collect()
    return [f"{r['value'].strip()}_{filename}.csv" for r in rows]


BOUNDARY = ("country", "region", "city", "boundary_GADM_WGS84", "boundary_GADM", "boundary_GADM_500m_buffer", "boundary_GADM_2k_buffer")


def write_boundaries(rows: DataFrame, root: str) -> None:
    """Boundary rows as CSV under the folders of ``path``: one folder a boundary, which the list of paths in ``_paths`` names."""
    rows.write.partitionBy("path").option("header", True).csv(f"{root}/boundaries")
    rows.select("path").write.text(f"{root}/_paths")


def read_boundaries(spark: SparkSession, root: str) -> DataFrame:
    """All boundary rows below a folder, with their path."""
    return spark.read.option("header", True).option("multiLine", False).schema(", ".join(f"{c} string" for c in (*BOUNDARY, "path"))).csv(f"{root}/boundaries")


def boundary_of(gadm: DataFrame, level: str, name: str) -> DataFrame:
    """One boundary of that name; of several the first by the names of all levels, then by geometry."""
    return gadm.where(F.col(level) == name).orderBy(*sorted(c for c in gadm.columns if c.startswith("NAME_")), "geom").limit(1)


def levels_of(text: str) -> list[str]:
    """A list of column names that a sheet holds as text; never evaluated as code."""
    return [x.strip().strip("'\"") for x in text.strip().strip("[]").split(",") if x.strip()]


def run_statistics(spark: SparkSession, stats: dict, seconds: float, path: str) -> None:
    """One CSV row: the statistics, the duration as hours, minutes and seconds, the date."""
    s = int(seconds)
    row = {**{k: str(v) for k, v in stats.items()}, "duration": f"{s // 3600}h {s % 3600 // 60}m {s % 60}s", "date": datetime.date.today().isoformat()}
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def xpath_range(first: str, last: str) -> list[str]:
    """All paths between two that differ in one number."""
    import re

    a, b = re.split(r"(\d+)", first), re.split(r"(\d+)", last)
    at = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    if len(a) != len(b) or len(at) > 1:
        raise ValueError("the paths must differ in one number")
    if not at:
        return [first]
    i = at[0]
    return ["".join([*a[:i], str(n), *a[i + 1 :]]) for n in range(int(a[i]), int(b[i]) + 1)]
