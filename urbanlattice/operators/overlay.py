"""Buffers, overlay pieces and repair of polygons as Arrow-batched column functions and the tables that rest on them.

Null geometries give null; an empty result is null too. Values that are no polygons have no overlay pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import overlay as O
from ..session import cut, spread
from .spatial_join import envelope_join

AREAL = (3, 6)


def buffer(geom: Column, by: Column | float) -> Column:
    """All within ``by`` of a geometry, corners round in quarters of 16 segments; of polygons and a negative ``by``, what is
    that far inside. A buffer of 0 makes rings of a polygon valid."""

    @G.arrowed(G.GEOM)
    def udf(g: pa.Array, r: pa.Array) -> pa.Array:
        shapes, by = G.Shapes(g), r.to_pylist()
        at = [i for i in range(len(shapes)) if shapes.known[i] and by[i] is not None]
        made = dict(zip(at, O.buffers([(int(shapes.kinds[i]), shapes[i], by[i]) for i in at])))
        return G.column_of([G.polygon_row(made[i]) if i in made else None for i in range(len(shapes))])

    return udf(geom, by.cast("double") if isinstance(by, Column) else F.lit(float(by)))


def buffer_measures(geom: Column, by: list[float]) -> Column:
    """struct<area0, rings0, parts0, area1, ...> of the buffers by each of ``by``, whose vertices don't leave the kernel: null areas
    for null and empty ones, which have no rings."""

    @G.arrowed(", ".join(f"area{k} double, rings{k} bigint, parts{k} bigint" for k in range(len(by))))
    def udf(g: pa.Array) -> pa.Array:
        shapes, columns = G.Shapes(g), {}
        at = np.flatnonzero(shapes.known)
        asked = [(int(shapes.kinds[i]), shapes[i]) for i in at]
        for k, r in enumerate(by):
            made = O.buffers([(kind, parts, r) for kind, parts in asked])
            area, rings, parts = np.zeros(len(shapes)), np.zeros(len(shapes), np.int64), np.zeros(len(shapes), np.int64)
            area[at], rings[at], parts[at] = O.areas(made), [sum(map(len, m)) for m in made], [len(m) for m in made]
            columns |= {f"area{k}": pa.array(area, mask=parts == 0), f"rings{k}": pa.array(rings), f"parts{k}": pa.array(parts)}
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return udf(geom)


def _binary(f):
    @G.arrowed(G.GEOM)
    def udf(a: pa.Array, b: pa.Array) -> pa.Array:
        one, two = G.Shapes(a), G.Shapes(b)
        at = [i for i in range(len(one)) if all(s.known[i] and s.kinds[i] in AREAL for s in (one, two))]
        made = dict(zip(at, O.together([f(one[i], two[i]) for i in at])))
        return G.column_of([G.polygon_row(made[i]) if i in made else None for i in range(len(one))])

    return udf


#: The part of the first in the second, as geometry; null if they share no area.
intersection = _binary(O.intersecting)
#: The part of the first outside the second; null if nothing is left.
difference = _binary(O.differing)


def repaired(geom: Column) -> Column:
    """struct<geom, was_invalid>: polygons made valid by the even-odd rule over their rings, each part of a multi-polygon by
    itself, and parts united; others as they are."""

    @G.arrowed(f"struct<geom:{G.GEOM},was_invalid:boolean>")
    def udf(g: pa.Array) -> pa.Array:
        shapes, rows, wrong = G.Shapes(g), [], []
        areal = [i for i, k in enumerate(shapes.kinds) if k in AREAL and shapes[i] is not None]
        found = iter(O.together([O.repairing([p]) for i in areal for p in shapes[i]]))
        for i, k in enumerate(shapes.kinds):
            parts = shapes[i]
            if parts is None:
                row, bad = None, None
            elif k in AREAL:
                each = [next(found) for _ in parts]
                made, bad = [q for m, _ in each for q in m], any(b for _, b in each)
                # what is valid and single keeps its vertices
                row = G.polygon_row(O.union(made) if len(parts) > 1 else made) if bad or len(parts) > 1 else (int(k), parts)
            else:
                row, bad = (int(k), parts), False
            rows.append(row)
            wrong.append(bad)
        return pa.StructArray.from_arrays([G.column_of(rows), pa.array(wrong, pa.bool_())], ["geom", "was_invalid"])

    return udf(geom)


def single_polygons(df: DataFrame, by: float = 0.01) -> tuple[DataFrame, int]:
    """(rows with polygons alone, multi-polygons before). If there's any multi-polygon, all rows are buffered by ``by``, and
    of those that are still in parts the largest part stays."""
    before = df.where("geom.kind = 6 AND size(geom.parts) > 1").count()
    if not before:
        return df, 0
    others = [c for c in df.columns if c != "geom"]
    grown = G.hold(spread(df.withColumnRenamed("geom", "_g")), "_b", buffer(F.col("_g"), by))
    return grown.select(*others, G.largest_part(F.col("_b")).alias("geom")).select(*df.columns), before


def pieces(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """The pieces in which polygons ``left`` (id, geom, ...) and ``right`` (other, shape, ...) overlap: both sides' columns but the
    geometries, and ``piece``. Only pairs whose envelopes overlap meet."""
    a = G.hold(spread(left), "l_env", G.envelope(F.col("geom")))
    b = G.hold(spread(right), "r_env", G.envelope(F.col("shape")))
    e, w = F.col("l_env"), F.col("r_env")
    inner = (e["minx"] < w["maxx"]) & (w["minx"] < e["maxx"]) & (e["miny"] < w["maxy"]) & (w["miny"] < e["maxy"])
    met = G.hold(envelope_join(a, b, size).where(inner), "piece", intersection("geom", "shape"))
    return met.where("piece IS NOT NULL").drop("l_env", "r_env", "geom", "shape")


def boundary_file(gadm: DataFrame, local: Column, levels: list[str], buffers: tuple[float, float] = (500.0, 2000.0)) -> DataFrame:
    """One row for each boundary (NAME_0, NAME_1, ..., geom in longitude and latitude): country, region, city, the boundary as
    WKT in both systems and its two buffers, and ``path``, the folders of ``levels``. ``local``: the geometry in metres."""
    at = G.hold(spread(gadm), "_l", local)
    for k, by in enumerate(buffers):
        at = G.hold(at, f"_b{k}", buffer(F.col("_l"), by))
    names = ("boundary_GADM_500m_buffer", "boundary_GADM_2k_buffer")
    return at.select(
        F.col("NAME_0").alias("country"), F.col("NAME_1").alias("region"), F.col(levels[-1]).alias("city"), G.as_wkt(F.col("geom")).alias("boundary_GADM_WGS84"), G.as_wkt(F.col("_l")).alias("boundary_GADM"),
        *[G.as_wkt(F.col(f"_b{k}")).alias(n) for k, n in enumerate(names)], F.concat_ws("/", *levels).alias("path"),
    )


def inside_by(df: DataFrame, boundary: DataFrame, by: float, size: float) -> DataFrame:
    """Rows of ``df`` (id, geom, ...) within the largest part of ``boundary``'s (geom) polygons shrunk by ``by``."""
    from .spatial_join import spatial_join

    core = cut(G.hold(boundary.select(F.col("geom").alias("_b")), "_s", buffer(F.col("_b"), -by)).where("_s IS NOT NULL").select(G.largest_part(F.col("_s")).alias("_core")))
    return spatial_join(df, core, "geom", "_core", "within", size).select(*df.columns)
