"""Vector files: shapefiles (.shp with .dbf) and GeoPackages, as rows of attributes and a geometry.

The bytes of a shapefile are cut into blocks of records, shapes and attributes alike, without being read further; blocks
meet by file and number, and many tasks decode them. A GeoPackage is read by one task. Attributes come as text in a map,
cast by the schema that the caller names; missing ones are null. A shape without a record, or the other way round, is an
error."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as G

ROW = f"file string, place bigint, attributes map<string,string>, geom {G.GEOM}, zs array<double>"
BATCH = 2000
#: Records of a shapefile that one row carries to the task that decodes them.
BLOCK = 2000


def _geom(kind: int, parts: list[list[np.ndarray]]) -> dict:
    return {"kind": kind, "parts": [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts]}


def _signed(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1])) / 2


def _holds(ring: np.ndarray, point: np.ndarray) -> bool:
    from ..functions import kernels

    return bool(kernels.inside(np.array([point]), [ring])[0] >= 0)


def polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Outlines (clockwise in this format) with their holes."""
    outer = [[r] for r in rings if _signed(r) <= 0]
    if not outer:
        return [[r] for r in rings]
    for hole in (r for r in rings if _signed(r) > 0):
        around = [p for p in outer if _holds(p[0], hole[0])] or outer
        min(around, key=lambda p: abs(_signed(p[0]))).append(hole)
    return outer


def shape_ends(raw: bytes) -> list[int]:
    """Where the records of a .shp file start, and the end of the last."""
    if struct.unpack_from(">i", raw)[0] != 9994:
        raise ValueError("not a shapefile")
    ends = [100]
    while ends[-1] + 8 <= len(raw):
        ends.append(ends[-1] + 8 + 2 * struct.unpack_from(">i", raw, ends[-1] + 4)[0])
    return ends


def shapes(raw: bytes) -> Iterator[tuple[dict | None, list[float]]]:
    """(shape, heights of its vertices) of some records of a .shp file; heights are empty without Z, M values are dropped."""
    at = 0
    while at + 8 <= len(raw):
        words = struct.unpack_from(">i", raw, at + 4)[0]
        body, at = at + 8, at + 8 + 2 * words
        code = struct.unpack_from("<i", raw, body)[0]
        high, kind = code // 10 == 1, code % 10
        if code == 0:
            yield None, []
        elif kind == 1:
            yield _geom(1, [[np.frombuffer(raw, "<f8", 2, body + 4).reshape(1, 2)]]), np.frombuffer(raw, "<f8", 1, body + 20).tolist() if high else []
        elif kind in (3, 5):
            n_parts, n_points = struct.unpack_from("<ii", raw, body + 36)
            starts = [*np.frombuffer(raw, "<i4", n_parts, body + 44).tolist(), n_points]
            xy = np.frombuffer(raw, "<f8", 2 * n_points, body + 44 + 4 * n_parts).reshape(-1, 2)
            rings = [xy[a:b] for a, b in zip(starts, starts[1:])]
            parts = polygons(rings) if kind == 5 else [[r] for r in rings]
            # after the points, two bounds of Z come first
            zs = np.frombuffer(raw, "<f8", n_points, body + 60 + 4 * n_parts + 16 * n_points).tolist() if high else []
            yield _geom((3 if kind == 5 else 2) if len(parts) == 1 else (6 if kind == 5 else 5), parts), zs
        else:
            raise ValueError(f"shapes of kind {code} are not read")


def records(head: bytes, raw: bytes, encoding: str) -> Iterator[dict[str, str | None] | None]:
    """Some records of a .dbf file with that head, None for those marked as deleted."""
    size = struct.unpack_from("<H", head, 10)[0]
    fields, at = [], 32
    while head[at] != 0x0D:
        fields.append((head[at : at + 11].split(b"\0")[0].decode(encoding), head[at + 16]))
        at += 32
    for k in range(len(raw) // size):
        at = k * size + 1
        row = {}
        for name, width in fields:
            row[name] = raw[at : at + width].decode(encoding).strip("\0 ") or None
            at += width
        yield None if raw[k * size] == 0x2A else row


def blocks(kind: str, raw: bytes) -> Iterator[tuple]:
    """(block, records of the whole file, shapes, head, attributes) of a .shp or .dbf file: the first block always, even if empty."""
    if kind == "shp":
        ends = shape_ends(raw)
        for k in range(0, max(1, len(ends) - 1), BLOCK):
            yield k // BLOCK, len(ends) - 1, raw[ends[k] : ends[min(k + BLOCK, len(ends) - 1)]], None, None
    else:
        n, head, size = struct.unpack_from("<IHH", raw, 4)
        for k in range(0, max(1, n), BLOCK):
            yield k // BLOCK, n, None, raw[:head], raw[head + k * size : head + min(k + BLOCK, n) * size]


_XY = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_GEOM = pa.struct([("kind", pa.int8()), ("parts", pa.list_(pa.list_(pa.list_(_XY))))])
SCHEMA = pa.schema([("file", pa.string()), ("place", pa.int64()), ("attributes", pa.map_(pa.string(), pa.string())), ("geom", _GEOM), ("zs", pa.list_(pa.float64()))])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    schema, held = SCHEMA, []

    def out() -> pa.RecordBatch:
        cols = list(zip(*held))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield out()
    if held:
        yield out()


def _named(df: DataFrame, schema: str, heights: bool) -> DataFrame:
    fields = StructType.fromDDL(schema).fields
    return df.select(*[F.try_element_at("attributes", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in fields], "geom", *["zs"] * heights, F.col("file").alias("source_file"))


def read_shapefiles(spark: SparkSession, path: str, schema: str, encoding: str = "utf-8", heights: bool = False) -> DataFrame:
    """The fields of ``schema``, geom and source_file of all .shp files under ``path``, with the .dbf beside each.

    ``heights``: also zs, the third coordinates of a shape's vertices."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(path)
    files = files.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("file"), F.substring_index("path", ".", -1).alias("kind"), "content")
    kinds = [("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("shp", pa.binary()), ("head", pa.binary()), ("dbf", pa.binary())]

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, kind, raw in zip(*(batch.column(k) for k in range(3))):
                for block in blocks(kind.as_py(), raw.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip((file.as_py(), *block), kinds)], names=[c for c, _ in kinds])

    part = files.mapInArrow(sliced, "file string, block bigint, n bigint, shp binary, head binary, dbf binary")
    some = lambda c: F.first(c, True).alias(c)
    both = part.groupBy("file", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), some("shp"), some("head"), some("dbf")).where("shp IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, least, most, shp, head, dbf in zip(*(batch.column(k) for k in range(7))):
                name, first = file.as_py(), block.as_py() * BLOCK
                # both files have a first block: it tells if their numbers differ
                if least.as_py() != most.as_py():
                    raise ValueError(f"{name} has {least} and {most} shapes and records")
                found = shapes(shp.as_py())
                pairs = zip(found, records(head.as_py(), dbf.as_py(), encoding), strict=True) if head.is_valid else ((s, {}) for s in found)
                yield from _batches((name, first + i, list(r.items()), *s) for i, (s, r) in enumerate(pairs) if r is not None)

    return _named(both.mapInArrow(run, ROW), schema, heights)


def wkb(raw: bytes, at: int = 0, zs: list[float] | None = None) -> tuple[dict | None, int]:
    """(geometry, end) of well-known binary; Z values are added to ``zs``, M values dropped."""
    order = "<" if raw[at] == 1 else ">"
    code = struct.unpack_from(order + "I", raw, at + 1)[0]
    at += 5
    high, wide = bool(code & 0x80000000), 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    if code >= 1000:
        high, wide, code = code // 1000 in (1, 3), 2 + (code // 1000 in (1, 3)) + (code // 1000 in (2, 3)), code % 1000

    def points(at: int, n: int) -> tuple[np.ndarray, int]:
        every = np.frombuffer(raw, order + "f8", wide * n, at).reshape(n, wide)
        if high and zs is not None:
            zs.extend(every[:, 2].tolist())
        return every[:, :2], at + 8 * wide * n

    def counted(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", raw, at)[0], at + 4

    if code == 1:
        xy, at = points(at, 1)
        return (None if np.isnan(xy).any() else _geom(1, [[xy]])), at
    if code == 2:
        n, at = counted(at)
        xy, at = points(at, n)
        return _geom(2, [[xy]]), at
    if code == 3:
        n, at = counted(at)
        rings = []
        for _ in range(n):
            k, at = counted(at)
            ring, at = points(at, k)
            rings.append(ring)
        return _geom(3, [rings]), at
    if code in (5, 6):
        n, at = counted(at)
        parts = []
        for _ in range(n):
            one, at = wkb(raw, at, zs)
            parts += one["parts"]
        return {"kind": code, "parts": parts}, at
    raise ValueError(f"geometry of kind {code} is not read")


def read_geopackages(spark: SparkSession, path: str, layer: str, schema: str, heights: bool = False) -> DataFrame:
    """The fields of ``schema``, geom and source_file of a layer of all .gpkg files under ``path``; ``heights``: also zs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        text = lambda v: None if v is None else str(v)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                db = sqlite3.connect(":memory:")
                db.deserialize(content.as_py())
                column = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
                if column is None:
                    raise ValueError(f"{name} has no layer {layer}")
                got = db.execute('SELECT * FROM "' + layer.replace('"', '""') + '"')
                names = [c[0] for c in got.description]
                g = names.index(column[0])

                def rows():
                    for i, row in enumerate(got):
                        blob = row[g]
                        # a header with an envelope of 0 to 8 numbers comes before the geometry
                        skip = 8 + 8 * (0, 4, 6, 6, 8)[blob[3] >> 1 & 7] if blob else 0
                        zs: list[float] = []
                        yield name, i, [(c, text(v)) for k, (c, v) in enumerate(zip(names, row)) if k != g], wkb(blob, skip, zs)[0] if blob else None, zs

                yield from _batches(rows())
                db.close()

    return _named(files.mapInArrow(run, ROW), schema, heights)


def wall_heights(walls: DataFrame, key: str) -> DataFrame:
    """(key, computed_height): the highest less the lowest vertex of each building's walls (key, zs); null if none has a height."""
    return walls.groupBy(key).agg((F.max(F.array_max("zs")) - F.min(F.array_min("zs"))).alias("computed_height"))


def walls_to_height(rows: DataFrame, key: str, kind: str, footprint: str, wall: str) -> DataFrame:
    """Footprints dissolved by building with the height of their walls, from building parts (key, kind, geom, zs, ...).

    Other columns are those of a building's first footprint, by their values. Buildings without walls have no row."""
    from ..operators.graph import dissolve

    others = [c for c in rows.columns if c not in (key, kind, "geom", "zs")]
    flat = rows.where(F.col(kind) == footprint)
    out = dissolve(flat.select(key, "geom"), key).join(wall_heights(rows.where(F.col(kind) == wall), key), key)
    return out.join(flat.groupBy(key).agg(*[F.min(F.struct(*others))[c].alias(c) for c in others]), key) if others else out
