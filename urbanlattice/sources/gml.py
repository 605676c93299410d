"""Building models in GML: rows by element, fields by XPath on element names, heights and footprints.

Files are split by byte ranges at the ends of building elements, so that a city's file is read by many tasks and never
whole; each element becomes a row and every field an expression over its fragment, so that values nested in building parts
are found too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G


def elements(spark: SparkSession, path, tag: str = "bldg:Building") -> DataFrame:
    """(source_file, place, fragment): every element of that tag; ``place`` rises in file order.

    The text source ends records at the closing tag, wherever the splits of a file fall. Elements of one tag don't contain
    each other; closing tags have no blanks."""
    rows = spark.read.option("lineSep", f"</{tag}>").text(path).select(F.col("_metadata.file_path").alias("source_file"), "value")
    start = F.regexp_extract("value", rf"(?s)<{tag}[\s>].*", 0)
    # what follows the last element of a file has no start
    return rows.select("source_file", F.monotonically_increasing_id().alias("place"), F.concat(start, F.lit(f"</{tag}>")).alias("fragment"), start.alias("_s")).where("_s != ''").drop("_s")


def attribute(fragment: Column, name: str) -> Column:
    """An attribute of the element itself, such as gml:id."""
    return F.nullif(F.regexp_extract(fragment, rf'^<[^>]*?\s{name}="([^"]*)"', 1), F.lit(""))


def texts(fragment: Column, path: str) -> Column:
    """Texts of all descendants by an XPath on full names, e.g. ``//*[name()="gml:posList"]``."""
    return F.xpath(fragment, F.lit(path + "/text()"))



def numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != ""), lambda s: s.cast("double"))


def measured_height(fragment: Column, tag: str = "bldg:measuredHeight", lenient: bool = False) -> Column:
    """The largest number among the texts of a tag. ``lenient``, for data sets with texts that are no numbers (Vantaa's and
    Hamburg's): those count for nothing; else they are an error."""
    return F.array_max(F.transform(texts(fragment, f'//*[name()="{tag}"]'), lambda t: t.try_cast("double") if lenient else t.cast("double")))


def first_text(fragment: Column, path: str) -> Column:
    """Text of the first match, or null."""
    return F.get(texts(fragment, path), 0)


def string_attribute(fragment: Column, name: str) -> Column:
    return first_text(fragment, f'//*[name()="gen:stringAttribute"][@name="{name}"]/*[name()="gen:value"]')


def child_attribute(fragment: Column, tag: str, key: str) -> Column:
    return F.get(F.xpath(fragment, F.lit(f'//*[name()="{tag}"]/@{key}')), 0)


def envelope_height(fragment: Column) -> Column:
    """Upper less lower corner's third number."""
    at = lambda tag: F.get(numbers(first_text(fragment, f'//*[name()="{tag}"]')), 2)
    return at("gml:upperCorner") - at("gml:lowerCorner")


def surface_heights(fragment: Column, surface: str) -> Column:
    """All third numbers of the position lists below elements of that tag."""
    lists = texts(fragment, f'//*[name()="{surface}"]//*[name()="gml:posList"]')
    return F.flatten(F.transform(lists, lambda t: F.filter(numbers(t), lambda _, i: i % 3 == 2)))


def wall_height(fragment: Column, surface: str = "bldg:WallSurface") -> Column:
    z = surface_heights(fragment, surface)
    return F.bround(F.array_max(z) - F.array_min(z), 2)


def roof_over_wall(fragment: Column) -> Column:
    """Lowest roof point over the lowest wall point."""
    return F.bround(F.array_min(surface_heights(fragment, "bldg:RoofSurface")) - F.array_min(surface_heights(fragment, "bldg:WallSurface")), 2)


def height_and_mean(fragment: Column, surface: str) -> Column:
    """struct<height, mean>: how far a surface's points rise, and their mean height."""
    z = surface_heights(fragment, surface)
    mean = F.try_divide(F.aggregate(z, F.lit(0.0), lambda s, x: s + x), F.size(z))
    return F.struct(F.bround(F.array_max(z) - F.array_min(z), 2).alias("height"), mean.alias("mean"))


def rings(lists: Column, dim: int = 3, swap: bool = False) -> Column:
    """Position lists of ``dim`` numbers a point as a multi-polygon (a polygon if one); axes swapped on demand."""

    def ring(t):
        n = numbers(t)
        last = F.greatest((F.size(n) / dim).cast("int") - 1, F.lit(0))
        x, y = (1, 0) if swap else (0, 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.get(n, i * dim + x).alias("x"), F.get(n, i * dim + y).alias("y")))

    parts = F.transform(lists, lambda t: F.array(ring(t)))
    return F.when(F.size(lists) > 0, F.struct(F.when(F.size(lists) == 1, 3).otherwise(6).cast("tinyint").alias("kind"), parts.alias("parts")).cast(G.GEOM))


def positions(fragment: Column, ring: str = "gml:LinearRing") -> Column:
    """The texts of single gml:pos elements below each ring, as one position list a ring; lists that are whole stay as they are."""
    rings_ = F.regexp_extract_all(fragment, F.lit(rf"(?s)<{ring}[\s>].*?</{ring}>"), F.lit(0))
    return F.filter(F.transform(rings_, lambda r: F.array_join(F.regexp_extract_all(r, F.lit(r"(?s)<gml:pos(?:List)?(?:\s[^>]*)?>([^<]*)</gml:pos(?:List)?>"), F.lit(1)), " ")), lambda t: t != "")


def section(fragment: Column, tag: str) -> Column:
    """All elements of a tag in a fragment, one after another."""
    return F.array_join(F.regexp_extract_all(fragment, F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0)), "")


def hamburg_footprint(fragment: Column, surface: str = "bldg:GroundSurface", dim: int = 3, swap: bool = False) -> Column:
    """Footprints whose rings list single points (gml:pos within gml:LinearRing), a multi-polygon of all rings."""
    return rings(positions(section(fragment, surface)), dim, swap)


def swapped_axes(fragment: Column, source: int, surface: str = "bldg:GroundSurface", dim: int = 3) -> Column:
    """Whether an element's first vertex shows that its axes are swapped; null without one."""
    from ..functions.crs import axes_confused

    first = numbers(F.get(positions(section(fragment, surface)), 0))
    return axes_confused(F.struct(F.get(first, 0).alias("x"), F.get(first, 1).alias("y")), source)


def with_footprints(df: DataFrame, source: int, surface: str = "bldg:GroundSurface", dim: int = 3) -> DataFrame:
    """``df`` (fragment, ...) with geom and was_invalid: footprints with their axes in order, rings made valid and united.

    Rings are those of gml:pos and gml:posList elements alike; the axes' order is told by the first vertex."""
    from ..operators.overlay import repaired

    f = F.col("fragment")
    at = G.hold(G.hold(df, "_lists", positions(section(f, surface))), "_swap", F.coalesce(swapped_axes(f, source, surface, dim), F.lit(False)))
    at = G.hold(at, "_g", F.when(F.col("_swap"), rings(F.col("_lists"), dim, True)).otherwise(rings(F.col("_lists"), dim)))
    return G.hold(at, "_r", repaired(F.col("_g"))).select(*df.columns, F.col("_r.geom").alias("geom"), F.col("_r.was_invalid").alias("was_invalid"))


def footprint(fragment: Column, surface: str = "bldg:GroundSurface", dim: int = 3, swap: bool = False) -> Column:
    return rings(texts(fragment, f'//*[name()="{surface}"]//*[name()="gml:posList"]'), dim, swap)


def roof_type(fragment: Column, surface: str = "bldg:RoofSurface") -> Column:
    """``flat roof`` if the largest roof surface (the first on ties) lies level, else ``slanted roof``; null without one."""
    lists = texts(fragment, f'//*[name()="{surface}"]//*[name()="gml:posList"]')

    def of(t):
        z = F.filter(numbers(t), lambda _, i: i % 3 == 2)
        return F.struct(G.area(rings(F.array(t))).alias("a"), (F.array_min(z) == F.array_max(z)).alias("flat"))

    each = F.transform(lists, of)
    best = F.aggregate(each, F.get(each, 0), lambda s, x: F.when(x["a"] > s["a"], x).otherwise(s))
    return F.when(F.size(lists) > 0, F.when(best["flat"], "flat roof").otherwise("slanted roof"))


def read_citygml(spark: SparkSession, path, country=None, region=None, city=None, district=None) -> DataFrame:
    """id, height, height_bbox, measured_height, country, region, city, district, source_file, geom; a file without buildings gives no rows."""
    f = F.col("fragment")
    names = [F.lit(v).cast("string").alias(k) for k, v in (("country", country), ("region", region), ("city", city), ("district", district))]
    return elements(spark, path).select(attribute(f, "gml:id").alias("id"), wall_height(f).alias("height"), envelope_height(f).alias("height_bbox"), measured_height(f).alias("measured_height"), *names, "source_file", footprint(f).alias("geom"))
