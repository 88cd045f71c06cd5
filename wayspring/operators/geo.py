"""Offline geography: projection, line simplification, SVG paths, bounds, centres
and short place names."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspring.runtime import ship, table

# The map's frame in degrees and in drawing units.
SOUTH, NORTH, WEST, EAST = 17.5, 53.563269, 73.502355, 135.09567
WIDTH, HEIGHT, PAD_X, PAD_Y = 1000.0, 720.0, 30.0, 24.0
SHRINK = math.cos(math.radians((SOUTH + NORTH) / 2))
SCALE = min((WIDTH - 2 * PAD_X) / ((EAST - WEST) * SHRINK), (HEIGHT - 2 * PAD_Y) / (NORTH - SOUTH))
TOP = (HEIGHT - (NORTH - SOUTH) * SCALE) / 2
# Suffixes of place names, the longest first.
PROVINCE_SUFFIXES = ("特别行政区", "维吾尔自治区", "壮族自治区", "回族自治区", "自治区", "省", "市")
PREFECTURE = "自治州"
# First characters of the peoples in names of autonomous prefectures.
PEOPLES = "维回藏彝苗侗布壮傣景傈哈土朝蒙柯白"
CITY_SUFFIXES = ("特别行政区", "自治区", "地区", "盟", "市", "州")


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Equirectangular x and y of a point."""
    return F.lit(PAD_X) + (lon - WEST) * SHRINK * SCALE, F.lit(TOP) + (F.lit(NORTH) - lat) * SCALE


def short_name(name: Column, suffixes=CITY_SUFFIXES) -> Column:
    """name without its first matching suffix; a name that is one stays. An
    autonomous prefecture ends before the first people it names."""
    out = name
    for s in reversed(suffixes):
        out = F.when(name.endswith(s) & (F.length(name) > len(s)), F.substring(name, F.lit(1), F.length(name) - len(s))).otherwise(out)
    before = F.regexp_extract(name, f"^([^{PEOPLES}]*)[{PEOPLES}]", 1)
    return F.when(name.endswith(PREFECTURE) & (F.length(before) > 0), before).otherwise(out)


def simplify(points: np.ndarray, eps: float) -> np.ndarray:
    """Points of a line that deviate more than eps from what is left without them;
    iterative, so a line of any length is safe."""
    n = len(points)
    if n < 3:
        return points
    keep = np.zeros(n, dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        span, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        base = math.hypot(*span)
        off = np.hypot(inner[:, 0], inner[:, 1]) if base == 0 else np.abs(span[0] * inner[:, 1] - span[1] * inner[:, 0]) / base
        k = int(off.argmax())
        if off[k] > eps:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def ring_path(points: np.ndarray, most: float = 0.35, share: float = 0.02, least: float = 4.0) -> str:
    """SVG path of a ring, simplified by the lesser of `most` and `share` of its
    diagonal; small rings stay whole, fewer than three points draw nothing."""
    points = np.asarray(points, dtype=float).reshape(-1, 2)
    if len(points) >= 4:
        diagonal = math.hypot(*np.ptp(points, axis=0))
        if diagonal >= least:
            points = simplify(points, min(most, diagonal * share))
    if len(points) < 3:
        return ""
    show = lambda v: f"{round(float(v), 1):g}"
    return "M" + "L".join(f"{show(x)} {show(y)}" for x, y in points) + "Z"


def kept_rings(rings: Column, south: float = SOUTH) -> Column:
    """Rings (array<array<array<double>>> of lon, lat) without those that lie wholly
    south of the frame."""
    return F.filter(rings, lambda r: F.exists(r, lambda p: p[1] >= south))


def ring_bounds(rings: Column) -> Column:
    """struct(w, s, e, n) over all points of rings; null without points."""
    points = F.flatten(rings)
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    box = F.struct(F.array_min(x).alias("w"), F.array_min(y).alias("s"), F.array_max(x).alias("e"), F.array_max(y).alias("n"))
    return F.when(F.size(points) > 0, box)


def ring_centre(rings: Column) -> Column:
    """struct(x, y): the mean point of the longest ring; null without points."""
    longest = F.array_max(F.transform(rings, lambda r: F.struct(F.size(r).alias("k"), r.alias("r"))))["r"]
    mean = lambda i: F.aggregate(longest, F.lit(0.0), lambda a, p: a + p[i]) / F.size(longest)
    return F.when(F.size(longest) > 0, F.struct(mean(0).alias("x"), mean(1).alias("y")))


_GEOMETRY = "array<array<array<double>>>"


def read_geojson(spark, path: str) -> DataFrame:
    """(name, code, rings) of the features of GeoJSON files, one file or many:
    polygons and multipolygons as rings of lon, lat; other geometries have none,
    unreadable files and features without properties no rows."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    f = F.explode(F.from_json("value", "features array<struct<properties:struct<name:string,adcode:string>,geometry:struct<type:string,coordinates:string>>>")["features"])
    one = raw.select(f.alias("f")).where("f.properties is not null")
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(text, _GEOMETRY)).when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<{_GEOMETRY}>")))
    return one.select(F.col("f.properties.name").alias("name"), F.col("f.properties.adcode").alias("code"), F.coalesce(rings, F.array().cast(_GEOMETRY)).alias("rings"))


def map_constants(df: DataFrame, name: str = "MAP") -> DataFrame:
    """One row: a script that sets `name` to the list of df's rows in order of its
    first column; for dimensions of a map, not for data."""
    row = F.struct(*df.columns)
    return df.agg(F.sort_array(F.collect_list(row)).alias("rows")).select(F.concat(F.lit(f"window.{name} = "), F.to_json("rows"), F.lit(";\n")).alias("value"))


def paths(df: DataFrame, ring: str = "ring") -> DataFrame:
    """df with the path of an array<array<double>> column of projected points."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([ring_path(np.array([list(p) for p in r])) if r is not None and len(r) else "" for r in s], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("path", F.pandas_udf(run, "string")(ring))


def _points(spark, sf_dir: str) -> DataFrame:
    """(id, lat, lon) of coordinates written in submissions."""
    c = table(spark, sf_dir, "contributions").select("id", F.concat_ws(" ", "content", "notes").alias("t")).distinct()
    hit = F.regexp_extract_all("t", F.lit(r"(\d{2}\.\d{4,6},\d{2,3}\.\d{4,6})"), F.lit(1))
    pair = F.split("p", ",")
    return c.select("id", F.explode(hit).alias("p")).select("id", pair[0].cast("double").alias("lat"), pair[1].cast("double").alias("lon")).distinct()


def projected_points(spark, sf_dir: str) -> DataFrame:
    x, y = project(F.col("lon"), F.col("lat"))
    return _points(spark, sf_dir).select("id", "lat", "lon", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def point_bounds(spark, sf_dir: str) -> DataFrame:
    """Bounding box and centre of all written coordinates."""
    p = _points(spark, sf_dir).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return p.select("s", "n", "w", "e", F.round("lat", 6).alias("mid_lat"), F.round("lon", 6).alias("mid_lon"))


def place_names(spark, sf_dir: str) -> DataFrame:
    """Typed city values with their short names."""
    v = table(spark, sf_dir, "contributions").select(F.trim("city").alias("typed")).where("length(typed) > 0").distinct()
    return v.select("typed", short_name(F.col("typed")).alias("short"))


QUERIES = {"projected_points": projected_points, "point_bounds": point_bounds, "place_names": place_names}
_P = """p as (select distinct id, string_split(x, ',')[1]::double as lat, string_split(x, ',')[2]::double as lon from (select id, unnest(regexp_extract_all(concat_ws(' ', content, notes), '[0-9]{2}\\.[0-9]{4,6},[0-9]{2,3}\\.[0-9]{4,6}')) as x from contributions))"""
_BEFORE = f"regexp_extract(typed, '^([^{PEOPLES}]*)[{PEOPLES}]', 1)"
_SHORT = f"case when typed like '%{PREFECTURE}' and length({_BEFORE}) > 0 then {_BEFORE} " + " ".join(f"when typed like '%{s}' and length(typed) > {len(s)} then substring(typed, 1, length(typed) - {len(s)})" for s in CITY_SUFFIXES) + " else typed end"
ORACLE = {
    "projected_points": f"with {_P} select id, lat, lon, round({PAD_X} + (lon - {WEST}) * {SHRINK!r} * {SCALE!r}, 3) as x, round({TOP!r} + ({NORTH} - lat) * {SCALE!r}, 3) as y from p",
    "point_bounds": f"with {_P} select min(lat) as s, max(lat) as n, min(lon) as w, max(lon) as e, round(avg(lat), 6) as mid_lat, round(avg(lon), 6) as mid_lon from p",
    "place_names": f"select typed, {_SHORT} as short from (select distinct trim(city, ' ') as typed from contributions where length(trim(city, ' ')) > 0)",
}
