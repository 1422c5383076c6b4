"""Text and vector inputs, and verified outputs."""

from __future__ import annotations

import datetime as dt
import json
import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.city import City
from umbra.functions.projection import central_meridian, utm_zone
from umbra.operators.polygons import RINGS, polygon_area


def places(spark: SparkSession, path: str) -> DataFrame:
    """Field points: id, name, lat, lon."""
    return spark.read.csv(path, header=True, schema="id string, name string, lat double, lon double")


def area(spark: SparkSession, path: str) -> DataFrame:
    """(id, rings) of the polygons of a FeatureCollection, Feature or bare geometry.

    Coordinates that can't be degrees are refused: the file was projected already.
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "type string, coordinates string, geometry struct<type:string,coordinates:string>, features array<struct<geometry:struct<type:string,coordinates:string>>>").alias("g"))
    one = lambda g: F.array(F.struct(g["type"].alias("type"), g["coordinates"].alias("coordinates")))
    geometry = (
        F.when(F.col("g.features").isNotNull(), F.transform("g.features", lambda f: F.struct(f["geometry"]["type"].alias("type"), f["geometry"]["coordinates"].alias("coordinates"))))
        .when(F.col("g.geometry").isNotNull(), one(F.col("g.geometry"))).otherwise(one(F.col("g"))))
    shapes = whole.select(F.posexplode(geometry).alias("k", "x")).select("k", "x.*")
    pairs = "array<array<array<double>>>"
    many = F.when(F.col("type") == "MultiPolygon", F.from_json("coordinates", f"array<{pairs}>")).when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", pairs)))
    rings = shapes.select("k", F.posexplode(many).alias("j", "polygon")).select((F.col("k") * 100000 + F.col("j")).cast("long").alias("id"), F.transform("polygon", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("rings"))
    degrees = F.forall(F.flatten("rings"), lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90))
    return rings.withColumn("rings", F.when(degrees, F.col("rings")).otherwise(F.raise_error(F.lit("coordinates are not degrees"))))


def area_of_use(polygons: DataFrame, zone: int) -> DataFrame:
    """One row (west, south, east, north, ok, zone) for polygons in degrees: whether a UTM zone, north, holds them.

    Projecting outside a zone does not fail, it gives numbers; ``zone`` is the one that the middle belongs to.
    """
    corner = polygons.select(F.explode(F.flatten("rings")).alias("p")).agg(F.min("p.x").alias("west"), F.min("p.y").alias("south"), F.max("p.x").alias("east"), F.max("p.y").alias("north"))
    middle = central_meridian(zone)
    ok = F.col("west").between(middle - 3, middle + 3) & F.col("east").between(middle - 3, middle + 3) & F.col("south").between(0, 84) & F.col("north").between(0, 84)
    return corner.select("*", F.coalesce(ok, F.lit(False)).alias("ok"), utm_zone((F.col("west") + F.col("east")) / 2).alias("zone"))


def trees(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(file, x, y) of the points of tree inventories (feature collections, one a file), within a box if one is given.

    Other geometries are passed over; a file that is no feature collection (an answer that
    reports an error) is refused.
    """
    shape = "type string, features array<struct<geometry:struct<type:string,coordinates:string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", shape).alias("g"))
    features = F.when(F.col("g.features").isNotNull(), F.col("g.features")).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(": no feature collection"))))
    points = whole.select("file", F.explode(features).alias("f")).where("f.geometry.type = 'Point'").select("file", F.from_json("f.geometry.coordinates", "array<double>").alias("c"))
    found = points.select("file", F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y")).where("x is not null and y is not null")
    return found if box is None else found.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def write_metadata(path: str, city: City, built_at: dt.datetime, **more) -> str:
    """What is needed to trust a build: the city's numbers, its digest, and what the caller adds; written whole or not at all."""
    body = {"city_id": city.id, "built_at": built_at.isoformat(), "zone": city.utm_zone, "bbox": list(city.bbox), "resolution_m": city.resolution, "sectors": city.sectors, "reach_m": city.reach, "digest": city.digest}
    text = json.dumps(body | {k: v for k, v in more.items() if v is not None}, indent=1, sort_keys=True)
    half = Path(path).with_suffix(".half")
    half.write_text(text)
    half.replace(path)
    return text


METADATA = "city_id string, built_at timestamp, zone int, bbox array<double>, resolution_m double, sectors int, reach_m double, digest string, attribution array<string>"


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a build from their metadata files; fields that are not known are left out, those not told are null."""
    return spark.read.schema(METADATA).json(path, multiLine=True)


def geojson(polygons: DataFrame, digits: int = 6) -> DataFrame:
    """One JSON Feature a row from (id, rings)."""
    rounded = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(F.bround(p["x"], digits), F.bround(p["y"], digits))))
    shape = F.struct(F.lit("Polygon").alias("type"), rounded.alias("coordinates"))
    return polygons.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("id").alias("properties"), shape.alias("geometry"))).alias("feature"))


def cadastre(pages: DataFrame, least_area: float = 5.0) -> DataFrame:
    """(id, rings) of building parts in GML answers (window, gml); a part seen in several windows counts once, the last.

    A window whose answer doesn't parse is skipped.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for w, text in zip(batch["window"], batch["gml"], strict=True):
                try:
                    root = ET.fromstring(text)
                except (ET.ParseError, TypeError):
                    continue
                for part in root.iter():
                    name = next((v for k, v in part.attrib.items() if k.endswith("}id") or k == "gml:id"), None)
                    if name is None or not part.tag.endswith(("BuildingPart", "Building", "Parcel")):
                        continue
                    for patch in (e for e in part.iter() if e.tag.endswith(("PolygonPatch", "Polygon"))):
                        rings = []
                        for pos in (e for e in patch.iter() if e.tag.endswith("posList")):
                            v = list(map(float, pos.text.split()))
                            rings.append([{"x": x, "y": y} for x, y in zip(v[::2], v[1::2], strict=True)])
                        if rings:
                            out.append((w, name, len(out), rings))
            yield pd.DataFrame(out, columns=["window", "id", "patch", "rings"])

    parts = pages.mapInPandas(parse, f"window long, id string, patch int, rings {RINGS}")
    kept = parts.withColumn("last", F.max("window").over(W.partitionBy("id"))).where("window = last")
    return kept.where(polygon_area(F.col("rings")) >= least_area).select("id", "rings")


def request_windows(spark: SparkSession, box: tuple[float, float, float, float], side: float = 500.0) -> DataFrame:
    """(x0, y0, x1, y1) squares that cover a box."""
    x0, y0, x1, y1 = box
    span = lambda a, b: F.explode(F.sequence(F.lit(int(a // side)), F.lit(max(int(a // side), int(-(-b // side)) - 1))))
    return spark.range(1).select(span(x0, x1).alias("i")).withColumn("j", span(y0, y1)).select(*[(F.col(c) * side + d).alias(n) for c, d, n in (("i", 0, "x0"), ("j", 0, "y0"), ("i", side, "x1"), ("j", side, "y1"))])


@F.udf(T.StringType())
def plain(text: str | None) -> str | None:
    """ASCII letters of a name: accents dropped, line breaks of markup and runs of blanks made one space."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKD", re.sub(r"<br\s*/?>", " ", text)).encode("ascii", "ignore").decode()
    return " ".join(text.split())


#: What viewer pages are read for, one thing at a time: a line, a colour, a point, a name, an icon.
_THING = r"(?s)(var str = \[\[.*?\]\];|color: '#[0-9a-fA-F]{6}'|new ol\.geom\.Point\(|name: '[^']*'|src: '\./marcas/\w+\.png')"


def viewer_zones(pages: DataFrame, color: str, icon: str) -> DataFrame:
    """(page, marker, name, n_lines, lines) from viewer pages (page, html).

    Things come in order: a marker is a point with the first name and the first icon after
    it; lines of the colour gather until a marker with the icon takes them.  Lines that no
    such marker follows belong to nobody.
    """
    things = pages.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(_THING), 1)).alias("k", "t"))
    upto = W.partitionBy("page").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    things = things.withColumn("point", F.count(F.when(F.col("t").startswith("new "), 1)).over(upto))
    own = W.partitionBy("page", "point").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    called = F.first(F.when(F.col("t").startswith("name: "), F.regexp_extract("t", r"name: '([^']*)'", 1)), ignorenulls=True).over(own)
    is_icon = F.col("t").startswith("src: ")
    first_icon = is_icon & (F.count(F.when(is_icon, 1)).over(own) == 1) & (F.col("point") > 0)
    things = things.withColumn("name", called).withColumn("icon", F.when(first_icon & F.col("name").isNotNull(), F.regexp_extract("t", r"src: '\./marcas/(\w+)\.png'$", 1)).otherwise(""))
    w = W.partitionBy("page").orderBy(F.col("k").desc())
    line = F.regexp_extract("t", r"^var str = (\[\[.*\]\]);$", 1)
    marked = things.withColumn("line", F.when(line != "", line)).withColumn("hue", F.lower(F.regexp_extract("t", r"^color: '#([0-9a-fA-F]{6})'", 1)))
    next_hue = F.last(F.when(F.col("hue") != "", F.col("hue")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    next_marker = F.min(F.when(F.col("icon") != "", F.col("k"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    own = marked.withColumn("next_hue", next_hue).withColumn("marker", next_marker)
    lines = own.where(F.col("line").isNotNull() & (F.col("next_hue") == color.lower())).groupBy("page", "marker").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("lines"))
    markers = own.where(F.col("icon") == icon).select("page", F.col("k").alias("marker"), "name")
    return markers.join(lines, ["page", "marker"], "left").select("page", "marker", "name", F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), "lines")


#: Fixed by the input: how the viewer words a place, and what its two timetables say.
PLACE_FORMAT = r"^(.+?) (\d+) PLAZAS EN (BATERIA|CORDON) HORARIO: (.+)$"
TIMETABLES = {
    "LUNES A VIERNES DE 09:00 A 14:00 HORAS Y 17:00 A 21:00, SABADOS DE 09:00 A 14:00 HORAS, DOMINGOS Y FESTIVOS LIBRES": [("mo-fr", "09:00", "14:00"), ("mo-fr", "17:00", "21:00"), ("sa", "09:00", "14:00")],
    "LUNES A VIERNES DE 09:00 A 14:00 HORAS, SABADOS, DOMINGOS Y FESTIVOS LIBRES": [("mo-fr", "09:00", "14:00")],
}


def parking_places(zones: DataFrame) -> DataFrame:
    """Adds status, street, capacity, orientation and schedule (days, opens, closes) from ``name``.

    status: ok, unknown_text or unknown_timetable; what isn't understood is never guessed.
    """
    worded = zones.withColumn("_text", plain("name"))
    part = lambda k: F.regexp_extract("_text", PLACE_FORMAT, k)
    hours = F.lit(None).cast("array<struct<days:string,opens:string,closes:string>>")
    for text, spans in TIMETABLES.items():
        hours = F.when(part(4) == text, F.array(*[F.struct(F.lit(d).alias("days"), F.lit(a).alias("opens"), F.lit(b).alias("closes")) for d, a, b in spans])).otherwise(hours)
    told = F.coalesce(F.col("_text").rlike(PLACE_FORMAT), F.lit(False))
    worded = worded.withColumn("schedule", F.when(told, hours))
    own = lambda c: F.when(told, c)
    return worded.select(
        *zones.columns, F.when(~told, "unknown_text").when(F.col("schedule").isNull(), "unknown_timetable").otherwise("ok").alias("status"),
        own(part(1)).alias("street"), own(part(2).try_cast("int")).alias("capacity"), own(F.lower(part(3))).alias("orientation"), "schedule")


def events(spark: SparkSession, path: str) -> DataFrame:
    """Milestones from JSON lines; a half-written last line is dropped."""
    from umbra.streaming.progress import EVENT

    return spark.read.schema(EVENT).json(path).where("city is not null and step is not null and at is not null")


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_verified(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, read back and compared both ways; raises if a row differs."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = df.sparkSession.read.parquet(path).select(*df.columns)
    if not back.exceptAll(df).isEmpty() or not df.exceptAll(back).isEmpty():
        raise OSError(f"{path} does not hold what was written")


def replace_city(df: DataFrame, path: str) -> None:
    """Idempotent layer import: the rows' cities are replaced, others stay (partitions by city_id)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city_id").parquet(path)


def manifest(instants: DataFrame, bounds: tuple[float, float, float, float], zooms: tuple[int, int], **more) -> str:
    """The index of rendered instants (at, file), in order of time; absent extras are left out."""
    rows = instants.orderBy("at").select(F.col("at").cast("string").alias("at"), "file")
    body = {"bounds": list(bounds), "min_zoom": zooms[0], "max_zoom": zooms[1], "instants": [r.asDict() for r in rows.toLocalIterator()]}
    return json.dumps(body | {k: v for k, v in more.items() if v is not None}, indent=1)


def sheet(intervals: DataFrame) -> DataFrame:
    """One Markdown row a place: (id, line) from intervals (id, name, start, end, state, shade_type)."""
    clock = lambda c: F.date_format(c, "HH:mm")
    part = F.concat(clock("start"), F.lit("-"), clock("end"), F.lit(" "), F.coalesce("shade_type", "state"))
    runs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", part.alias("part")))), lambda x: x["part"]), ", ")
    return intervals.groupBy("id", "name").agg(runs.alias("runs")).select("id", F.concat(F.lit("| "), "id", F.lit(" | "), "name", F.lit(" | "), "runs", F.lit(" |")).alias("line"))
