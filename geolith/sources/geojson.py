"""GeoJSON files: feature collections, features and bare geometries.

Geometry comes as text of its own, so mixed kinds never blur the inferred schema, and is parsed by an Arrow function. Properties get the
schema that all of them share; one whose type differs from feature to feature is a VARIANT. Members `id` and `bbox` and a third coordinate are dropped; null
geometry is null.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs as U
from ..functions.shapes import to_row
from ..functions.types import GEOM

FILE = "type string, features array<struct<geometry: string, properties: string>>, geometry string, properties string, coordinates string, geometries string"


def parse(obj):
    """A geometry object as a plain geometry."""
    if isinstance(obj, str):
        obj = json.loads(obj)
    if obj is None:
        return None
    kind, c = obj.get("type"), obj.get("coordinates")
    xy = lambda p: (float(p[0]), float(p[1]))
    line = lambda r: [xy(p) for p in r]
    one = {"Point": lambda c: xy(c) if c else None, "LineString": line, "Polygon": lambda rings: [line(r) for r in rings]}
    if kind in one:
        return (kind, one[kind](c))
    if kind == "GeometryCollection":
        return (kind, [parse(g) for g in obj["geometries"]])
    if kind in ("MultiPoint", "MultiLineString", "MultiPolygon"):
        return (kind, [(kind[5:], one[kind[5:]](x)) for x in c])
    raise ValueError(f"unknown geometry type: {kind}")


from_geojson = U._make("st_geomfromgeojson", GEOM, 0, parse, lambda g, _: None if g is None else to_row(g, 4326))


def read(spark: SparkSession, path: str, key_transform=None) -> DataFrame:
    """geom and a column for each property. key_transform: name -> name, or None to leave the property out."""
    file = spark.read.schema(FILE).option("multiLine", True).json(path)
    bare = F.struct(F.concat(F.lit('{"type":"'), F.col("type"), F.lit('",'), F.when(F.col("type") == "GeometryCollection", F.concat(F.lit('"geometries":'), "geometries")).otherwise(F.concat(F.lit('"coordinates":'), "coordinates")), F.lit("}")).alias("geometry"), F.lit(None).cast("string").alias("properties"))
    alone = F.when(F.col("type") == "Feature", F.struct("geometry", "properties")).otherwise(bare)
    rows = file.select(F.explode(F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.array(alone))).alias("f")).select("f.geometry", "f.properties")
    rows = U.spread(rows)  # a document is read by one task, however many features it has
    kind = rows.where("properties is not null").agg(F.expr("schema_of_variant_agg(parse_json(properties))")).first()[0]
    ddl = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", (kind or "").replace("OBJECT<", "STRUCT<"))
    whole = rows.select(from_geojson(F.when(F.col("geometry") != "null", F.col("geometry"))).alias("geom"), F.from_json("properties", ddl).alias("p") if ddl.startswith("STRUCT<") else F.lit(None).alias("p"))
    if not ddl.startswith("STRUCT<"):
        return whole.select("geom")
    names = {n: key_transform(n) if key_transform else n for n in whole.schema["p"].dataType.names}
    return whole.select("geom", *(F.col(f"p.`{n}`").alias(new) for n, new in names.items() if new))
