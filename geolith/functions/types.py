"""The geometry column: a nested struct that built-in expressions can read.

A geometry is its kind, its SRID and its simple parts; each part has rings of coordinates (ring 0 is the shell, the line or the point)
and a path, which says where in nested collections it stands. Null geometry is SQL NULL; an empty one has no coordinates and
keeps its kind.
"""

from __future__ import annotations

from pyspark.sql import types as T

COORD = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(COORD)
STEP = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("kind", T.StringType())])
PART = T.StructType([T.StructField("path", T.ArrayType(STEP)), T.StructField("kind", T.StringType()), T.StructField("rings", T.ArrayType(RING))])
GEOM = T.StructType([T.StructField("kind", T.StringType()), T.StructField("srid", T.IntegerType()), T.StructField("parts", T.ArrayType(PART))])
ENVELOPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])

SIMPLE = ("Point", "LineString", "LinearRing", "Polygon")
MULTI = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon", "GeometryCollection": None}
KINDS = (*SIMPLE, *MULTI)
