"""GeoPackage files: a data source by rowid ranges, a sink, amending in place, and the catalogue as small DataFrames.

The file has to lie on a path that driver and executors share, as SQLite reads plain files only. Reading is parallel, one
immutable connection a task. Writing has one writer, as SQLite does: geometries are encoded by all executors, and one task of theirs puts
the rows in, in batches of 4000 and in one transaction. None of them passes through the driver.
"""

from __future__ import annotations

import re
import sqlite3
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from ..functions import codec, shapes
from ..functions import columns as C
from ..functions import udfs as U
from ..functions.types import ENVELOPE, GEOM
from ..operators import crs, merge
from ..shared import shared_root

# Fixed values of the format: the application id and version, and the definitions of its tables.
APPLICATION_ID, USER_VERSION, BATCH = 1196444487, 10200, 4000
BOX = ("_xmin", "_ymin", "_xmax", "_ymax")
METADATA = {
    "gpkg_spatial_ref_sys": "srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT",
    "gpkg_contents": "table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER, CONSTRAINT fk_gc_r_srs_id FOREIGN KEY (srs_id) REFERENCES gpkg_spatial_ref_sys(srs_id)",
    "gpkg_geometry_columns": "table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, CONSTRAINT pk_geom_cols PRIMARY KEY (table_name, column_name), CONSTRAINT uk_gc_table_name UNIQUE (table_name), CONSTRAINT fk_gc_tn FOREIGN KEY (table_name) REFERENCES gpkg_contents(table_name), CONSTRAINT fk_gc_srs FOREIGN KEY (srs_id) REFERENCES gpkg_spatial_ref_sys (srs_id)",
    "gpkg_extensions": "table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL, CONSTRAINT ge_tce UNIQUE (table_name, column_name, extension_name)",
}
SCHEMA_TABLES = {
    "gpkg_data_columns": "table_name TEXT NOT NULL, column_name TEXT NOT NULL, name TEXT, title TEXT, description TEXT, mime_type TEXT, constraint_name TEXT, CONSTRAINT pk_gdc PRIMARY KEY (table_name, column_name), CONSTRAINT gdc_tn UNIQUE (table_name, name)",
    "gpkg_data_column_constraints": "constraint_name TEXT NOT NULL, constraint_type TEXT NOT NULL, value TEXT, min NUMERIC, min_is_inclusive BOOLEAN, max NUMERIC, max_is_inclusive BOOLEAN, description TEXT, CONSTRAINT gdcc_ntv UNIQUE (constraint_name, constraint_type, value)",
}
SCHEMA_DEFINITION, RTREE_DEFINITION = "http://www.geopackage.org/spec/#extension_schema", "http://www.geopackage.org/spec/#extension_rtree"
UNDEFINED = ((-1, "Undefined cartesian SRS", "undefined cartesian coordinate reference system"), (0, "Undefined geographic SRS", "undefined geographic coordinate reference system"))


# ---- connections -------------------------------------------------------------------------------------------------------


def quote(name: str, column: str | None = None) -> str:
    """An identifier, or table.column, in double quotes."""
    own = '"' + name.replace('"', '""') + '"'
    return own if column is None else f"{own}.{quote(column)}"


def reading(path: str) -> sqlite3.Connection:
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    conn = sqlite3.connect(f"file:{Path(path).absolute()}?mode=ro&immutable=1", uri=True)
    conn.row_factory = sqlite3.Row
    return conn


def writing(path: str) -> sqlite3.Connection:
    conn = sqlite3.connect(path, isolation_level=None)
    conn.row_factory = sqlite3.Row
    for pragma in ("journal_mode = WAL", "synchronous = OFF", "read_uncommitted = ON", "mmap_size = 1073741824"):
        conn.execute(f"PRAGMA {pragma}")
    register_functions(conn)
    return conn


def register_functions(conn: sqlite3.Connection) -> None:
    """ST_MinX and so on over blobs, which the triggers of a spatial index call. Null: null, and empty."""
    def bound(k):
        def f(blob):
            if blob is None:
                return None
            found = shapes.coordinates(codec.decode_blob(blob)[0])
            return (min, max)[k % 2](c[k // 2] for c in found) if found else None

        return f

    for k, name in enumerate(("ST_MinX", "ST_MaxX", "ST_MinY", "ST_MaxY")):
        conn.create_function(name, 1, bound(k), deterministic=True)
    conn.create_function("ST_IsEmpty", 1, lambda blob: 1 if blob is None else int(shapes.is_empty(codec.decode_blob(blob)[0])), deterministic=True)


def rows(conn: sqlite3.Connection, sql: str, *args) -> list[dict]:
    return [dict(r) for r in conn.execute(sql, args)]


def has_table(conn, name: str) -> bool:
    return bool(rows(conn, "SELECT 1 FROM sqlite_master WHERE type IN ('table', 'view') AND lower(name) = lower(?)", name))


# ---- catalogue ---------------------------------------------------------------------------------------------------------


def table_names(path: str, spatial_only: bool = False, include_system: bool = False) -> list[str]:
    with reading(path) as conn:
        names = [r["name"] for r in rows(conn, "SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        if not include_system:
            names = [n for n in names if not re.match("(sqlite|gpkg|rtree).", n)]
        if spatial_only:
            spatial = {r["table_name"] for r in rows(conn, "SELECT table_name FROM gpkg_contents WHERE data_type = 'features'")} if has_table(conn, "gpkg_contents") else set()
            names = [n for n in names if n in spatial]
        return names


def table_info(conn, table: str) -> list[dict]:
    return rows(conn, f"PRAGMA table_info({quote(table)})")


def column_names(path: str, table: str) -> list[str]:
    with reading(path) as conn:
        return [r["name"] for r in table_info(conn, table)]


def geometry_columns(path: str) -> dict[str, dict]:
    """table -> column_name, geometry_type, srid; empty for a plain database."""
    with reading(path) as conn:
        if not has_table(conn, "gpkg_geometry_columns"):
            return {}
        found = rows(conn, "SELECT table_name, column_name, geometry_type_name, srs_id FROM gpkg_geometry_columns")
        return {r["table_name"]: {"column_name": r["column_name"], "geometry_type": r["geometry_type_name"], "srid": r["srs_id"]} for r in found}


def geometry_column(path: str, table: str) -> dict | None:
    return geometry_columns(path).get(table)


def primary_key(path: str, table: str) -> str | None:
    with reading(path) as conn:
        return next((r["name"] for r in table_info(conn, table) if r["pk"]), None)


def extensions(path: str) -> list[dict]:
    with reading(path) as conn:
        return rows(conn, "SELECT * FROM gpkg_extensions") if has_table(conn, "gpkg_extensions") else []


def column_metadata(path: str, table: str) -> dict[str, dict]:
    """column -> its fields of the schema extension that are not null."""
    with reading(path) as conn:
        if not has_table(conn, "gpkg_data_columns"):
            return {}
        found = rows(conn, "SELECT * FROM gpkg_data_columns WHERE table_name = ?", table)
        return {r["column_name"]: {k: v for k, v in r.items() if v is not None and k not in ("table_name", "column_name")} for r in found}


def column_constraints(path: str) -> dict[str, list[dict]]:
    with reading(path) as conn:
        out: dict[str, list[dict]] = {}
        for r in rows(conn, "SELECT * FROM gpkg_data_column_constraints") if has_table(conn, "gpkg_data_column_constraints") else ():
            r |= {k: bool(r[k]) for k in ("min_is_inclusive", "max_is_inclusive") if r[k] is not None}
            out.setdefault(r.pop("constraint_name"), []).append({k: v for k, v in r.items() if v is not None})
        return out


# ---- reading -----------------------------------------------------------------------------------------------------------


def spark_type(declared: str | None) -> T.DataType:
    name = re.sub(r"\(.*", "", (declared or "").upper()).strip()
    if name in ("BOOLEAN",):
        return T.BooleanType()
    if name in ("TINYINT", "SMALLINT", "MEDIUMINT", "INT", "INTEGER", "BIGINT"):
        return T.LongType()
    if name in ("FLOAT", "DOUBLE", "REAL"):
        return T.DoubleType()
    return T.BinaryType() if name == "BLOB" else T.StringType()


def table_schema(path: str, table: str, with_key: bool = False) -> T.StructType:
    """Columns of a table, the geometry as its blob. The integer key of a spatial table is hidden unless asked for."""
    spatial = geometry_column(path, table)
    with reading(path) as conn:
        info = table_info(conn, table)
        if not info:
            raise ValueError(f"missing table: {table}")
        stored = _stored(conn, table, [c["name"] for c in info if isinstance(spark_type(c["type"]), (T.LongType, T.DoubleType)) and not c["pk"]])
    out = T.StructType()
    for c in info:
        if spatial and c["pk"] and spark_type(c["type"]) == T.LongType() and not with_key:
            continue
        out.add(c["name"], T.BinaryType() if spatial and c["name"] == spatial["column_name"] else stored.get(c["name"]) or spark_type(c["type"]))
    return out


def _stored(conn, table: str, names: list[str]) -> dict[str, T.DataType]:
    """Number columns that hold more than they declare, and the type that holds it all: doubles for fractions, texts for texts and bytes."""
    if not names:
        return {}
    asked = ", ".join(f"max(typeof({quote(n)}) IN ('text', 'blob')), max(typeof({quote(n)}) = 'real')" for n in names)
    found = list(rows(conn, f"SELECT {asked} FROM {quote(table)}")[0].values()) if len(names) <= 400 else []
    kinds = {n: T.StringType() if text else T.DoubleType() if real else None for n, text, real in zip(names, found[::2], found[1::2], strict=False)}
    return {n: k for n, k in kinds.items() if k}


class Span(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class GpkgSource(DataSource):
    """format("gpkg"), options path, table, rowids, key, partition_rows, pushdown: rows as they are stored, geometry as its blob."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> T.StructType:
        found = table_schema(self.options["path"], self.options["table"], self.options.get("key") == "true")
        return T.StructType([T.StructField("_rowid", T.LongType()), *found.fields]) if self.options.get("rowids") == "true" else found

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else GpkgReader)(schema, self.options)


class GpkgReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.schema, self.path, self.table, self.size, self.where = schema, options["path"], options["table"], int(options.get("partition_rows", 50_000)), []

    def partitions(self):
        """Spans of so many rows each, counted, as row ids may be far apart."""
        spans = []
        with reading(self.path) as conn:
            conn.row_factory = None
            low, high = conn.execute(f"SELECT min(rowid), max(rowid) FROM {quote(self.table)}").fetchone()
            while low is not None and low <= high:
                found = conn.execute(f"SELECT rowid FROM {quote(self.table)} WHERE rowid >= ? ORDER BY rowid LIMIT 1 OFFSET ?", (low, self.size)).fetchone()
                spans.append(Span(low, found[0] if found else high + 1))
                low = found and found[0]
        return spans

    def read(self, partition: Span):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:
            return
        shape = to_arrow_schema(self.schema)
        names = ['rowid AS "_rowid"' if f.name == "_rowid" else quote(f.name) for f in self.schema.fields]
        rules = "".join(f" AND {sql}" for sql, _ in self.where)
        with reading(self.path) as conn:
            conn.row_factory = None
            found = conn.execute(f"SELECT {', '.join(names)} FROM {quote(self.table)} WHERE rowid >= ? AND rowid < ?{rules} ORDER BY rowid", [partition.low, partition.high, *(v for _, a in self.where for v in a)])
            while block := found.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array([_value(r[k], f.dataType) for r in block], shape.field(k).type) for k, f in enumerate(self.schema.fields)], schema=shape)


class PushingReader(GpkgReader):
    """Spark refuses readers with this method while `spark.sql.python.filterPushdown.enabled` is off."""

    OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def pushFilters(self, filters):
        """Comparisons of numbers and texts become SQL; whatever isn't taken Spark does itself."""
        kinds = {f.name: f.dataType for f in self.schema.fields if f.name != "_rowid" and isinstance(f.dataType, (T.LongType, T.DoubleType, T.StringType))}
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in kinds and isinstance(f, (IsNull, IsNotNull)):
                self.where.append((f"{quote(name)} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []))
            elif name in kinds and type(f) in self.OPERATORS and isinstance(f.value, (int, float, str)) and isinstance(f.value, str) == isinstance(kinds[name], T.StringType):
                self.where.append((f"{quote(name)} {self.OPERATORS[type(f)]} ?", [f.value]))
            else:
                yield f


def _value(v, kind):
    """SQLite's columns hold what they like, and the schema has room for it; a boolean other than 0 or 1 is null."""
    if v is None:
        return None
    if isinstance(kind, T.BooleanType):
        return {0: False, 1: True}.get(v)
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else v.decode(errors="replace") if isinstance(v, bytes) else str(v)
    if isinstance(kind, T.BinaryType):
        return v if isinstance(v, bytes) else str(v).encode()
    if isinstance(v, (int, float)):
        return int(v) if isinstance(kind, T.LongType) else float(v)
    return None


def read_table(spark: SparkSession, path: str, table: str, to_crs=None, key_transform=None, rowids: bool = False, with_key: bool = False) -> DataFrame:
    """A table with its geometry decoded as `geom`, and `table` and `crs` (null where there is no geometry). key_transform: name -> name,
    or None to leave the column out."""
    spark.dataSource.register(GpkgSource)
    how = {"path": path, "table": table, "rowids": str(rowids).lower(), "key": str(with_key).lower(), "pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    table_schema(path, table)  # so that what is missing is said here
    df, spatial = spark.read.format("gpkg").options(**how).load(), geometry_column(path, table)
    name = {c: key_transform(c) if key_transform and c != "_rowid" else c for c in df.columns if not spatial or c != spatial["column_name"]}
    cols = [F.col(f"`{c}`").alias(n) for c, n in name.items() if n]
    if not spatial:
        return df.select(*cols, F.lit(table).alias("table"), F.lit(None).cast("string").alias("crs"))
    srid = spatial["srid"]
    df = df.select(U.gpkg_decode(spatial["column_name"]).alias("geom"), *cols)
    if to_crs is not None and crs.srid_of(to_crs) != srid:
        target = crs.srid_of(to_crs)
        df, srid = df.withColumn("geom", crs.reproject("geom", srid, target)), target
    return df.select("*", F.lit(table).alias("table"), F.lit(f"EPSG:{srid}").alias("crs"))


def read(spark: SparkSession, path: str, table: str | None = None, spatial_only: bool = False, **how) -> DataFrame:
    """One table, or all of them one after the other (empty ones skipped), columns by name."""
    names = [table] if table else table_names(path, spatial_only)
    with reading(path) as conn:
        if not table:
            names = [n for n in names if rows(conn, f"SELECT 1 FROM {quote(n)} LIMIT 1")]
    if not names:
        return spark.createDataFrame([], "table string, crs string")
    frames = [read_table(spark, path, n, **how) for n in names]
    whole = frames[0]
    for more in frames[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    return whole


# ---- writing -----------------------------------------------------------------------------------------------------------


def bootstrap(conn) -> None:
    conn.execute(f"PRAGMA application_id = {APPLICATION_ID}")
    conn.execute(f"PRAGMA user_version = {USER_VERSION}")
    for name, ddl in METADATA.items():
        conn.execute(f"CREATE TABLE IF NOT EXISTS {name} ({ddl})")
    for srid, name, text in UNDEFINED:
        conn.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys (srs_name, srs_id, organization, organization_coordsys_id, definition, description) VALUES (?, ?, 'NONE', ?, 'undefined', ?)", (name, srid, srid, text))
    ensure_srs(conn, 4326)


def ensure_srs(conn, srid: int) -> None:
    r = crs.srs_row(srid)
    conn.execute(f"INSERT OR IGNORE INTO gpkg_spatial_ref_sys ({', '.join(r)}) VALUES ({', '.join('?' * len(r))})", list(r.values()))


def register_extension(conn, table, column, name: str, definition: str, scope: str) -> None:
    """Once only, nulls counting as equal."""
    conn.execute("INSERT INTO gpkg_extensions SELECT ?, ?, ?, ?, ? WHERE NOT EXISTS (SELECT 1 FROM gpkg_extensions WHERE table_name IS ? AND column_name IS ? AND extension_name = ?)", (table, column, name, definition, scope, table, column, name))


def specs(df: DataFrame, schema: dict | None) -> dict[str, dict]:
    """column -> type (SQL) and whatever the schema, or the fields' metadata, say of it; the geometry first."""
    out = {}
    for f in sorted(df.schema.fields, key=lambda f: f.dataType != GEOM):
        if schema is not None and f.name not in schema:
            continue
        own = dict(f.metadata or {}) | dict((schema or {}).get(f.name) or {})
        default = {T.BooleanType: "BOOLEAN", T.DoubleType: "REAL", T.FloatType: "REAL", T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.IntegerType: "INTEGER", T.LongType: "INTEGER", T.BinaryType: "BLOB"}.get(type(f.dataType), "TEXT")
        kind = "GEOMETRY" if f.dataType == GEOM else default
        out[f.name] = own | {"type": own.get("type", kind).replace("-", "").upper(), "geometry": f.dataType == GEOM}
    if sum(s["geometry"] for s in out.values()) > 1:
        raise ValueError("a table has one geometry column at most")
    return out


def create_sql(table: str, columns: dict[str, dict]) -> str:
    def one(name, s):
        text = f"{quote(name)} {s['type']}"
        text += " PRIMARY KEY" * bool(s.get("primary_key")) + " AUTOINCREMENT" * bool(s.get("autoincrement")) + " NOT NULL" * bool(s.get("not_null"))
        if ref := s.get("foreign_key"):
            text += f" REFERENCES {quote(ref['table'])}({quote(ref['column'])})" + "".join(f" ON {w.upper()} {ref['on_' + w]}" for w in ("delete", "update") if ref.get("on_" + w))
        return text

    key = ["fid INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL"] if any(s["geometry"] for s in columns.values()) and not any(s.get("primary_key") for s in columns.values()) else []
    return f"CREATE TABLE IF NOT EXISTS {quote(table)} ({', '.join([*key, *(one(n, s) for n, s in columns.items())])})"


def create_spatial_index(conn, table: str, geom: str) -> None:
    """R-tree over the rows that have coordinates, and the triggers that keep it so."""
    t, g, tree, key = quote(table), quote(geom), quote(f"rtree_{table}_{geom}"), next((r["name"] for r in table_info(conn, table) if r["pk"]), "rowid")
    if has_table(conn, f"rtree_{table}_{geom}"):
        return
    k = quote(key)
    conn.execute(f"CREATE VIRTUAL TABLE {tree} USING rtree(id, minx, maxx, miny, maxy)")
    register_extension(conn, table, geom, "gpkg_rtree_index", RTREE_DEFINITION, "write-only")
    box = lambda r: f"{r}.{k}, ST_MinX({r}.{g}), ST_MaxX({r}.{g}), ST_MinY({r}.{g}), ST_MaxY({r}.{g})"
    conn.execute(f"INSERT OR REPLACE INTO {tree} SELECT {box(t)} FROM {t} WHERE {g} NOTNULL AND NOT ST_IsEmpty({g})")
    there, gone = f"(NEW.{g} NOTNULL AND NOT ST_IsEmpty(NEW.{g}))", f"(NEW.{g} ISNULL OR ST_IsEmpty(NEW.{g}))"
    put, drop_old, drop_both = f"INSERT OR REPLACE INTO {tree} VALUES ({box('NEW')});", f"DELETE FROM {tree} WHERE id = OLD.{k};", f"DELETE FROM {tree} WHERE id IN (OLD.{k}, NEW.{k});"
    for name, event, when, do in (
        ("insert", "INSERT", there, put),
        ("update1", f"UPDATE OF {g}", f"OLD.{k} = NEW.{k} AND {there}", put),
        ("update2", f"UPDATE OF {g}", f"OLD.{k} = NEW.{k} AND {gone}", drop_old),
        ("update3", "UPDATE", f"OLD.{k} != NEW.{k} AND {there}", drop_old + put),
        ("update4", "UPDATE", f"OLD.{k} != NEW.{k} AND {gone}", drop_both),
        ("delete", "DELETE", f"OLD.{g} NOT NULL", drop_old),
    ):
        conn.execute(f"CREATE TRIGGER {quote(f'rtree_{table}_{geom}_{name}')} AFTER {event} ON {t} WHEN {when} BEGIN {do} END")


def write_schema_metadata(conn, table: str, columns: dict[str, dict], constraints: dict | None) -> None:
    fields = ("name", "title", "description", "mime_type", "constraint")
    own = {n: s for n, s in columns.items() if any(s.get(f) for f in fields)}
    if not own and not constraints:
        return
    for name, ddl in SCHEMA_TABLES.items():
        conn.execute(f"CREATE TABLE IF NOT EXISTS {name} ({ddl})")
        register_extension(conn, name, None, "gpkg_schema", SCHEMA_DEFINITION, "read-write")
    for name, c in (constraints or {}).items():
        kind = c["type"]
        if kind == "enum":
            values = c["values"].items() if isinstance(c["values"], dict) else ((v, None) for v in c["values"])
            lines = [(name, kind, str(v), None, None, None, None, d) for v, d in values]
        elif kind == "range":
            lines = [(name, kind, None, c.get("min"), int(c.get("min_inclusive", True)), c.get("max"), int(c.get("max_inclusive", True)), c.get("description"))]
        else:
            lines = [(name, kind, c["value"], None, None, None, None, c.get("description"))]
        conn.executemany("INSERT OR IGNORE INTO gpkg_data_column_constraints VALUES (?, ?, ?, ?, ?, ?, ?, ?)", lines)
    conn.executemany("INSERT OR REPLACE INTO gpkg_data_columns VALUES (?, ?, ?, ?, ?, ?, ?)", [(table, n, *(s.get(f) for f in fields)) for n, s in own.items()])


def drop_table(path: str, table: str) -> None:
    """The table, its index, triggers and metadata."""
    conn = writing(path)
    try:
        conn.execute("BEGIN")
        _drop(conn, table)
        conn.execute("COMMIT")
    finally:
        conn.close()


def _drop(conn, table: str) -> None:
    for r in rows(conn, "SELECT name FROM sqlite_master WHERE type = 'trigger' AND tbl_name = ?", table):
        conn.execute(f"DROP TRIGGER {quote(r['name'])}")
    found = rows(conn, "SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", table) if has_table(conn, "gpkg_geometry_columns") else []
    for r in found:
        conn.execute(f"DROP TABLE IF EXISTS {quote(f'rtree_{table}_{r['column_name']}')}")
    for meta in ("gpkg_extensions", "gpkg_data_columns", "gpkg_geometry_columns", "gpkg_contents"):
        if has_table(conn, meta):
            conn.execute(f"DELETE FROM {meta} WHERE table_name = ?", (table,))
    conn.execute(f"DROP TABLE IF EXISTS {quote(table)}")


def _encoded(df: DataFrame, columns: dict[str, dict], srid: int) -> DataFrame:
    """Geometries as blobs, everything else as SQLite's own kinds; then the row's place and the box of its geometry."""
    out, geom = [], next((n for n, s in columns.items() if s["geometry"]), None)
    for n in columns:
        kind, c = df.schema[n].dataType, F.col(f"`{n}`")
        plain = isinstance(kind, (T.BooleanType, T.DoubleType, T.FloatType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BinaryType, T.StringType))
        out.append(U.gpkg_encode(c, F.lit(srid)).alias(n) if n == geom else c if plain else (F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")).alias(n))
    df = df.withColumn("_place", F.monotonically_increasing_id())
    box = C.envelope(geom) if geom else F.lit(None).cast(ENVELOPE)
    return (U.spread(df) if geom else df).select(*out, "_place", box.alias("_box"))


def _load(conn, table: str, batches, names: list[str], geom: str | None, batch: int) -> list[float] | None:
    """Arrow batches of encoded rows into the table and its spatial index; the extent of the geometries."""
    key, tree = next((r["name"] for r in table_info(conn, table) if r["pk"]), None), geom and f"rtree_{table}_{geom}"
    fast = geom is not None and key is not None and key not in names and has_table(conn, tree)
    trigger = fast and rows(conn, "SELECT sql FROM sqlite_master WHERE type = 'trigger' AND name = ?", f"{tree}_insert")
    if trigger:  # boxes are known here, so the trigger need not take every blob apart again; ids are given out as SQLite would
        conn.execute(f"DROP TRIGGER {quote(f'{tree}_insert')}")
        used = [r["seq"] for r in rows(conn, "SELECT seq FROM sqlite_sequence WHERE name = ?", table)] if has_table(conn, "sqlite_sequence") else []
        fid = max([*used, conn.execute(f"SELECT coalesce(max(rowid), 0) FROM {quote(table)}").fetchone()[0]])
    into = [key, *names] if trigger else names
    sql = f"INSERT INTO {quote(table)} ({', '.join(map(quote, into))}) VALUES ({', '.join('?' * len(into))})"
    extent = None
    for whole in batches:
        for start in range(0, whole.num_rows, batch):
            part = whole.slice(start, batch)
            values = [part.column(n).to_pylist() for n in names]
            boxes = list(zip(*(part.column(n).to_pylist() for n in BOX), strict=True))
            if trigger:
                ids = range(fid + 1, fid + 1 + part.num_rows)
                fid += part.num_rows
                values = [ids, *values]
            conn.executemany(sql, zip(*values, strict=True))
            there = [b for b in boxes if b[0] is not None]
            if trigger:
                conn.executemany(f"INSERT OR REPLACE INTO {quote(tree)} VALUES (?, ?, ?, ?, ?)", ((i, b[0], b[2], b[1], b[3]) for i, b in zip(ids, boxes, strict=True) if b[0] is not None))
            if there:
                own = [min(b[0] for b in there), min(b[1] for b in there), max(b[2] for b in there), max(b[3] for b in there)]
                extent = own if extent is None else [min(extent[0], own[0]), min(extent[1], own[1]), max(extent[2], own[2]), max(extent[3], own[3])]
    if trigger:
        conn.execute(trigger[0]["sql"])
    return extent


def _write_in_task(encoded: DataFrame, path: str, table: str, names: list[str], geom: str | None, batch: int, prepare, join_old: bool) -> None:
    """prepare(conn), then the rows in order and the table's extent, in one transaction in one task. The transaction leaves a mark, so that a task that runs again
    after it was settled does nothing; the driver takes the mark away."""
    mark = f"geolith_{uuid.uuid4().hex}"

    def put(batches):
        conn = writing(path)
        try:
            conn.execute("BEGIN IMMEDIATE")
            if not has_table(conn, mark):
                prepare(conn)
                before = join_old and bool(rows(conn, f"SELECT 1 FROM {quote(table)} LIMIT 1"))
                _set_extent(conn, table, _load(conn, table, batches, names, geom, batch), before)
                conn.execute(f"CREATE TABLE {mark} (x)")
                conn.execute("COMMIT")
        finally:
            _close(conn)

    def run(batches):
        import pyarrow as pa

        put(batches)
        yield pa.RecordBatch.from_pydict({"done": pa.array([True])})

    one = encoded.select(*(f"`{n}`" for n in names), "_place", *(F.col("_box")[n.removeprefix("_")].alias(n) for n in BOX)).repartition(1).sortWithinPartitions("_place")
    one.mapInArrow(run, "done boolean").collect()
    conn = writing(path)
    try:
        there = has_table(conn, mark)
        conn.execute(f"DROP TABLE IF EXISTS {mark}")
    finally:
        _close(conn)
    if not there:  # no rows, and so no task
        put(())
        conn = writing(path)
        conn.execute(f"DROP TABLE IF EXISTS {mark}")
        _close(conn)


def write(df: DataFrame, path: str, table: str, schema: dict | None = None, batch: int = BATCH, spatial_index: bool = False, if_exists: str = "append", constraints: dict | None = None, srid: int = 27700) -> None:
    """Write a table. schema: column -> type, srid, not_null, primary_key, foreign_key, title and so on; columns it lacks are left out. if_exists: append,
    delete-rows or drop-table. All of it is one transaction."""
    if if_exists not in ("append", "delete-rows", "drop-table"):
        raise ValueError(f"no such mode: {if_exists}")
    columns = specs(df, schema)
    geom = next((n for n, s in columns.items() if s["geometry"]), None)
    srid = columns[geom].get("srid", srid) if geom else srid

    def prepare(conn):
        bootstrap(conn)
        if if_exists == "drop-table":
            _drop(conn, table)
        conn.execute(create_sql(table, columns))
        if if_exists == "delete-rows":
            conn.execute(f"DELETE FROM {quote(table)}")
            conn.execute("UPDATE gpkg_contents SET min_x = 0, min_y = 0, max_x = 0, max_y = 0 WHERE table_name = ?", (table,))
        if geom:
            ensure_srs(conn, srid)
            conn.execute("INSERT OR IGNORE INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, 0, 0, 0, 0, ?)", (table, table, srid))
            conn.execute("INSERT OR IGNORE INTO gpkg_geometry_columns VALUES (?, ?, ?, ?, 0, 0)", (table, geom, columns[geom]["type"], srid))
            if spatial_index:
                create_spatial_index(conn, table, geom)
        elif any(s.get("primary_key") and s["type"] == "INTEGER" for s in columns.values()):
            conn.execute("INSERT OR IGNORE INTO gpkg_contents (table_name, data_type, identifier) VALUES (?, 'attributes', ?)", (table, table))
        write_schema_metadata(conn, table, columns, constraints)

    _write_in_task(_encoded(df, columns, srid), path, table, list(columns), geom, batch, prepare, True)


def _set_extent(conn, table: str, extent, join_old: bool) -> None:
    if extent is None:
        return
    old = rows(conn, "SELECT min_x, min_y, max_x, max_y FROM gpkg_contents WHERE table_name = ?", table)
    if join_old and old and None not in (o := list(old[0].values())):
        extent = [min(o[0], extent[0]), min(o[1], extent[1]), max(o[2], extent[2]), max(o[3], extent[3])]
    conn.execute("UPDATE gpkg_contents SET min_x = ?, min_y = ?, max_x = ?, max_y = ? WHERE table_name = ?", (*extent, table))


def _close(conn) -> None:
    """Undo what is open, and fold the log into the file, so that immutable readers see all."""
    if conn.in_transaction:
        conn.execute("ROLLBACK")
    conn.execute("PRAGMA journal_mode = DELETE")
    conn.close()


def amend(path: str, table: str, updates: DataFrame, key: str | None = None, method: str = "update-set", if_exists: str = "set-null") -> None:
    """Merge updates into a table of the file; see operators.merge. key: a column of both; by default the table's primary key.

    Rows of one match keep their id, rows made by several matches or added get new ones. The merged rows are settled in the shared
    folder first; then the table is rewritten in one transaction, so a failure leaves it as it was.
    """
    spark, pk, spatial = updates.sparkSession, primary_key(path, table), geometry_column(path, table)
    key = key or pk
    if key is None:
        raise ValueError(f"{table} has no primary key; name one")
    target = read_table(spark, path, table, with_key=True).drop("table", "crs")
    name = spatial and spatial["column_name"]
    if spatial:
        target = target.withColumnRenamed("geom", name)
    merged = merge.amend(target, updates, key, method, if_exists, mark="_old")
    if pk in merged.columns:
        single = F.col("_old") & (F.count("*").over(merge.by_key(key)) == 1) if key == pk else F.lit(key not in (None, pk)) & F.col("_old") & (F.count("*").over(merge.by_key(pk)) == 1)
        merged = merged.withColumn(pk, F.when(single, F.col(pk)))
    merged = merged.drop("_old")
    columns = specs(merged, None)
    held = f"{shared_root(spark)}/geolith/amend-{uuid.uuid4().hex}"
    encoded = _encoded(merged, columns, spatial["srid"] if spatial else 0)
    encoded.write.parquet(held)
    encoded = spark.read.schema(encoded.schema).parquet(held)

    def prepare(conn):
        conn.execute(f"DELETE FROM {quote(table)}")
        there = {r["name"] for r in table_info(conn, table)}
        for n in [n for n in there if n not in columns and n != pk]:
            conn.execute(f"ALTER TABLE {quote(table)} DROP COLUMN {quote(n)}")
        for n in [n for n in columns if n not in there]:
            conn.execute(f"ALTER TABLE {quote(table)} ADD COLUMN {quote(n)} {columns[n]['type']}")

    _write_in_task(encoded, path, table, list(columns), name, BATCH, prepare, False)


def header(blob) -> dict:
    """Columns of a blob's header in built-in expressions: magic, version, flags, little, srid, envelope_code, empty, extended."""
    byte = lambda k: F.conv(F.hex(F.substring(blob, k, 1)), 16, 10).cast("int")
    flags = byte(4)
    little = flags.bitwiseAND(1) == 1
    raw = F.hex(F.substring(blob, 5, 4))
    turned = F.concat(*(F.substring(raw, k, 2) for k in (7, 5, 3, 1)))
    number = F.conv(F.when(little, turned).otherwise(raw), 16, 10).cast("long")
    return {"magic": F.hex(F.substring(blob, 1, 2)) == "4750", "version": byte(3), "little": little, "srid": F.when(number >= 2**31, number - 2**32).otherwise(number).cast("int"), "envelope_code": F.shiftright(flags, 1).bitwiseAND(7), "empty": flags.bitwiseAND(16) == 16, "extended": flags.bitwiseAND(32) == 32}
