"""Layers of GeoPackage files as polygon rows, and small layers written as such files."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The file's application id and version, and bytes of a geometry header's envelope by its kind.
APPLICATION, VERSION, ENVELOPES = 0x47504B47, 10300, {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ROW = pa.schema([("file", pa.string()), ("fid", pa.int64()), ("epsg", pa.int32()), ("properties", pa.map_(pa.string(), pa.string())), ("polygons", pa.list_(pa.list_(pa.list_(_POINT))))])
_ROW_SQL = "file string, fid long, epsg int, properties map<string,string>, polygons array<array<array<struct<x:double,y:double>>>>"
_ROWS = 5_000


def polygons_of(blob: bytes | None) -> list | None:
    """Polygons of a GeoPackage geometry, heights dropped; None for null, empty and other kinds."""
    if blob is None or blob[:2] != b"GP" or blob[3] & 0x10:
        return None
    body = memoryview(blob)[8 + ENVELOPES[blob[3] >> 1 & 7] :]

    def shape(at: int) -> tuple[list, int]:
        order = "<" if body[at] else ">"
        (kind,) = struct.unpack_from(order + "I", body, at + 1)
        at += 5
        extra = kind // 1000 % 10
        size = 3 if extra in (1, 2) else 4 if extra == 3 else 2
        if kind % 1000 == 3:
            (n,), at, rings = struct.unpack_from(order + "I", body, at), at + 4, []
            for _ in range(n):
                (m,) = struct.unpack_from(order + "I", body, at)
                numbers = struct.unpack_from(f"{order}{m * size}d", body, at + 4)
                at += 4 + 8 * m * size
                rings.append([{"x": numbers[i], "y": numbers[i + 1]} for i in range(0, m * size, size)])
            return [rings], at
        if kind % 1000 != 6:
            raise ValueError
        (n,), at, out = struct.unpack_from(order + "I", body, at), at + 4, []
        for _ in range(n):
            part, at = shape(at)
            out += part
        return out, at

    try:
        return shape(0)[0]
    except ValueError:
        return None


def geometry_of(polygons: list, epsg: int) -> bytes:
    """A GeoPackage geometry of polygons as lists of rings of (x, y)."""
    ring = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r)
    polygon = lambda p: struct.pack("<BII", 1, 3, len(p)) + b"".join(map(ring, p))
    return struct.pack("<2sBBi", b"GP", 0, 1, epsg) + struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(polygon, polygons))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _read(layer: str | None):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                con = sqlite3.connect(":memory:")
                con.deserialize(content.as_py())
                layers = con.execute("select table_name, column_name, srs_id from gpkg_geometry_columns order by rowid").fetchall()
                chosen = [x for x in layers if layer is None or x[0] == layer][:1]
                if not chosen:
                    raise ValueError(f"{file} has no layer {layer or ''}")
                table, geometry, epsg = chosen[0]
                found = con.execute(f"select rowid, * from {_quoted(table)}")
                names = [d[0] for d in found.description][1:]
                while rows := found.fetchmany(_ROWS):
                    out = []
                    for fid, *values in rows:
                        row = dict(zip(names, values, strict=True))
                        shape = polygons_of(row.pop(geometry))
                        if shape:
                            out.append({"file": file, "fid": fid, "epsg": epsg, "polygons": shape, "properties": [(k, None if v is None else str(v)) for k, v in row.items()]})
                    yield pa.RecordBatch.from_pylist(out, _ROW)
                con.close()

    return scan


def read_layer(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """(file, fid, epsg, properties, polygons) of a layer, by default the first, of each GeoPackage below path.

    Rows of null or other geometry are left out. A file, 2 GB at most, is read by one task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gpkg").load(path)
    return files.select("path", "content").mapInArrow(_read(layer), _ROW_SQL)


def encode(rows: pa.Table, layer: str, epsg: int) -> bytes:
    """A GeoPackage of one layer; rows have polygons, and other columns that become text, integers or reals."""
    con = sqlite3.connect(":memory:")
    con.execute(f"pragma application_id = {APPLICATION}")
    con.execute(f"pragma user_version = {VERSION}")
    con.executescript("""
        create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
        create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change datetime not null default '2000-01-01T00:00:00Z', min_x double, min_y double, max_x double, max_y double, srs_id integer);
        create table gpkg_geometry_columns (table_name text not null, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));
    """)
    systems = {-1: ("Undefined cartesian", "NONE"), 0: ("Undefined geographic", "NONE"), 4326: ("WGS 84", "EPSG"), epsg: (f"EPSG:{epsg}", "EPSG")}
    con.executemany("insert into gpkg_spatial_ref_sys values (?, ?, ?, ?, 'undefined', null)", [(name, i, body, i) for i, (name, body) in systems.items()])
    con.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, ?)", (layer, layer, epsg))
    con.execute("insert into gpkg_geometry_columns values (?, 'geom', 'MULTIPOLYGON', ?, 0, 0)", (layer, epsg))
    rest = [c for c in rows.column_names if c != "polygons"]
    kinds = {}
    for c in rest:
        kind = rows.schema.field(c).type
        kinds[c] = "integer" if pa.types.is_integer(kind) or pa.types.is_boolean(kind) else "real" if pa.types.is_floating(kind) else "text"
    con.execute(f"create table {_quoted(layer)} (fid integer primary key, geom blob, {', '.join(f'{_quoted(c)} {k}' for c, k in kinds.items())})".replace(", )", ")"))
    plain = lambda v, k: None if v is None else {"integer": int, "real": float, "text": str}[k](v)
    values = ([geometry_of([[[(p["x"], p["y"]) for p in ring] for ring in polygon] for polygon in row["polygons"]], epsg), *(plain(row[c], kinds[c]) for c in rest)] for row in rows.to_pylist())
    con.executemany(f"insert into {_quoted(layer)} values (null, {', '.join('?' * (len(rest) + 1))})", values)
    con.commit()
    return con.serialize()


def encode_layers(features: DataFrame, key: str, layer: str, epsg: int) -> DataFrame:
    """(name, content) with a GeoPackage for each value of key; a file's rows are one group, so the key must keep files small.

    Null polygons are left out, and a null key gives no file. Save them by geotiff.save_files.
    """

    def one(rows: pa.Table) -> pa.Table:
        return pa.table({"name": [f"{rows.column(key)[0]}.gpkg"], "content": pa.array([encode(rows.drop_columns([key]), layer, epsg)], pa.binary())})

    return features.where(F.col("polygons").isNotNull() & F.col(key).isNotNull()).groupBy(key).applyInArrow(one, "name string, content binary")
