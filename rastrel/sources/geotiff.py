"""TIFF rasters as pixel rows and back: classic files in strips or tiles, uncompressed, deflated or LZW."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Numbers of TIFF tags, sizes of their types, and GeoTIFF keys.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, MATRIX, KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "2I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_CODES = {1: "u", 2: "i", 3: "f"}
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072


def unpack_lzw(data: bytes) -> bytes:
    """Bytes of a TIFF LZW stream: codes of 9 to 12 bits, highest bit first, 256 to start over and 257 to end."""
    table: list[bytes] = []
    out, before, bits, held, size = bytearray(), b"", 0, 0, 9
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < size:
            continue
        bits -= size
        code = held >> bits & (1 << size) - 1
        if code == 257:
            break
        if code == 256:
            table, before, size = [bytes((i,)) for i in range(256)] + [b"", b""], b"", 9
            continue
        word = table[code] if code < len(table) else before + before[:1]
        out += word
        if before:
            table.append(before + word[:1])
            size = max(9, min(12, (len(table) + 1).bit_length()))
        before = word
    return bytes(out)


class Raster:
    """The header of a TIFF file, and its blocks."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if not self.order or self._read("H", 2)[0] != 42:
            raise ValueError("not a classic TIFF file")
        at = self._read("I", 4)[0]
        self.tags = dict(self._tag(at + 2 + 12 * i) for i in range(self._read("H", at)[0]))
        self.width, self.height = self.tags[WIDTH][0], self.tags[HEIGHT][0]
        self.samples = self.tags.get(SAMPLES, (1,))[0]
        kind, bits = self.tags.get(FORMAT, (1,))[0], self.tags.get(BITS, (1,))[0]
        if kind not in _CODES or bits % 8 or len(set(self.tags.get(BITS, (1,)))) > 1:
            raise ValueError("samples of whole bytes and one size are read")
        self.dtype = np.dtype(f"{self.order}{_CODES[kind]}{bits // 8}")
        text = self.tags.get(NODATA)
        self.nodata = float(text.strip(b"\0 ").decode()) if text else None

    def _read(self, form: str, at: int) -> tuple:
        return struct.unpack_from(self.order + form, self.data, at)

    def _tag(self, at: int):
        tag, kind, n = self._read("HHI", at)
        form = _TYPES.get(kind, "B")
        size = n * struct.calcsize(self.order + form)
        place = at + 8 if size <= 4 else self._read("I", at + 8)[0]
        if kind == 2:
            return tag, self.data[place : place + n]
        return tag, self._read(f"{n * 2}I" if kind == 5 else f"{n}{form}", place)

    @property
    def transform(self) -> tuple[float, ...] | None:
        """(a, b, c, d, e, f): x = a col + b row + c and y = d col + e row + f of a pixel's outer corner."""
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            return m[0], m[1], m[3], m[4], m[5], m[7]
        if SCALE in self.tags and TIEPOINT in self.tags:
            (sx, sy), (col, row, _, x, y) = self.tags[SCALE][:2], self.tags[TIEPOINT][:5]
            return sx, 0.0, x - col * sx, 0.0, -sy, y + row * sy
        return None

    @property
    def epsg(self) -> int | None:
        """The code of the projected, else of the geographic reference system."""
        keys = self.tags.get(KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return found.get(PROJECTED_KEY, found.get(GEOGRAPHIC_KEY))

    def blocks(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(row, column, first band, values of rows x columns x bands) of every strip or tile, cut to the frame."""
        tiled = TILES in self.tags
        wide = self.tags[TILE_WIDTH][0] if tiled else self.width
        high = self.tags[TILE_HEIGHT][0] if tiled else min(self.height, self.tags.get(ROWS_PER_STRIP, (self.height,))[0])
        places, sizes = (self.tags[TILES], self.tags[TILE_BYTES]) if tiled else (self.tags[STRIPS], self.tags[STRIP_BYTES])
        apart = self.tags.get(PLANAR, (1,))[0] == 2 and self.samples > 1
        bands, across = 1 if apart else self.samples, -(-self.width // wide)
        each = across * -(-self.height // high)
        for i, (place, size) in enumerate(zip(places, sizes, strict=True)):
            band, (down, right) = i // each, divmod(i % each, across)
            rows = high if tiled else min(high, self.height - down * high)
            values = self._block(self.data[place : place + size], rows, wide, bands)
            yield down * high, right * wide, band, values[: self.height - down * high, : self.width - right * wide]

    def _block(self, packed: bytes, rows: int, columns: int, bands: int) -> np.ndarray:
        how, predictor = self.tags.get(COMPRESSION, (1,))[0], self.tags.get(PREDICTOR, (1,))[0]
        if how not in (1, 5, 8, 32946) or predictor not in (1, 2):
            raise ValueError(f"compression {how} with predictor {predictor} is not read")
        raw = packed if how == 1 else unpack_lzw(packed) if how == 5 else zlib.decompress(packed)
        values = np.frombuffer(raw, self.dtype, rows * columns * bands).reshape(rows, columns, bands)
        return np.cumsum(values, axis=1, dtype=self.dtype) if predictor == 2 else values


def encode(values: np.ndarray, transform: tuple[float, ...], epsg: int | None = None, nodata: float | None = None, rows_per_strip: int = 64) -> bytes:
    """A deflated little-endian TIFF of rows x columns x bands, without rotation."""
    a, _, c, _, e, f = transform
    height, width, bands = values.shape
    values = values.astype(values.dtype.newbyteorder("<"))
    strips = [zlib.compress(values[i : i + rows_per_strip].tobytes()) for i in range(0, height, rows_per_strip)]
    kind = {v: k for k, v in _CODES.items()}[values.dtype.kind]
    tags = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [values.dtype.itemsize * 8] * bands), (COMPRESSION, "H", [8]), (PHOTOMETRIC, "H", [2 if bands == 3 else 1]),
        (STRIPS, "I", np.cumsum([8, *map(len, strips)])[:-1].tolist()), (SAMPLES, "H", [bands]), (ROWS_PER_STRIP, "I", [rows_per_strip]), (STRIP_BYTES, "I", [len(s) for s in strips]),
        (PLANAR, "H", [1]), (FORMAT, "H", [kind] * bands), (SCALE, "d", [a, -e, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, c, f, 0.0]),
    ]
    if epsg is not None:
        tags.append((KEYS, "H", [1, 1, 0, 1, GEOGRAPHIC_KEY if epsg in range(4000, 5000) else PROJECTED_KEY, 0, 1, epsg]))
    if nodata is not None:
        tags.append((NODATA, "s", repr(float(nodata)).encode() + b"\0"))
    start = 8 + sum(map(len, strips))
    start += start % 2
    spare, entries, extra = start + 2 + 12 * len(tags) + 4, b"", b""
    for tag, form, content in tags:
        body = content if form == "s" else struct.pack(f"<{len(content)}{form}", *content)
        code = next(k for k, v in _TYPES.items() if v == form)
        if len(body) <= 4:
            entries += struct.pack("<HHI", tag, code, len(content)) + body.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, code, len(content), spare + len(extra))
            extra += body + b"\0" * (len(body) % 2)
    head = b"II*\0" + struct.pack("<I", start) + b"".join(strips)
    return head.ljust(start, b"\0") + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra


def _pixels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raster = Raster(content.as_py())
            for row, column, band, values in raster.blocks():
                rows, columns, bands = values.shape
                r, c, b = np.meshgrid(np.arange(row, row + rows), np.arange(column, column + columns), np.arange(band, band + bands), indexing="ij")
                v = values.astype(float).ravel()
                missing = np.isnan(v) | (v == raster.nodata if raster.nodata is not None else False)
                arrays = [pa.array([file] * len(v)), *(pa.array(x.ravel(), pa.int32()) for x in (r, c, b)), pa.array(v, mask=missing)]
                yield from pa.Table.from_arrays(arrays, ["file", "r", "c", "band", "v"]).to_batches(max_chunksize=65_536)


def _meta(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = Raster(content.as_py())
            row = {"file": file, "width": x.width, "height": x.height, "bands": x.samples, "epsg": x.epsg, "nodata": x.nodata} | dict(zip("abcdef", x.transform or [None] * 6, strict=True))
            yield pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), *((n, pa.int32()) for n in ("width", "height", "bands", "epsg")), ("nodata", pa.float64()), *((n, pa.float64()) for n in "abcdef")]))


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_pixels(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff,TIF,TIFF}") -> DataFrame:
    """(file, r, c, band, v) of every pixel of the rasters below path, bands from 0; nodata and NaN are null.

    A file, 2 GB at most, is read by one task, block by block; a compression or sample type that is not read raises.
    """
    return _files(spark, path, pattern).mapInArrow(_pixels, "file string, r int, c int, band int, v double")


def read_meta(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff,TIF,TIFF}") -> DataFrame:
    """(file, width, height, bands, epsg, nodata, a, b, c, d, e, f) of the rasters below path; a to f is the transform, null without one."""
    return _files(spark, path, pattern).mapInArrow(_meta, "file string, width int, height int, bands int, epsg int, nodata double, a double, b double, c double, d double, e double, f double")


def one_band(spark: SparkSession, path: str, suffix: str) -> str | None:
    """The one file below path whose name ends with a suffix; None for none, ValueError for more."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path).select("path").limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"more than one file ends with {suffix}")
    return found[0].path if found else None


def encode_tiles(pixels: DataFrame, values: list[str], transform: tuple[float, ...], tile: int = 512, epsg: int | None = None, dtype: str = "float32") -> DataFrame:
    """(name, row, col, content) of TIFF tiles of pixels(r, c, values), named by number and corner; null is NaN, or 0 in integers.

    A tile is one group of tile * tile pixels; tiles at the lower and right edge end with the last pixel.
    """
    a, b, c0, d, e, f0 = transform
    kind = np.dtype(dtype)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        top, left = int(rows["_tr"].iloc[0]) * tile, int(rows["_tc"].iloc[0]) * tile
        r, c = rows["r"].to_numpy() - top, rows["c"].to_numpy() - left
        out = np.full((r.max() + 1, c.max() + 1, len(values)), np.nan if kind.kind == "f" else 0, kind)
        out[r, c] = rows[values].astype(float).fillna(np.nan if kind.kind == "f" else 0).to_numpy()
        corner = (a, b, c0 + a * left + b * top, d, e, f0 + d * left + e * top)
        content = encode(out, corner, epsg, np.nan if kind.kind == "f" else None)
        return pd.DataFrame({"name": [f"tile_r{top:06d}_c{left:06d}.tif"], "row": [top], "col": [left], "content": [content]})

    rows = pixels.select("r", "c", *values).withColumns({"_tr": F.floor(F.col("r") / tile), "_tc": F.floor(F.col("c") / tile)})
    return rows.groupBy("_tr", "_tc").applyInPandas(one, "name string, row int, col int, content binary")


def save_files(files: DataFrame, folder: str, overwrite: bool = False) -> int:
    """Writes content under name into a folder that all executors share, and returns the number of files.

    A file is written beside its place and moved there, so a task that runs again does no harm. Without `overwrite`
    files that exist are kept.
    """

    def save(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                place = Path(folder) / name
                if overwrite or not place.exists():
                    place.parent.mkdir(parents=True, exist_ok=True)
                    part = place.with_name(f"{place.name}.{uuid.uuid4().hex}")
                    part.write_bytes(content)
                    part.replace(place)
            yield pd.DataFrame({"n": [len(frame)]})

    return files.select("name", "content").mapInPandas(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
