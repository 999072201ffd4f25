"""TIFF files through the reader and the writer."""

import struct
import zlib

import numpy as np
import pytest

from rastrel.sources import geotiff

AT = (30.0, 0.0, 500000.0, 0.0, -30.0, 4100000.0)


def pack_lzw(data: bytes) -> bytes:
    """A plain LZW packer, to check the unpacker by."""
    table, codes, word, size = {bytes((i,)): i for i in range(256)}, [(256, 9)], b"", 9
    after = 258
    for byte in data:
        longer = word + bytes((byte,))
        if longer in table:
            word = longer
            continue
        codes.append((table[word], size))
        table[longer] = after
        after += 1
        word, size = longer[-1:], max(9, min(12, (after).bit_length()))
        if after >= 4094:
            codes.append((table[word], size))
            codes.append((256, max(9, min(12, (after + 1).bit_length()))))
            table, word, size, after = {bytes((i,)): i for i in range(256)}, b"", 9, 258
    if word:
        codes.append((table[word], size))
        size = max(9, min(12, (after + 1).bit_length()))
    codes.append((257, size))
    bits = "".join(format(c, f"0{n}b") for c, n in codes)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def test_lzw():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"abababababab" * 50, bytes(rng.integers(0, 3, 9000, np.uint8)), bytes(rng.integers(0, 256, 20000, np.uint8))):
        assert geotiff.unpack_lzw(pack_lzw(data)) == data


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "float32", "float64"])
def test_encoded_again(dtype):
    values = np.random.default_rng(2).integers(0, 100, (130, 41, 3)).astype(dtype)
    raster = geotiff.Raster(geotiff.encode(values, AT, 32632, 7))
    assert raster.transform == AT and raster.epsg == 32632 and raster.nodata == 7
    back = np.zeros_like(values)
    for r, c, _, block in raster.blocks():
        back[r : r + block.shape[0], c : c + block.shape[1]] = block
    assert (back == values).all()


def test_tiles_planes_and_predictor():
    """A big-endian file of two bands apart, in tiles of 16 with differences along rows."""
    values = np.random.default_rng(3).integers(0, 60000, (20, 30, 2)).astype(">u2")
    tiles = []
    for band in range(2):
        for r in (0, 16):
            for c in (0, 16):
                tile = np.zeros((16, 16), np.uint16)
                part = values[r : r + 16, c : c + 16, band]
                tile[: part.shape[0], : part.shape[1]] = part
                tiles.append(zlib.compress(np.diff(tile, axis=1, prepend=np.zeros((16, 1), np.uint16)).astype(">u2").tobytes()))
    places = np.cumsum([8, *map(len, tiles)])
    lists = struct.pack(">8I", *places[:-1]) + struct.pack(">8I", *map(len, tiles))
    tags = [(256, 3, 1, 30 << 16), (257, 3, 1, 20 << 16), (258, 3, 2, 16 << 16 | 16), (259, 3, 1, 8 << 16), (277, 3, 1, 2 << 16), (284, 3, 1, 2 << 16), (317, 3, 1, 2 << 16),
            (322, 3, 1, 16 << 16), (323, 3, 1, 16 << 16), (324, 4, 8, int(places[-1])), (325, 4, 8, int(places[-1]) + 32)]
    data = b"MM\0*" + struct.pack(">I", int(places[-1]) + 64) + b"".join(tiles) + lists + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0" * 4
    raster, back = geotiff.Raster(data), np.zeros(values.shape, int)
    for r, c, band, block in raster.blocks():
        back[r : r + block.shape[0], c : c + block.shape[1], band : band + 1] = block
    assert (back == values).all() and raster.transform is None and raster.epsg is None
    with pytest.raises(ValueError):
        geotiff.Raster(b"PK\3\4aaaaaaaa")


def test_spark_round_trip(spark, tmp_path):
    pixels = spark.createDataFrame([(r, c, None if (r, c) == (1, 1) else float(r * 100 + c)) for r in range(30) for c in range(21)], "r int, c int, v double")
    tiles = geotiff.encode_tiles(pixels, ["v"], AT, tile=16, epsg=32632)
    assert geotiff.save_files(tiles, str(tmp_path / "t")) == 4
    names = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert names == ["tile_r000000_c000000.tif", "tile_r000000_c000016.tif", "tile_r000016_c000000.tif", "tile_r000016_c000016.tif"]
    meta = {r.file.rsplit("/", 1)[1]: r for r in geotiff.read_meta(spark, str(tmp_path / "t")).collect()}
    last = meta[names[-1]]
    assert (last.width, last.height, last.c, last.f, last.epsg) == (5, 14, 500480.0, 4099520.0, 32632)
    got = geotiff.read_pixels(spark, str(tmp_path / "t")).collect()
    found = {(r.r + int(meta[(n := r.file.rsplit("/", 1)[1])].f - AT[5]) // -30, r.c + int(meta[n].c - AT[2]) // 30): r.v for r in got}
    assert found == {(r.r, r.c): r.v for r in pixels.collect()}
    assert geotiff.one_band(spark, str(tmp_path / "t"), "r000016_c000016.tif").endswith(names[-1]) and geotiff.one_band(spark, str(tmp_path / "t"), "_B4.TIF") is None
    with pytest.raises(ValueError):
        geotiff.one_band(spark, str(tmp_path / "t"), ".tif")
