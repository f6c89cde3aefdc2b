import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.domains import RasterDomain
from fieldweave.sources import images, tiles


def raster(h, w, bands=1, th=4, tw=6, crs="EPSG:32633"):
    return tiles.TiledRaster(RasterDomain(h, w, bands, (2.0, 0.0, 100.0, 0.0, -3.0, 50.0), crs), th, tw)


def table(spark, data, own):
    """Tiles of a (bands, h, w) array."""
    b, h, w = data.shape
    th, tw = own.tile_height, own.tile_width
    wide = np.zeros((b, -(-h // th) * th, -(-w // tw) * tw))
    wide[:, :h, :w] = data
    rows = [(k, y, x, wide[k, y * th : (y + 1) * th, x * tw : (x + 1) * tw].ravel().tolist()) for k in range(b) for y in range(wide.shape[1] // th) for x in range(wide.shape[2] // tw)]
    return spark.createDataFrame(rows, images.SCHEMA)


def whole(spark, level):
    found = np.full((level.samples, level.down * level.tile_height, level.across * level.tile_width), np.nan)
    for r in images.read_tiles(spark, level.path, 0).collect():
        found[r.band, r.ty * level.tile_height : (r.ty + 1) * level.tile_height, r.tx * level.tile_width : (r.tx + 1) * level.tile_width] = np.reshape(r.tile, (level.tile_height, level.tile_width))
    return found[:, : level.height, : level.width]


@pytest.mark.parametrize(("h", "w", "bands", "dtype", "compress"), [(11, 20, 1, "float64", True), (4, 6, 1, "uint8", False), (9, 13, 3, "int16", True), (16, 6, 2, "float32", True)])
def test_round_trip_with_overviews(spark, tmp_path, h, w, bands, dtype, compress):
    rng = np.random.default_rng(h)
    data = rng.integers(0, 100, (bands, h, w)).astype(float)
    own = raster(h, w, bands)
    path = images.write_image(table(spark, data, own).repartition(3), str(tmp_path / "a" / "x.tif"), own, depth=2, dtype=dtype, compress=compress)
    assert os.listdir(tmp_path / "a") == ["x.tif"]
    found = images.levels(path)
    assert [(x.height, x.width, x.samples, x.dtype) for x in found] == [(-(-h // 2**k), -(-w // 2**k), bands, dtype) for k in range(3)]
    assert found[0].domain.transform == own.domain.transform and found[0].domain.crs == "EPSG:32633"
    assert found[1].domain.transform == (4.0, 0.0, 100.0, 0.0, -6.0, 50.0)
    np.testing.assert_array_equal(whole(spark, found[0]), data)
    for k in (1, 2):
        size = 2**k
        for r in images.read_tiles(spark, path, k).collect():
            tile = np.reshape(r.tile, (4, 6))
            for i in range(4):
                for j in range(6):
                    y, x = (r.ty * 4 + i) * size, (r.tx * 6 + j) * size
                    want = data[r.band, y : y + size, x : x + size].mean() if y < h and x < w else 0.0
                    assert tile[i, j] == pytest.approx(np.array(want).astype(dtype), abs=1e-5)


def test_windows_open_only_their_tiles(spark, tmp_path, monkeypatch):
    data = np.arange(40 * 60, dtype=float).reshape(1, 40, 60)
    own = raster(40, 60)
    path = images.write_image(table(spark, data, own), str(tmp_path / "x.tif"), own)
    level = images.levels(path)[0]
    windows = spark.createDataFrame([(0, -2, 3, 6, 5), (1, 0, 4, 3, 2), (2, 37, 58, 9, 9), (3, 900, 0, 2, 2), (4, 3, 5, 2, 2)], "seq long, r0 long, c0 long, h long, w long")
    opened = {(r.ty, r.tx) for r in images.touched_tiles(level, windows).collect()}
    assert opened == {(0, 0), (0, 1), (9, 9), (1, 0), (1, 1)} and images.touched_tiles(level, windows).count() == 5
    for r in images.read_windows(level, windows).collect():
        y, x = {0: (-2, 3), 1: (0, 4), 2: (37, 58), 3: (900, 0), 4: (3, 5)}[r.seq]
        inside = 0 <= y + r.i < 40 and 0 <= x + r.j < 60
        assert r.value == (data[0, y + r.i, x + r.j] if inside else 0.0)
    assert images.read_windows(level, windows).count() == 30 + 6 + 81 + 4 + 4


def test_filters_reach_the_reader(spark, tmp_path):
    own = raster(40, 60)
    path = images.write_image(table(spark, np.ones((1, 40, 60)), own), str(tmp_path / "x.tif"), own)
    r = images.ImageReader(images.levels(path)[0])
    kept = list(r.pushFilters([images.GreaterThan(("ty",), 2), images.LessThanOrEqual(("ty",), 4), images.EqualTo(("tx",), 3), images.EqualTo(("band",), 0)]))
    assert [x.attribute for x in kept] == [("band",)]
    assert [(p.rows, p.columns) for p in r.partitions()] == [((3, 5), (3, 4))]
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 2
    got = images.read_tiles(spark, path).where("ty > 2 AND ty <= 4 AND tx = 3 AND band = 0")
    assert sorted((x.ty, x.tx) for x in got.collect()) == [(3, 3), (4, 3)]
    assert images.read_tiles(spark, path).where("ty = 99").count() == 0


def test_missing_tiles_read_as_nothing(spark, tmp_path):
    own = raster(8, 12)
    some = table(spark, np.ones((1, 8, 12)), own).where("ty = 1 AND tx = 0")
    path = images.write_image(some, str(tmp_path / "x.tif"), own, depth=1)
    assert [(r.ty, r.tx) for r in images.read_tiles(spark, path).collect()] == [(1, 0)]
    windows = spark.createDataFrame([(0, 0, 0, 8, 12)], "seq long, r0 long, c0 long, h long, w long")
    assert images.read_windows(images.levels(path)[0], windows).agg(F.sum("value")).first()[0] == 24.0
    empty = images.write_image(some.limit(0), str(tmp_path / "y.tif"), own)
    assert images.read_tiles(spark, empty).count() == 0


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    own = raster(8, 12)
    path = str(tmp_path / "x.tif")
    images.write_image(table(spark, np.ones((1, 8, 12)), own), path, own)
    before = open(path, "rb").read()
    bad = table(spark, np.ones((1, 8, 12)), own).withColumn("tile", F.expr("IF(tx = 1, slice(tile, 1, 3), tile)"))
    with pytest.raises(Exception):
        images.write_image(bad, path, own)
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["x.tif"]
    with pytest.raises(ValueError):
        images.write_image(bad, "s3://bucket/x.tif", own)


def classic(order, data, th, tw, predictor=1, compression=8, geo=True, drop=()):
    """A small TIFF file by hand: 16-bit cells, classic directory."""
    h, w = data.shape
    down, across = -(-h // th), -(-w // tw)
    wide = np.zeros((down * th, across * tw), np.uint16)
    wide[:h, :w] = data
    parts = []
    for y in range(down):
        for x in range(across):
            t = wide[y * th : (y + 1) * th, x * tw : (x + 1) * tw].copy()
            if predictor == 2:
                t[:, 1:] = t[:, 1:] - t[:, :-1]
            raw = t.astype(np.dtype("u2").newbyteorder(order)).tobytes()
            parts.append(zlib.compress(raw) if compression == 8 else raw)
    at, offsets = 8, []
    for p in parts:
        offsets.append(at)
        at += len(p)
    at += at % 2
    tags = [(256, 3, (w,)), (257, 3, (h,)), (258, 3, (16,)), (259, 3, (compression,)), (277, 3, (1,)), (317, 3, (predictor,)), (322, 3, (tw,)), (323, 3, (th,)), (324, 4, offsets), (325, 4, [len(p) for p in parts]), (339, 3, (1,))]
    if geo:
        tags += [(33550, 12, (0.5, 0.25, 0.0)), (33922, 12, (0, 0, 0, 10.0, 20.0, 0)), (34735, 3, (1, 1, 0, 1, 2048, 0, 1, 4326))]
    tags = [t for t in tags if t[0] not in drop]
    entries, behind, free = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack(order + {3: "H", 4: "I", 12: "d"}[kind] * len(values), *values)
        head = struct.pack(order + "HHI", tag, kind, len(values))
        if len(raw) <= 4:
            entries += head + raw.ljust(4, b"\0")
        else:
            entries += head + struct.pack(order + "I", free + len(behind))
            behind += raw
    body = b"".join(parts)
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    return (head + body).ljust(at, b"\0") + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + behind


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("predictor", "compression"), [(1, 8), (2, 8), (1, 1), (2, 1)])
def test_files_of_others(spark, tmp_path, order, predictor, compression):
    data = np.random.default_rng(5).integers(0, 65536, (21, 37)).astype(np.uint16)
    path = tmp_path / "x.tif"
    path.write_bytes(classic(order, data, 16, 16, predictor, compression))
    (level,) = images.levels(f"file://{path}")
    assert (level.domain.crs, level.domain.transform, level.dtype) == ("EPSG:4326", (0.5, 0.0, 10.0, 0.0, -0.25, 20.0), "uint16")
    np.testing.assert_array_equal(whole(spark, level)[0], data)


def test_what_is_refused(tmp_path):
    data, path = np.ones((5, 5), np.uint16), tmp_path / "x.tif"
    for bad in (b"GIF89a" + b"\0" * 20, classic("<", data, 16, 16, drop=(322,)), classic("<", data, 16, 16, drop=(324, 325)), classic("<", data, 16, 16, geo=False), classic("<", data, 16, 16, 3), classic("<", data, 16, 16)[:40]):
        path.write_bytes(bad)
        with pytest.raises(Exception):
            images.levels(str(path))
