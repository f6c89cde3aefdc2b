"""Tiled images as files: TIFF and BigTIFF with tiles, read by byte ranges and written by many tasks.

Reading: the driver takes the header and the directories (one for each level), never the
tables of tile offsets, which grow with the image.  A scan is a range of tile numbers;
a task reads the entries of its tiles, then their bytes, neighbours in one piece.  Windows ask for the tiles
that they touch, each once, whatever the number of windows.

Writing, in two phases: encoded tiles are a table first, with their sizes added up in file order; then
the file is laid out and each task puts its tiles and their entries where they belong.  The
file gets its name when all are done, and a task that runs twice writes the same bytes
at the same places.  Levels are the means of the cells below, four tiles to one.

Files are opened through ``pyarrow.fs`` for reading (paths, ``file:``, ``s3:``, ``gs:``, ``hdfs:``); writing at
places needs a file system, so other stores are an error: a tile table stands for an image there.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from fieldweave.domains import Configured, RasterDomain, from_geo_tags
from fieldweave.operators.scan import prefix_sums
from fieldweave.sources.tiles import TiledRaster
from fieldweave.tables import discard, written

# Fixed values of the format: tags, sizes of field types, codes of compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR, KIND = 256, 257, 258, 259, 262, 277, 284, 317, 339
TILE_WIDTH, TILE_HEIGHT, OFFSETS, COUNTS, SAMPLE_FORMAT, SUBFILE = 322, 323, 324, 325, 339, 254
PIXEL_SCALE, TIE_POINT, GEO_KEYS = 33550, 33922, 34735
PROJECTED, GEOGRAPHIC = 3072, 2048
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
RAW, DEFLATE, DEFLATE_OLD = 1, 8, 32946
#: Bytes between two tiles that are read with them rather than asked for again, and of one piece.
GAP, PIECE = 1 << 16, 1 << 24
#: Bytes of decoded tiles for a task of a scan.
TASK_BYTES = 1 << 26
SCHEMA = "band int, ty long, tx long, tile array<double>"


# ---------------------------------------------------------------- directories
@dataclass(frozen=True)
class Level(Configured):
    """One directory of a file: the image at one resolution."""

    path: str
    order: str
    width: int
    height: int
    tile_width: int
    tile_height: int
    samples: int
    dtype: str
    compression: int
    predictor: int
    #: Place, field type and number of the tables of offsets and sizes.
    offsets: tuple[int, str, int]
    counts: tuple[int, str, int]
    domain: RasterDomain | None = None

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def tile_bytes(self) -> int:
        return self.tile_height * self.tile_width * self.samples * np.dtype(self.dtype).itemsize

    def raster(self) -> TiledRaster:
        """The level as a tiled raster, for windows."""
        return TiledRaster(self.domain or RasterDomain(self.height, self.width, self.samples), self.tile_height, self.tile_width)


def _opened(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def levels(path: str) -> list[Level]:
    """All directories of a file, in its order; images in strips or without a place are an error."""
    with _opened(path) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(order + "H", head[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError(f"{path} isn't a TIFF file")
        big = version == 43
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        out, size, first = [], f.size(), None
        while at:
            if at >= size:
                raise ValueError(f"{path} is cut short")
            n = struct.unpack(order + ("Q" if big else "H"), f.read_at(8 if big else 2, at))[0]
            entry, start = (20, at + 8) if big else (12, at + 2)
            data = f.read_at(n * entry + 8, start)
            tags = {}
            for i in range(n):
                e = data[i * entry : (i + 1) * entry]
                tag, kind = struct.unpack(order + "HH", e[:4])
                count = struct.unpack(order + ("Q" if big else "I"), e[4:12] if big else e[4:8])[0]
                if kind not in TYPES:
                    continue
                one = struct.calcsize("<" + TYPES[kind])
                inline = count * one <= (8 if big else 4)
                place = start + i * entry + (12 if big else 8) if inline else struct.unpack(order + ("Q" if big else "I"), e[12:] if big else e[8:])[0]
                if tag in (OFFSETS, COUNTS):  # stays in the file
                    tags[tag] = (place, order + TYPES[kind], count)
                elif count * one <= 1 << 16:
                    raw = f.read_at(count * one, place)
                    tags[tag] = raw if kind == 2 else struct.unpack(order + TYPES[kind] * count, raw)
            level = _level(path, order, tags, first)
            first = first or level
            out.append(level)
            at = struct.unpack(order + ("Q" if big else "I"), data[n * entry : n * entry + (8 if big else 4)])[0]
            if len(out) > 64:
                raise ValueError(f"the directories of {path} don't end")
        return out


def _level(path: str, order: str, tags: dict, first: Level | None) -> Level:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    samples, keys = one(SAMPLES, 1), tags.get(GEO_KEYS, ())
    numbers = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    width, height = one(WIDTH), one(HEIGHT)
    if OFFSETS not in tags:
        raise ValueError("the image is in strips, not in tiles")
    if one(PLANAR, 1) != 1 and samples > 1:
        raise ValueError("bands in planes of their own aren't supported")
    if one(COMPRESSION, RAW) not in (RAW, DEFLATE, DEFLATE_OLD) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"compression {one(COMPRESSION)} with predictor {one(PREDICTOR, 1)} isn't supported")
    domain, kind = None, None
    if first is None or PIXEL_SCALE in tags:
        domain, kind = from_geo_tags({
            "width": width, "height": height, "samples": samples, "tile_width": one(TILE_WIDTH), "tile_height": one(TILE_HEIGHT), "tiepoint": tags.get(TIE_POINT),
            "pixel_scale": tags.get(PIXEL_SCALE), "projected": numbers.get(PROJECTED), "geographic": numbers.get(GEOGRAPHIC), "bits": one(BITS), "sample_format": one(SAMPLE_FORMAT, 1),
        })
    else:  # an overview covers what the image covers
        a, b, c, d, e, f = first.domain.transform
        sx, sy = first.width / width, first.height / height
        domain, kind = RasterDomain(height, width, samples, (a * sx, b * sy, c, d * sx, e * sy, f), first.domain.crs), first.dtype
    return Level(path, order, width, height, one(TILE_WIDTH), one(TILE_HEIGHT), samples, kind, one(COMPRESSION, RAW), one(PREDICTOR, 1), tags[OFFSETS], tags[COUNTS], domain)


# ---------------------------------------------------------------- reading
def _entries(f, table: tuple[int, str, int], first: int, last: int) -> np.ndarray:
    """Numbers ``first`` to ``last`` of a table in the file."""
    at, kind, n = table
    size = np.dtype(kind).itemsize
    last = min(last, n - 1)
    return np.frombuffer(f.read_at((last - first + 1) * size, at + first * size), kind).astype(np.int64)


def _decoded(level: Level, data: bytes) -> np.ndarray:
    """A tile as (bands, height, width)."""
    raw = zlib.decompress(data) if level.compression != RAW else data
    shape = (level.tile_height, level.tile_width, level.samples)
    out = np.frombuffer(raw, np.dtype(level.dtype).newbyteorder(level.order), count=shape[0] * shape[1] * shape[2]).reshape(shape)
    if level.predictor == 2:  # differences along a row, modulo the type
        out = np.cumsum(out, axis=1, dtype=np.dtype(level.dtype))
    return np.moveaxis(out, 2, 0)


def fetched(level: Level, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Tiles by number, ascending; those that the file leaves out are missing."""
    numbers = np.unique(numbers)
    with _opened(level.path) as f:
        cut = np.flatnonzero(np.diff(numbers) > GAP // 8) + 1
        for group in np.split(numbers, cut) if len(numbers) else ():
            for part in np.split(group, range(4096, len(group), 4096)):
                first = int(part[0])
                offsets, counts = (_entries(f, t, first, int(part[-1]))[part - first] for t in (level.offsets, level.counts))
                there = counts > 0
                part, offsets, counts = part[there], offsets[there], counts[there]
                by_place = np.argsort(offsets, kind="stable")
                i = 0
                while i < len(by_place):  # neighbours in one piece
                    j, start, end = i, int(offsets[by_place[i]]), 0
                    while j < len(by_place) and (j == i or (offsets[by_place[j]] - end <= GAP and offsets[by_place[j]] + counts[by_place[j]] - start <= PIECE)):
                        end = max(end, int(offsets[by_place[j]] + counts[by_place[j]]))
                        j += 1
                    data = memoryview(f.read_at(end - start, start))
                    for k in by_place[i:j]:
                        o = int(offsets[k]) - start
                        yield int(part[k]), _decoded(level, data[o : o + int(counts[k])])
                    i = j


def _batches(level: Level, tiles: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    size, held = level.tile_height * level.tile_width, []

    def send():
        bands, numbers = np.arange(level.samples), np.array([n for n, _ in held])
        values = np.concatenate([t.astype(float).ravel() for _, t in held])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size), pa.int32()), pa.array(values))
        columns = [np.tile(bands, len(held)).astype(np.int32), np.repeat(numbers // level.across, len(bands)), np.repeat(numbers % level.across, len(bands))]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], names=["band", "ty", "tx", "tile"])

    for item in tiles:
        held.append(item)
        if len(held) * size * level.samples >= 1 << 20:
            yield send()
            held = []
    if held:
        yield send()


@dataclass
class TileRange(InputPartition):
    rows: tuple[int, int]
    columns: tuple[int, int]


class ImageReader(DataSourceReader):
    """Tiles of one level; comparisons of ``ty`` and ``tx`` with numbers choose them before any is read."""

    def __init__(self, level: Level):
        self.level, self.low, self.high = level, {"ty": 0, "tx": 0}, {"ty": level.down, "tx": level.across}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            name = x.attribute[0] if getattr(x, "attribute", None) else None
            if name not in self.low or not isinstance(x, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield x
                continue
            if isinstance(x, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low[name] = max(self.low[name], x.value + isinstance(x, GreaterThan))
            if isinstance(x, EqualTo | LessThan | LessThanOrEqual):
                self.high[name] = min(self.high[name], x.value + (not isinstance(x, LessThan)))

    def partitions(self) -> list[TileRange]:
        columns = (self.low["tx"], max(self.low["tx"], self.high["tx"]))
        each = max(1, TASK_BYTES // max(1, self.level.tile_bytes * (columns[1] - columns[0])))
        return [TileRange((y, min(y + each, self.high["ty"])), columns) for y in range(self.low["ty"], self.high["ty"], each)] or [TileRange((0, 0), (0, 0))]

    def read(self, partition: TileRange) -> Iterator[pa.RecordBatch]:
        rows, columns = np.arange(*partition.rows), np.arange(*partition.columns)
        yield from _batches(self.level, fetched(self.level, (rows[:, None] * self.level.across + columns).ravel()))


class TiledImage(DataSource):
    """``spark.read.format("tiled_image").load(path)``: rows ``band, ty, tx, tile``; option ``level`` (0: full size)."""

    @classmethod
    def name(cls) -> str:
        return "tiled_image"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ImageReader:
        return ImageReader(levels(self.options["path"])[int(self.options.get("level", 0))])


def read_tiles(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """All tiles of a level; filters on ``ty`` and ``tx`` reach the reader."""
    spark.dataSource.register(TiledImage)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tiled_image").option("level", level).load(path)


def touched_tiles(level: Level, windows: DataFrame) -> DataFrame:
    """The tiles that ``windows`` (seq, r0, c0, h, w) touch, each once, read from the file."""
    numbers = level.raster()._touched(windows).select((F.col("ty") * level.across + F.col("tx")).alias("n")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(level, fetched(level, batch.column(0).to_numpy()))

    return numbers.repartitionByRange("n").sortWithinPartitions("n").mapInArrow(run, SCHEMA)


def read_windows(level: Level, windows: DataFrame) -> DataFrame:
    """Cells ``seq, band, i, j, value`` of all windows; outside of the image, and where the file has no tile, 0."""
    return level.raster().select_many(touched_tiles(level, windows), windows)


# ---------------------------------------------------------------- writing
def _halved(level_tiles: DataFrame, raster: TiledRaster) -> DataFrame:
    """The next level's tiles ``band, ty, tx, total, n`` from sums and numbers of cells; four quarters meet in one."""
    th, tw, h, w = raster.tile_height, raster.tile_width, raster.domain.height, raster.domain.width

    def quarter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for total, n in zip(b.column("total"), b.column("n"), strict=True):
                sums.append([np.asarray(x.values).reshape(th // 2, 2, tw // 2, 2).sum((1, 3)).ravel() for x in (total, n)])
            ty, tx = b.column("ty").to_numpy(), b.column("tx").to_numpy()
            columns = [b.column("band"), pa.array(ty // 2), pa.array(tx // 2), pa.array((ty % 2 * 2 + tx % 2).astype(np.int32)), pa.array([s for s, _ in sums], pa.list_(pa.float64())), pa.array([n for _, n in sums], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["band", "ty", "tx", "part", "total", "n"])

    quarters = level_tiles.select("band", "ty", "tx", "total", "n").mapInArrow(quarter, "band int, ty long, tx long, part int, total array<double>, n array<double>")
    met = quarters.groupBy("band", "ty", "tx").agg(F.collect_list(F.struct("part", "total", "n")).alias("q"))  # four at most

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("q").to_pylist():
                both = np.zeros((2, th, tw))
                for p in parts:
                    y, x = p["part"] // 2 * (th // 2), p["part"] % 2 * (tw // 2)
                    both[:, y : y + th // 2, x : x + tw // 2] = np.array([p["total"], p["n"]]).reshape(2, th // 2, tw // 2)
                out.append(both.reshape(2, -1))
            yield pa.RecordBatch.from_arrays([b.column("band"), b.column("ty"), b.column("tx"), *(pa.array([o[k] for o in out], pa.list_(pa.float64())) for k in (0, 1))], names=["band", "ty", "tx", "total", "n"])

    return met.mapInArrow(whole, "band int, ty long, tx long, total array<double>, n array<double>")


def _counted(tiles: DataFrame, raster: TiledRaster) -> DataFrame:
    """Tiles as sums and numbers of cells; cells outside of the image don't count."""
    th, tw, h, w = raster.tile_height, raster.tile_width, raster.domain.height, raster.domain.width
    inside = lambda k: (F.col("ty") * th + F.floor(k / tw) < h) & (F.col("tx") * tw + k % tw < w)
    n = F.transform("tile", lambda x, k: F.when(inside(k), F.lit(1.0)).otherwise(F.lit(0.0)))
    return tiles.select("band", "ty", "tx", F.zip_with("tile", n, lambda v, m: v * m).alias("total"), n.alias("n"))


def pyramid(tiles: DataFrame, raster: TiledRaster, depth: int) -> DataFrame:
    """``level, band, ty, tx, tile``: the tiles of the image and of ``depth`` halvings; each cell is the mean of the image's cells below it."""
    if (raster.tile_height | raster.tile_width) % 2:
        raise ValueError("tiles with overviews need even sides")
    out = tiles.select(F.lit(0).alias("level"), "band", "ty", "tx", "tile")
    sums = _counted(tiles, raster)
    for k in range(1, depth + 1):
        sums = written(_halved(sums, raster))
        mean = F.zip_with("total", "n", lambda s, n: F.when(n > 0, s / n).otherwise(F.lit(0.0)))
        out = out.unionByName(sums.select(F.lit(k).alias("level"), "band", "ty", "tx", mean.alias("tile")))
    return out


def _local(path: str) -> str:
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"an image is written at places of a file, which {parts.scheme}: doesn't have; write a tile table")
    return parts.path


def _directory(level: Level, at: int, following: int, reduced: bool) -> bytes:
    """One directory with its arrays behind it, all but the tables of tiles; BigTIFF, little-endian."""
    kinds = {"u": 1, "i": 2, "f": 3}
    dtype, d = np.dtype(level.dtype), level.domain
    tags = [
        (SUBFILE, 4, (int(reduced),)), (WIDTH, 4, (level.width,)), (HEIGHT, 4, (level.height,)), (BITS, 3, (8 * dtype.itemsize,) * level.samples), (COMPRESSION, 3, (level.compression,)),
        (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (level.samples,)), (PLANAR, 3, (1,)), (PREDICTOR, 3, (1,)), (TILE_WIDTH, 4, (level.tile_width,)), (TILE_HEIGHT, 4, (level.tile_height,)),
        (OFFSETS, 16, level.offsets), (COUNTS, 16, level.counts), (SAMPLE_FORMAT, 3, (kinds[dtype.kind],) * level.samples),
    ]
    a, b, c, dd, e, f = d.transform
    if b or dd or a <= 0 or e >= 0:
        raise ValueError("only rasters with north up and no shear have a tie point and a scale")
    tags += [(PIXEL_SCALE, 12, (a, -e, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, c, f, 0.0))]
    if d.crs and d.crs.upper().startswith("EPSG:"):
        number = int(d.crs[5:])
        key = GEOGRAPHIC if 4000 <= number < 5000 else PROJECTED
        tags.append((GEO_KEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 2 if key == GEOGRAPHIC else 1, key, 0, 1, number)))
    tags.sort()
    entries, behind, free = [], b"", at + 8 + 20 * len(tags) + 8
    for tag, kind, values in tags:
        if tag in (OFFSETS, COUNTS):
            place, _, n = values
            raw = struct.pack("<Q", place) if n > 1 else None
            entries.append(struct.pack("<HHQ", tag, kind, n) + (raw or b"\0" * 8))
            continue
        data = struct.pack("<" + TYPES[kind] * len(values), *values)
        if len(data) <= 8:
            entries.append(struct.pack("<HHQ", tag, kind, len(values)) + data.ljust(8, b"\0"))
        else:
            entries.append(struct.pack("<HHQQ", tag, kind, len(values), free + len(behind)))
            behind += data
    return struct.pack("<Q", len(tags)) + b"".join(entries) + struct.pack("<Q", following) + behind


def _layout(raster: TiledRaster, depth: int, dtype: str, compression: int) -> tuple[list[Level], bytes, int]:
    """Levels with their places in the file, the bytes of header and directories, and where the tiles begin."""
    d, base = raster.domain, None
    out = []
    for k in range(depth + 1):
        h, w = -(-d.height // 2**k), -(-d.width // 2**k)
        a, b, c, dd, e, f = d.transform
        own = RasterDomain(h, w, d.bands or 1, (a * 2**k, b, c, dd, e * 2**k, f), d.crs)
        base = Level("", "<", w, h, raster.tile_width, raster.tile_height, d.bands or 1, dtype, compression, 1, (0, "<Q", 0), (0, "<Q", 0), own)
        n = base.down * base.across
        out.append(replace(base, offsets=(0, "<Q", n), counts=(0, "<Q", n)))
    at, places = 16, []
    for level in out:
        places.append(at)
        at += len(_directory(level, 0, 0, False))
    tables = at
    for i, level in enumerate(out):
        n = level.offsets[2]
        if n == 1:  # one entry stands in the directory itself
            tags = sorted([SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, OFFSETS, COUNTS, SAMPLE_FORMAT])
            inside = lambda tag, i=i, tags=tags: places[i] + 8 + 20 * tags.index(tag) + 12
            out[i] = replace(level, offsets=(inside(OFFSETS), "<Q", 1), counts=(inside(COUNTS), "<Q", 1))
        else:
            out[i] = replace(level, offsets=(tables, "<Q", n), counts=(tables + 8 * n, "<Q", n))
            tables += 16 * n
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16)
    for i, level in enumerate(out):
        head += _directory(level, places[i], places[i + 1] if i + 1 < len(out) else 0, i > 0)
    return out, head, tables


def write_image(tiles: DataFrame, path: str, raster: TiledRaster, depth: int = 0, dtype: str = "float64", compress: bool = True) -> str:
    """Tiles (``band``, if there are bands, ``ty, tx, tile``) as one BigTIFF file with ``depth`` overviews; returns the path.

    Tiles that have no row are left out of the file and read as 0.  The path is on a file system that all tasks
    share; what stands there is replaced in one step at the end.
    """
    target = _local(path)
    own = tiles if "band" in tiles.columns else tiles.withColumn("band", F.lit(0))
    own = own.select(F.col("band").cast("int").alias("band"), F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"), "tile")
    code = DEFLATE if compress else RAW
    plan, head, begin = _layout(raster, depth, dtype, code)
    bands, shape, across = plan[0].samples, (raster.tile_height, raster.tile_width), [level.across for level in plan]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for parts in b.column("bands").to_pylist():
                whole = np.zeros((*shape, bands), np.dtype(dtype).newbyteorder("<"))
                for p in parts:
                    whole[:, :, p["band"]] = np.asarray(p["tile"], float).reshape(shape)
                raw = whole.tobytes()
                data.append(zlib.compress(raw, 6) if compress else raw)
            level, ty, tx = (b.column(k).to_numpy() for k in ("level", "ty", "tx"))
            numbers = ty * np.array(across)[level] + tx
            yield pa.RecordBatch.from_arrays([b.column("level"), pa.array(numbers), pa.array([len(x) for x in data], pa.int64()), pa.array(data, pa.binary())], names=["level", "n", "size", "data"])

    every = pyramid(own, raster, depth) if depth else own.select(F.lit(0).alias("level"), "band", "ty", "tx", "tile")
    met = every.groupBy("level", "ty", "tx").agg(F.collect_list(F.struct("band", "tile")).alias("bands"))  # as many as there are bands
    encoded = written(met.mapInArrow(encode, "level int, n long, size long, data binary"))
    placed = prefix_sums(encoded.select("level", "n", "size"), ["level", "n"], "size")
    rows = encoded.join(placed.drop("size"), ["level", "n"]).select("level", "n", "size", (F.col("before") + begin).alias("at"), "data")
    temporary = f"{target}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with open(temporary, "wb") as f:
        f.write(head)
        f.truncate(begin)
    tables = [(level.offsets[0], level.counts[0]) for level in plan]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(temporary, "r+b") as f:
            for b in batches:
                for level, n, size, at, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for place, what in ((at, data), (tables[level][0] + 8 * n, struct.pack("<Q", at)), (tables[level][1] + 8 * n, struct.pack("<Q", size))):
                        f.seek(place)
                        f.write(what)
                    done += 1
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["done"])

    try:
        # neighbours of the file are written by one task
        done = rows.repartitionByRange("at").sortWithinPartitions("at").mapInArrow(put, "done long").agg(F.sum("done")).first()[0] or 0
        if done != encoded.count():
            raise RuntimeError(f"{done} tiles were written, not all")
        os.replace(temporary, target)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)
        discard(encoded)
    return path
