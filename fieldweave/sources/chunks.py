"""Chunk stores: dense arrays as folders of compressed chunks with their metadata, in the layout of Zarr 3.

An array is a ``zarr.json`` and one file for each chunk, or for each shard: a file of several
chunks with an index of offsets behind them, so a window reads the chunks it needs by
byte ranges.  One task owns a file: its cells meet in one group of bounded size, and the file
gets its name when it is whole.  So a killed write leaves whole files only, and is resumed by those
that are missing; partial re-writes replace each touched file in one step.  The metadata comes last, which commits a new array.

Files are opened through ``pyarrow.fs`` (paths, ``file:``, ``s3:``, ``gs:``, ``hdfs:``).
"""

from __future__ import annotations

import gzip
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.domains import Configured, GridDomain, RasterDomain
from fieldweave.sources.fields import Field

DTYPES = ("float32", "float64", "int16", "int32", "int64", "uint8", "uint16")
#: In an index of a shard: there is no such chunk.
NOTHING = (1 << 64) - 1


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class ChunkStore(Configured):
    """One array: ``dims`` names its axes, ``shape`` their lengths, ``chunk`` and ``shard`` (a multiple of it, or None) the sides."""

    path: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    shard: tuple[int, ...] | None = None
    dtype: str = "float32"
    #: Zero for whole numbers, NaN for others where None: what cells without a value have.
    fill: float | None = None
    attributes: tuple[tuple[str, object], ...] = ()

    def __post_init__(self):
        if self.dtype not in DTYPES:
            raise ValueError(f"dtype must be one of {DTYPES}")
        if not len(self.dims) == len(self.shape) == len(self.chunk) or (self.shard and len(self.shard) != len(self.dims)):
            raise ValueError("dims, shape, chunk and shard must be of one length")
        if min(self.chunk) < 1 or (self.shard and any(s % c for s, c in zip(self.shard, self.chunk, strict=True))):
            raise ValueError("a shard holds whole chunks")

    @property
    def file_shape(self) -> tuple[int, ...]:
        return self.shard or self.chunk

    @property
    def grid(self) -> tuple[int, ...]:
        """Number of files along each axis."""
        return tuple(-(-n // s) for n, s in zip(self.shape, self.file_shape, strict=True))

    @property
    def nothing(self) -> float:
        return self.fill if self.fill is not None else (np.nan if self.dtype.startswith("float") else 0)

    # ------------------------------------------------------------ metadata
    def metadata(self) -> dict:
        chunks = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 5}}]
        if self.shard:
            chunks = [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(self.chunk), "codecs": chunks, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}], "index_location": "end"}}]
        fill = self.nothing
        return {
            "zarr_format": 3, "node_type": "array", "shape": list(self.shape), "data_type": self.dtype, "dimension_names": list(self.dims),
            "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(self.file_shape)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
            "fill_value": "NaN" if isinstance(fill, float) and math.isnan(fill) else fill, "codecs": chunks, "attributes": dict(self.attributes),
        }

    def commit(self) -> None:
        """Write the metadata: from now on the array is there."""
        _put(self.path + "/zarr.json", json.dumps(self.metadata(), indent=1).encode())

    # ------------------------------------------------------------ files
    def file_of(self, number: int) -> str:
        return self.path + "/c/" + "/".join(str(int(i)) for i in np.unravel_index(number, self.grid))

    def number(self) -> Column:
        """Number of the file that holds a cell."""
        out = F.lit(0).cast("long")
        for d, s, n in zip(self.dims, self.file_shape, self.grid, strict=True):
            out = out * n + F.floor(F.col(d) / s)
        return out

    def place(self) -> Column:
        """Number of a cell in its file."""
        out = F.lit(0).cast("long")
        for d, s in zip(self.dims, self.file_shape, strict=True):
            out = out * s + F.col(d) % s
        return out

    def _encode(self, data: np.ndarray) -> bytes:
        one = lambda x: gzip.compress(np.ascontiguousarray(x, np.dtype(self.dtype).newbyteorder("<")).tobytes(), 5, mtime=0)
        if not self.shard:
            return one(data)
        parts, index, at = [], [], 0
        for k in np.ndindex(*(s // c for s, c in zip(self.shard, self.chunk, strict=True))):
            own = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(k, self.chunk, strict=True))]
            if (np.isnan(own) if isinstance(self.nothing, float) and math.isnan(self.nothing) else own == self.nothing).all():
                index.append((NOTHING, NOTHING))
                continue
            parts.append(one(own))
            index.append((at, len(parts[-1])))
            at += len(parts[-1])
        return b"".join(parts) + np.array(index, "<u8").tobytes()

    def chunks_of(self, number: int, low: tuple[int, ...] | None = None, high: tuple[int, ...] | None = None) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        """First cell and data of each chunk of a file that meets the box ``low`` to ``high``; chunks without values are left out."""
        store, inner = _store(self.file_of(number))
        if store.get_file_info(inner).type != fs.FileType.File:
            return
        first = tuple(int(i) * s for i, s in zip(np.unravel_index(number, self.grid), self.file_shape, strict=True))
        read = lambda data: np.frombuffer(gzip.decompress(data), np.dtype(self.dtype).newbyteorder("<")).reshape(self.chunk)
        with store.open_input_file(inner) as f:
            if not self.shard:
                yield first, read(f.read())
                return
            per = tuple(s // c for s, c in zip(self.shard, self.chunk, strict=True))
            size = 16 * math.prod(per)
            index = np.frombuffer(f.read_at(size, f.size() - size), "<u8").reshape(-1, 2)
            for n, k in enumerate(np.ndindex(*per)):
                start = tuple(a + i * c for a, i, c in zip(first, k, self.chunk, strict=True))
                met = low is None or all(s < h and s + c > lo for s, c, lo, h in zip(start, self.chunk, low, high, strict=True))
                if met and int(index[n, 0]) != NOTHING:
                    yield start, read(f.read_at(int(index[n, 1]), int(index[n, 0])))

    # ------------------------------------------------------------ writing
    def missing(self, spark: SparkSession) -> DataFrame:
        """``file``: numbers of the files that aren't there yet, for writes that go on."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                numbers = b.column(0).to_pylist()
                there = []
                for n in numbers:
                    store, inner = _store(self.file_of(n))
                    there.append(store.get_file_info(inner).type == fs.FileType.File)
                yield pa.RecordBatch.from_arrays([pa.array([n for n, ok in zip(numbers, there, strict=True) if not ok], pa.int64())], names=["file"])

        return spark.range(math.prod(self.grid)).mapInArrow(run, "file long")

    def write(self, cells: DataFrame, value: str = "value", resume: bool = False, update: bool = False) -> DataFrame:
        """Write cells (``dims`` and ``value``; null: no value); returns ``file, cells, bytes`` of the files written.

        ``resume`` leaves files that are there and drops their cells before anything is shuffled to them;
        ``update`` puts the cells into what files hold.  Cells outside of the shape are left out; of cells at one place one counts.
        """
        own = cells
        for d, n in zip(self.dims, self.shape, strict=True):
            own = own.where((F.col(d) >= 0) & (F.col(d) < n))
        own = own.select(self.number().alias("file"), self.place().cast("int").alias("i"), F.col(value).cast("double").alias("v"))
        if resume:
            own = own.join(self.missing(cells.sparkSession), "file", "left_semi")
        met = own.groupBy("file").agg(F.collect_list(F.struct("i", "v")).alias("x"))  # no more than a file's cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for number, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    data = np.full(self.file_shape, self.nothing, self.dtype)
                    if update:
                        first = tuple(int(i) * s for i, s in zip(np.unravel_index(number, self.grid), self.file_shape, strict=True))
                        for start, part in self.chunks_of(number):
                            data[tuple(slice(s - a, s - a + c) for s, a, c in zip(start, first, self.chunk, strict=True))] = part
                    i, v = (x.values.field(k) for k in (0, 1))
                    v = v.fill_null(self.nothing).to_numpy(zero_copy_only=False)
                    data.reshape(-1)[i.to_numpy(zero_copy_only=False)] = v
                    raw = self._encode(data)
                    _put(self.file_of(number), raw)
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(i)], pa.int64()), pa.array([len(raw)], pa.int64())], names=["file", "cells", "bytes"])

        return met.mapInArrow(run, "file long, cells long, bytes long")

    # ------------------------------------------------------------ reading
    def cells(self, spark: SparkSession, window: dict[str, slice] | None = None) -> DataFrame:
        """``dims, value`` of all cells that have a value, or of those in ``window``; only files and chunks that it meets are opened."""
        low = tuple(max(0, (window or {}).get(d, slice(0, n)).start or 0) for d, n in zip(self.dims, self.shape, strict=True))
        high = tuple(min(n, s.stop if (s := (window or {}).get(d)) and s.stop is not None else n) for d, n in zip(self.dims, self.shape, strict=True))
        if any(a >= b for a, b in zip(low, high, strict=True)):
            ranges = [range(0)] * len(self.dims)
        else:
            ranges = [range(a // s, (b - 1) // s + 1) for a, b, s in zip(low, high, self.file_shape, strict=True)]
        sizes = tuple(map(len, ranges))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    at = tuple(r[int(i)] for r, i in zip(ranges, np.unravel_index(k, sizes), strict=True))
                    for start, data in self.chunks_of(int(np.ravel_multi_index(at, self.grid)), low, high):
                        cut = tuple(slice(max(lo - s, 0), max(min(h - s, c), 0)) for s, c, lo, h in zip(start, self.chunk, low, high, strict=True))
                        own = data[cut]
                        known = ~np.isnan(own) if own.dtype.kind == "f" else np.ones(own.shape, bool)
                        index = [pa.array(i + s + c.start) for i, s, c in zip(np.nonzero(known), start, cut, strict=True)]
                        if len(index[0]):
                            yield pa.RecordBatch.from_arrays([*index, pa.array(own[known].astype(float))], names=[*self.dims, "value"])

        asked = spark.range(math.prod(sizes))
        return asked.repartition(max(1, min(math.prod(sizes), 4 * spark.sparkContext.defaultParallelism)), "id").mapInArrow(run, ", ".join(f"{d} long" for d in self.dims) + ", value double")

    def field(self, spark: SparkSession, window: dict[str, slice] | None = None) -> Field:
        """The array as a field: a raster where its axes are (band,) r, c, else a grid of running labels."""
        own = dict(self.attributes)
        if self.dims in (("r", "c"), ("band", "r", "c")):
            bands = self.shape[0] if len(self.shape) == 3 else None
            domain = RasterDomain(self.shape[-2], self.shape[-1], bands, tuple(own.get("transform", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))), own.get("crs"))
        else:
            domain = GridDomain({d: tuple(own.get(d, range(n))) for d, n in zip(self.dims, self.shape, strict=True)})
        return Field(self.cells(spark, window), domain, self.dims, ("value",))


def _put(path: str, data: bytes) -> None:
    """A file that is there as a whole or not at all."""
    store, inner = _store(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    temporary = f"{inner}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as f:
        f.write(data)
    store.move(temporary, inner)


def opened(path: str) -> ChunkStore:
    """The array at ``path``, from its metadata; codecs other than plain bytes with gzip are an error."""
    store, inner = _store(path + "/zarr.json")
    if store.get_file_info(inner).type != fs.FileType.File:
        raise FileNotFoundError(f"no array at {path}")
    with store.open_input_stream(inner) as f:
        meta = json.loads(f.read())
    if meta.get("zarr_format") != 3 or meta.get("node_type") != "array":
        raise ValueError(f"{path} isn't an array of Zarr 3")
    outer, codecs, shard = tuple(meta["chunk_grid"]["configuration"]["chunk_shape"]), meta["codecs"], None
    chunk = outer
    if codecs[0]["name"] == "sharding_indexed":
        conf = codecs[0]["configuration"]
        if [c["name"] for c in conf["index_codecs"]] != ["bytes"] or conf.get("index_location", "end") != "end":
            raise ValueError("indexes of shards must be plain and at the end")
        shard, chunk, codecs = outer, tuple(conf["chunk_shape"]), conf["codecs"]
    if [c["name"] for c in codecs] != ["bytes", "gzip"] or codecs[0].get("configuration", {}).get("endian", "little") != "little":
        raise ValueError(f"codecs {[c['name'] for c in codecs]} aren't supported")
    if meta["chunk_key_encoding"]["name"] != "default" or meta["chunk_key_encoding"].get("configuration", {}).get("separator", "/") != "/":
        raise ValueError("keys of chunks must be c/0/0")
    fill = meta["fill_value"]
    dims = tuple(meta.get("dimension_names") or (f"d{i}" for i in range(len(meta["shape"]))))
    return ChunkStore(path, dims, tuple(meta["shape"]), chunk, shard, meta["data_type"], None if fill == "NaN" else fill, tuple(meta.get("attributes", {}).items()))


def write_field(source: Field, path: str, chunk: tuple[int, ...], shard: tuple[int, ...] | None = None, value: str | None = None, dtype: str = "float32", resume: bool = False) -> ChunkStore:
    """A raster or grid as an array; with ``resume`` what an earlier, killed write left is kept.  The last step commits it."""
    domain = source.domain
    sizes = {**({"band": domain.bands} if "band" in source.keys else {}), **domain.dims}
    own: dict = {}
    if isinstance(domain, RasterDomain):
        own = {"transform": list(domain.transform)} | ({"crs": domain.crs} if domain.crs else {})
    store = ChunkStore(path, tuple(source.keys), tuple(sizes[k] for k in source.keys), chunk, shard, dtype, attributes=tuple(own.items()))
    store.write(source.df, value or source.values[0], resume).agg(F.sum("cells")).collect()
    store.commit()
    return store
