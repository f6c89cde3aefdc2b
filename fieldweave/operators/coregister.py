"""Bringing one field to another's cells: resampling between affine grids, and whole patches.

Resampling is an equi-join.  A target cell's centre falls into one square of four source cell
centres; the squares are made from the source once (each cell stands in the four that touch it),
so every target row is joined once, with its own key, and no row is copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.domains import RasterDomain
from fieldweave.operators.samplers import anchor_name
from fieldweave.plans.policy import picklable
from fieldweave.sources.fields import Field

METHODS = ("nearest", "bilinear")


def source_place(target: RasterDomain, source: RasterDomain, shift: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    """(row, column) in ``source``, with fractions, of the centre of the target's cell (r, c); the source is moved by ``shift`` (x, y) first."""
    a, b, c, d, e, f = target.transform
    col, row = F.col("c") + F.lit(0.5), F.col("r") + F.lit(0.5)
    x, y = a * col + b * row + c - shift[0], d * col + e * row + f - shift[1]
    a, b, c, d, e, f = source.transform
    det = a * e - b * d
    if not det:
        raise ValueError("the source's transform has no inverse")
    return (a * (y - f) - d * (x - c)) / det, (e * (x - c) - b * (y - f)) / det


def _squares(source: Field, values: tuple[str, ...]) -> DataFrame:
    """``(band), _r, _c`` and the values of the four cells whose centres are the corners of each square; missing cells are null."""
    band = [k for k in source.keys if k == "band"]
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    own = source.df.select(*band, "r", "c", *values, F.explode(corners).alias("_k"))
    own = own.select(*band, (F.col("r") - F.col("_k.i")).cast("long").alias("_r"), (F.col("c") - F.col("_k.j")).cast("long").alias("_c"), (F.col("_k.i") * 2 + F.col("_k.j")).alias("_n"), *values)
    return own.groupBy(*band, "_r", "_c").agg(*[F.max(F.when(F.col("_n") == n, F.col(v).cast("double"))).alias(f"_{v}_{n}") for v in values for n in range(4)])


def resample(source: Field, target: Field, method: str = "bilinear", values: tuple[str, ...] | None = None, shift: tuple[float, float] = (0.0, 0.0)) -> Field:
    """``source`` on the cells of ``target``; both are rasters with affine transforms in one reference system.

    ``nearest``: the cell that holds the target cell's centre.  ``bilinear``: the four cells around it, those
    with data weighted anew; NULL where none has.  Targets of no source cell are NULL.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    if not (isinstance(source.domain, RasterDomain) and isinstance(target.domain, RasterDomain)):
        raise ValueError("both fields must be rasters")
    if source.domain.crs and target.domain.crs and source.domain.crs != target.domain.crs:
        raise ValueError(f"{source.domain.crs} isn't {target.domain.crs}: reference systems aren't changed")
    values = tuple(values or source.values)
    row, col = source_place(target.domain, source.domain, shift)
    keys = [k for k in target.keys if k in source.keys or k in ("r", "c")]
    cells = target.df.select(*target.keys, row.alias("_y"), col.alias("_x"))
    band = [k for k in keys if k == "band"]
    if method == "nearest":
        cells = cells.withColumns({"_r": F.floor("_y").cast("long"), "_c": F.floor("_x").cast("long")})
        own = source.df.select(*band, F.col("r").cast("long").alias("_r"), F.col("c").cast("long").alias("_c"), *values)
        out = cells.join(own, [*band, "_r", "_c"], "left").select(*target.keys, *values)
        return replace(target, df=out, values=values)
    cells = cells.withColumns({"_r": F.floor(F.col("_y") - 0.5).cast("long"), "_c": F.floor(F.col("_x") - 0.5).cast("long")})
    met = cells.join(_squares(source, values), [*band, "_r", "_c"], "left")
    v, u = F.col("_y") - 0.5 - F.col("_r"), F.col("_x") - 0.5 - F.col("_c")
    weights = [(1 - v) * (1 - u), (1 - v) * u, v * (1 - u), v * u]

    def mixed(name: str) -> Column:
        parts = [(F.col(f"_{name}_{n}"), w) for n, w in enumerate(weights)]
        top, below = F.lit(0.0), F.lit(0.0)
        for x, w in parts:
            top, below = top + F.when(x.isNotNull(), x * w).otherwise(0.0), below + F.when(x.isNotNull(), w).otherwise(0.0)
        return F.when(below > 0, top / below).alias(name)

    return replace(target, df=met.select(*target.keys, *[mixed(v_) for v_ in values]), values=values)


#: Patches of which a task holds results before it sends them.
PATCHES = 256


def _mapped(fns: list[Callable]) -> Callable:
    """Batches of ``shape, data`` with the secondaries after their functions: a batch is worked on and sent in parts of ``PATCHES`` patches."""
    kind, most = pa.list_(pa.list_(pa.float64())), PATCHES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, most) for k in range(0, whole.num_rows, most)):
                made = []
                for shape, data in zip(b.column("shape").to_pylist(), b.column("data"), strict=True):
                    first, *rest = (np.array(x.values.to_numpy(zero_copy_only=False), float).reshape(shape) for x in data)
                    made.append([np.asarray(fn(x, first), float).reshape(shape).ravel() for fn, x in zip(fns, rest, strict=True)])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, kind)], schema=pa.schema([*list(b.schema)[:-1], pa.field("data", kind)]))

    return run


def on_patches(patch_cells: DataFrame, domain, coreg: dict[str, Callable], primary: str = "primary") -> DataFrame:
    """Secondaries of whole patches by opaque functions ``fn(secondary array, primary array) -> array of the primary's shape``.

    ``patch_cells`` has a column for each source; every patch is one row with the arrays of all its sources,
    so a function sees both sides of one place (to shift, match or filter them).  Gaps are NaN, in and out.
    """
    for fn in coreg.values():
        picklable(fn)
    dims, names = list(domain.dims), [primary, *coreg]
    offsets = [f"o_{d}" for d in dims]
    anchors = [anchor_name(d) for d in dims]
    others = [c for c in patch_cells.columns if c not in {"seq", *anchors, *offsets, *dims, *coreg}]
    at = F.struct(*offsets, *dims, *others, *coreg)
    rows = patch_cells.groupBy("seq", *anchors).agg(F.array_sort(F.collect_list(at)).alias("_p"), F.array(*[(F.max(o) + 1).cast("int") for o in offsets]).alias("shape"))
    gaps = lambda n: F.transform("_p", lambda x: F.coalesce(x[n].cast("double"), F.lit(float("nan"))))
    arrays = F.array(*[gaps(n) for n in names])
    cells = F.transform("_p", lambda x: F.struct(*[x[c].alias(c) for c in (*offsets, *dims, *others)]))
    packed = rows.select("seq", *anchors, "shape", cells.alias("cells"), arrays.alias("data"))

    done = packed.mapInArrow(_mapped(list(coreg.values())), packed.schema)
    out = done.select("seq", *anchors, "data", F.posexplode("cells").alias("_i", "_x"))
    value = lambda k, n: F.nanvl(F.get(F.get("data", F.lit(k)), F.col("_i")), F.lit(None).cast("double")).alias(n)
    return out.select("seq", *anchors, "_x.*", *[value(k, n) for k, n in enumerate(coreg)]).select(*patch_cells.columns)
