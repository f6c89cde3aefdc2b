"""Fields: relations of cells with a domain.

NaN means no data and becomes NULL here, so that SQL aggregates skip it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.domains import GridDomain, PointDomain, RasterDomain, SeriesDomain, VectorDomain


@dataclass(frozen=True)
class Field:
    """``df`` has the key columns and the value columns of every cell or feature."""

    df: DataFrame
    domain: object
    keys: tuple[str, ...]
    values: tuple[str, ...] = ("value",)

    def select(self, indexer, boundless: bool = False) -> DataFrame:
        """The cells at ``indexer``.

        Raster: ``(row slice, column slice)``, filled with NULL outside of the domain if
        ``boundless``.  Grid and series: ``{dimension: slice}``.  Points and features: a
        list of ids, or a DataFrame of them.
        """
        if isinstance(self.domain, PointDomain | VectorDomain):
            ids = indexer if isinstance(indexer, DataFrame) else self.df.sparkSession.createDataFrame([(int(i),) for i in indexer], f"{self.keys[0]} long")
            return self.df.join(ids.select(self.keys[0]).distinct(), self.keys[0], "left_semi")
        if isinstance(self.domain, RasterDomain):
            indexer = dict(zip(("r", "c"), indexer, strict=True))
        ok = F.lit(True)
        for dim, s in indexer.items():
            ok = ok & (F.col(dim) >= s.start) & (F.col(dim) < s.stop)
        found = self.df.where(ok)
        if not (boundless and isinstance(self.domain, RasterDomain)):
            return found
        spark, rows, cols = self.df.sparkSession, indexer["r"], indexer["c"]
        wide = cols.stop - cols.start
        frame = spark.range((rows.stop - rows.start) * wide).select((F.floor(F.col("id") / wide) + rows.start).alias("r"), (F.col("id") % wide + cols.start).alias("c"))
        if "band" in self.keys:
            frame = frame.crossJoin(spark.range(self.domain.bands).select(F.col("id").cast("int").alias("band")))
        return frame.join(found, list(self.keys), "left")

    def with_data(self, df: DataFrame, values: Sequence[str] | None = None) -> Field:
        """The same domain with other data."""
        return replace(self, df=df, values=tuple(values or self.values))


def no_nan(df: DataFrame, values: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({v: F.nanvl(v, F.lit(None).cast(kinds[v])) for v in values if kinds[v] in ("double", "float")})


def raster(df: DataFrame, height: int, width: int, values: Sequence[str] = ("value",), bands: int | None = None, **meta) -> Field:
    """Cells ``r, c`` (and ``band``)."""
    keys = ("r", "c") if bands is None else ("band", "r", "c")
    return Field(no_nan(df.select(*keys, *values), values), RasterDomain(height, width, bands, **meta), keys, tuple(values))


def from_flat(df: DataFrame, index: str, width: int, values: Sequence[str] = ("value",), height: int | None = None, **meta) -> Field:
    """A raster from a running cell number; without ``height`` the largest number is looked up."""
    if height is None:
        height = (df.agg(F.max(index)).first()[0] or 0) // width + 1
    cells = df.select(F.floor(F.col(index) / width).cast("long").alias("r"), (F.col(index) % width).cast("long").alias("c"), *values)
    return raster(cells, height, width, values, **meta)


def grid(df: DataFrame, coords: dict[str, Sequence[float]], values: Sequence[str] = ("value",), **meta) -> Field:
    """Cells with one index column for each dimension."""
    return Field(no_nan(df.select(*coords, *values), values), GridDomain({k: tuple(v) for k, v in coords.items()}, **meta), tuple(coords), tuple(values))


def points(df: DataFrame, key: str, values: Sequence[str] = (), count: int | None = None, **meta) -> Field:
    """Points ``key, x, y``."""
    return Field(df.select(key, F.col("x").cast("double"), F.col("y").cast("double"), *values), PointDomain(df.count() if count is None else count, **meta), (key,), tuple(values))


def point_cube(df: DataFrame, key: str, values: Sequence[str] = ("value",), count: int | None = None, **meta) -> Field:
    """Points that have values at several times: rows ``key, t, x, y``; a point's place is the same at all times."""
    own = no_nan(df.select(key, "t", F.col("x").cast("double"), F.col("y").cast("double"), *values), values)
    n = df.select(key).distinct().count() if count is None else count
    return Field(own, PointDomain(n, **meta), (key, "t"), tuple(values))


def features(df: DataFrame, key: str, values: Sequence[str] = (), count: int | None = None, **meta) -> Field:
    """Polygons ``key, ring`` (array of struct x, y), with their bounds as columns."""
    side = lambda agg, axis: agg(F.transform("ring", lambda p: p[axis]))
    boxes = {"minx": side(F.array_min, "x"), "miny": side(F.array_min, "y"), "maxx": side(F.array_max, "x"), "maxy": side(F.array_max, "y")}
    return Field(df.select(key, "ring", *values).withColumns(boxes), VectorDomain(df.count() if count is None else count, **meta), (key,), tuple(values))


def series(df: DataFrame, by: Sequence[str] = (), values: Sequence[str] = ("value",), length: int | None = None) -> Field:
    """Values at integer times ``t``, one series for each value of the columns ``by``."""
    return Field(no_nan(df.select(*by, "t", *values), values), SeriesDomain(length), (*by, "t"), tuple(values))


def from_parquet(spark, path: str, kind=raster, **settings) -> Field:
    """A field from a Parquet table of cells; filters and columns reach the scan."""
    return kind(spark.read.parquet(path), **settings)
