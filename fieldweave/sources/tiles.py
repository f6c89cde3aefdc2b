"""Tiled rasters as tables: reading windows from tiles, writing chunks and tiles.

A tile table has rows ``ty, tx, tile`` (row-major array), and ``band`` first if the image has
bands.  Windows become tile coordinates, each tile is met once for all windows, and cells are
cropped; cells outside of the image read as 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.domains import Configured, RasterDomain


def tile_range(start: Column, size: Column, extent: int, tile: int) -> tuple[Column, Column]:
    """First and last tile that a window touches along an axis, cut to the image; (0, -1) if none."""
    low, high = F.greatest(start, F.lit(0)), F.least(start + size, F.lit(extent))
    none = low >= high
    return F.when(none, F.lit(0)).otherwise(F.floor(low / tile)).cast("long"), F.when(none, F.lit(-1)).otherwise(F.floor((high - 1) / tile)).cast("long")


@dataclass(frozen=True)
class TiledRaster(Configured):
    domain: RasterDomain
    tile_height: int
    tile_width: int

    @property
    def keys(self) -> list[str]:
        return [*(["band"] if self.domain.bands is not None else []), "ty", "tx"]

    def tiles(self, cells: DataFrame, value: str = "value", windows: DataFrame | None = None) -> DataFrame:
        """Cells to tiles; edge tiles are filled with 0.  With ``windows`` only the tiles that these touch.

        The cells of a tile are sorted by offset once; offsets that have no cell are added before.
        """
        th, tw = self.tile_height, self.tile_width
        bands = [F.col(k) for k in self.keys if k == "band"]
        own = cells.select(*bands, F.floor(F.col("r") / th).alias("ty"), F.floor(F.col("c") / tw).alias("tx"), (F.col("r") % th * tw + F.col("c") % tw).cast("int").alias("i"), F.coalesce(value, F.lit(0.0)).alias("v"))
        if windows is not None:
            own = own.join(self._touched(windows).select("ty", "tx").distinct(), ["ty", "tx"], "left_semi")
        held = own.groupBy(*self.keys).agg(F.collect_list(F.struct("i", "v")).alias("m"))
        all_ = F.sequence(F.lit(0), F.lit(th * tw - 1))
        gaps = F.transform(F.array_except(all_, F.transform("m", lambda x: x["i"])), lambda i: F.struct(i.alias("i"), F.lit(0.0).alias("v")))
        return held.select(*self.keys, F.transform(F.array_sort(F.concat("m", F.when(F.size("m") < th * tw, gaps).otherwise(F.array().cast("array<struct<i:int,v:double>>")))), lambda x: x["v"]).alias("tile"))

    def _touched(self, windows: DataFrame) -> DataFrame:
        """Every window with every tile that it touches."""
        span = lambda d: F.explode(F.sequence(F.col(f"t{d}0"), F.col(f"t{d}1"))).alias(f"t{d}")
        return self.ranges(windows).where("ty0 <= ty1").select("seq", "r0", "c0", "h", "w", "tx0", "tx1", span("y")).select("seq", "r0", "c0", "h", "w", "ty", span("x"))

    def ranges(self, windows: DataFrame) -> DataFrame:
        """``windows`` (seq, r0, c0, h, w) with the tiles they touch."""
        (y0, y1), (x0, x1) = tile_range(F.col("r0"), F.col("h"), self.domain.height, self.tile_height), tile_range(F.col("c0"), F.col("w"), self.domain.width, self.tile_width)
        none = (y1 < 0) | (x1 < 0)
        return windows.withColumns({"ty0": F.when(none, 0).otherwise(y0), "ty1": F.when(none, -1).otherwise(y1), "tx0": F.when(none, 0).otherwise(x0), "tx1": F.when(none, -1).otherwise(x1)})

    def select_many(self, tiles: DataFrame, windows: DataFrame) -> DataFrame:
        """Cells ``seq, i, j, value`` (and ``band``) of all windows; a tile is read once, whatever the number of windows."""
        th, tw = self.tile_height, self.tile_width
        band = [k for k in self.keys if k == "band"]
        cells = self._touched(windows).join(tiles, ["ty", "tx"]).select("*", F.posexplode("tile").alias("k", "value"))
        cells = cells.withColumns({"r": F.col("ty") * th + F.floor(F.col("k") / tw), "c": F.col("tx") * tw + F.col("k") % tw})
        inside = cells.where("r >= r0 and r < r0 + h and c >= c0 and c < c0 + w").where((F.col("r") < self.domain.height) & (F.col("c") < self.domain.width))
        found = inside.select("seq", *band, (F.col("r") - F.col("r0")).alias("i"), (F.col("c") - F.col("c0")).alias("j"), "value")
        frame = windows.select("seq", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h").cast("long") - 1)).alias("i")).select("seq", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w").cast("long") - 1)).alias("j"))
        if band:
            kind = dict(tiles.dtypes)["band"]
            frame = frame.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(self.domain.bands - 1)).cast(f"array<{kind}>")))
        return frame.join(found, ["seq", *band, "i", "j"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def write_chunks(cells: DataFrame, path: str, chunk: int, values: tuple[str, ...] = ("value",), mode: str = "overwrite", shard: int | None = None) -> None:
    """A field as single-precision Parquet, one folder for each chunk of ``chunk`` x ``chunk`` cells.

    With ``shard`` (a multiple of ``chunk``) the chunks of a square of that side are one folder, and
    one file as far as a task holds it; chunks stay in order inside.
    """
    if shard and shard % chunk:
        raise ValueError("a shard holds whole chunks")
    own = cells.withColumns({"chunk_r": F.floor(F.col("r") / chunk), "chunk_c": F.floor(F.col("c") / chunk), **{v: F.col(v).cast("float") for v in values}})
    folders = ["chunk_r", "chunk_c"]
    if shard:
        folders = ["shard_r", "shard_c"]
        own = own.withColumns({"shard_r": F.floor(F.col("r") / shard), "shard_c": F.floor(F.col("c") / shard)})
    own.repartition(*folders).sortWithinPartitions(*folders, "chunk_r", "chunk_c", "r", "c").write.mode(mode).partitionBy(*folders).parquet(path)


def write_tiles(cells: DataFrame, path: str, raster: TiledRaster, value: str = "value", mode: str = "overwrite") -> str:
    """A field as a tile table; returns the path."""
    raster.tiles(cells, value).write.mode(mode).parquet(path)
    return path
