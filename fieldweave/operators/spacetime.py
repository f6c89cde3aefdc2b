"""Space and time together: a product of anchors, or pairs that are given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.domains import Configured
from fieldweave.operators.samplers import anchor_name
from fieldweave.operators.temporal import TemporalAggregation, TemporalPatcher, pack_times
from fieldweave.plans.patcher import SpatialPatcher
from fieldweave.sources.fields import Field

COUPLINGS = ("product", "coupled")


@dataclass(frozen=True)
class SpatioTemporalPatcher(Configured):
    """``source`` cells have the spatial dimensions and ``t``.  Weights are spatial unless ``time_weights``."""

    spatial: SpatialPatcher
    temporal: TemporalPatcher
    coupling: str = "product"
    #: pairs of (spatial anchor, time) for ``coupled``
    pairs: tuple = ()
    time_weights: bool = False

    def __post_init__(self):
        if self.coupling not in COUPLINGS:
            raise ValueError(f"coupling must be one of {COUPLINGS}, not {self.coupling!r}")

    def n_anchors(self, source: Field, length: int) -> int:
        return len(self.pairs) if self.coupling == "coupled" else self.spatial.n_anchors(source) * self.temporal.n_anchors(length)

    def split(self, source: Field, length: int) -> DataFrame:
        """Patch cells with ``seq`` (space), ``t_seq, scale, t_anchor, start, stop`` and ``w``."""
        dims, names = list(source.domain.dims), [anchor_name(d) for d in source.domain.dims]
        spark, lattice = source.df.sparkSession, self.temporal.sampler.lattice
        if self.coupling == "product":
            space = self.spatial.split(source)
            if lattice:  # the ranges that hold a cell's time follow from it
                out = self.temporal.covered(space.withColumnRenamed("seq", "_space"), F.lit(length).cast("long"))
                out = out.withColumnRenamed("seq", "t_seq").withColumnRenamed("_space", "seq")
            else:
                times = self.temporal.sampler.table(spark, length).withColumnRenamed("seq", "t_seq")
                ranges = self.temporal.ranges(times, F.lit(length))
                listed = ranges.withColumn("t", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))
                out = space.join(F.broadcast(listed) if times.count() <= 1_000 else listed, "t")  # few drawn times: beside the cells; else dealt by time
        else:
            schema = "pair long, " + ", ".join(f"{n} long" for n in names) + ", t_anchor long"
            pairs = spark.createDataFrame([(i, *map(int, s), int(t)) for i, (s, t) in enumerate(self.pairs)], schema)
            anchors = pairs.withColumn("seq", F.col("pair"))
            space = self.spatial.geometry.expand(anchors, source.df, source.domain)
            out = self.temporal.ranges(space.withColumn("t_seq", F.col("pair")), F.lit(length)).where("t >= start and t < stop").drop("pair")
            sizes = self.spatial.geometry.sizes(source.domain)
            out = out.withColumn("w", self.spatial.window.weight([F.col(f"o_{d}") for d in dims], list(sizes.values())))
        if self.time_weights:
            out = out.withColumn("w", F.col("w") * self.temporal.window.weight(F.col("t") - F.col("start"), F.col("stop") - F.col("start")))
        return out

    def packed(self, patch_cells: DataFrame, source: Field, value: str = "value") -> DataFrame:
        """One row for each temporal patch of each spatial anchor and offset: a series for every cell of a patch."""
        by = [*(anchor_name(d) for d in source.domain.dims), *(f"o_{d}" for d in source.domain.dims)]
        return pack_times(patch_cells.drop("seq").withColumnRenamed("t_seq", "seq"), by, value)

    def merge(self, patch_cells: DataFrame, source: Field, aggregation: TemporalAggregation, value: str = "value") -> DataFrame:
        """The temporal ``aggregation`` of every spatial anchor's patches, cell by cell of the patch.

        Spatial overlaps aren't merged.  Anchors that were drawn twice are one.
        """
        by = [*(anchor_name(d) for d in source.domain.dims), *(f"o_{d}" for d in source.domain.dims)]
        return aggregation.merge(self.packed(patch_cells, source, value), by)

    def merge_mean(self, patch_cells: DataFrame, source: Field, value: str | Column = "value") -> DataFrame:
        """For each spatial anchor the mean over its temporal patches, by offset in the patch.

        Spatial overlaps aren't merged; ``place`` tells the order in which anchors were met.
        """
        v = F.col(value) if isinstance(value, str) else value
        names, offsets = [anchor_name(d) for d in source.domain.dims], [f"o_{d}" for d in source.domain.dims]
        return patch_cells.withColumn("o_t", F.col("t") - F.col("start")).groupBy(*names, *offsets, "o_t").agg(F.min("seq").alias("place"), F.avg(v).alias("value"))
