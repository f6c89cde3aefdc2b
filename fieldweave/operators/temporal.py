"""Patches along an integer time axis.

A patch is the half-open range of times around an anchor.  With a lattice of anchors each
time lists the anchors whose range holds it (arithmetic, no join); other anchors are
joined by time after their range is listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.domains import Configured
from fieldweave.functions.windows import CausalBoxcar, TemporalWindow
from fieldweave.operators.samplers import TemporalSampler
from fieldweave.operators.scan import Monoid, running, whole
from fieldweave.sources.fields import Field


class TemporalGeometry(Configured):
    def reaches(self) -> list[tuple[int, int]]:
        """(times before, times after) an anchor, for each scale."""
        raise NotImplementedError


@dataclass(frozen=True)
class FixedLookback(TemporalGeometry):
    length: int

    def reaches(self):
        return [(self.length - 1, 0)]


@dataclass(frozen=True)
class LookbackHorizon(TemporalGeometry):
    lookback: int
    horizon: int

    def reaches(self):
        return [(self.lookback - 1, self.horizon)]


@dataclass(frozen=True)
class MultiScale(TemporalGeometry):
    scales: tuple[int, ...]

    def reaches(self):
        return [(n - 1, 0) for n in self.scales]


@dataclass(frozen=True)
class PhaseWindow(TemporalGeometry):
    """Times around the anchor; the period is a note for the reader."""

    period: int
    phase_width: int

    def reaches(self):
        return [(self.phase_width, self.phase_width)]


@dataclass(frozen=True)
class TemporalPatcher(Configured):
    geometry: TemporalGeometry
    sampler: TemporalSampler
    window: TemporalWindow = field(default_factory=CausalBoxcar)

    def n_anchors(self, length: int) -> int:
        """Patches, each scale counted."""
        return len(self.sampler.times(length)) * len(self.geometry.reaches())

    def lengths(self, source: Field) -> DataFrame | None:
        """Length of each series, or nothing if it is known."""
        by = [k for k in source.keys if k != "t"]
        return None if source.domain.length is not None else source.df.groupBy(*by).agg((F.max("t") + 1).alias("_length"))

    def ranges(self, anchors: DataFrame, length: Column) -> DataFrame:
        """``scale, start, stop`` of each anchor's patches."""
        each = F.array(*[F.struct(F.lit(i).alias("scale"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(self.geometry.reaches())])
        out = anchors.withColumn("_g", F.explode(each))
        out = out.withColumns({"scale": F.col("_g.scale"), "start": F.greatest(F.lit(0).cast("long"), F.col("t_anchor") - F.col("_g.a")), "stop": F.least(length.cast("long"), F.col("t_anchor") + F.col("_g.b") + 1)})
        return out.drop("_g")

    def split(self, source: Field, anchors: DataFrame | None = None) -> DataFrame:
        """Patch times: series columns, ``seq, scale, t_anchor, start, stop, t``, values and ``w``.

        ``anchors`` (seq, t_anchor, and series columns if they differ by series) replaces
        the sampler.
        """
        by = [k for k in source.keys if k != "t"]
        lengths, fixed = self.lengths(source), source.domain.length
        rows = source.df
        if lengths is not None:
            rows = rows.join(lengths, by) if by else rows.crossJoin(lengths)  # one row if there is one series
        else:
            rows = rows.withColumn("_length", F.lit(fixed).cast("long"))
        if anchors is None and self.sampler.lattice is not None:
            rows = self.covered(rows, F.col("_length"))
        else:
            if anchors is None:
                length = fixed if fixed is not None else lengths.agg(F.max("_length")).first()[0] or 0
                anchors = self.sampler.table(source.df.sparkSession, length)
            keyed = [b for b in by if b in anchors.columns]
            if lengths is not None:
                placed = anchors.join(lengths, keyed) if keyed else anchors.crossJoin(lengths)  # anchors are metadata
            else:
                placed = anchors.withColumn("_length", F.lit(fixed).cast("long"))
            placed = self.ranges(placed.where((F.col("t_anchor") >= 0) & (F.col("t_anchor") < F.col("_length"))), F.col("_length"))
            listed = placed.drop("_length").withColumn("t", F.explode(F.when(F.col("start") < F.col("stop"), F.sequence(F.col("start"), F.col("stop") - 1))))
            rows = listed.join(rows, [*(b for b in by if b in listed.columns), "t"])
        weight = self.window.weight(F.col("t") - F.col("start"), F.col("stop") - F.col("start"))
        return rows.drop("_length").withColumn("w", weight.cast("double"))

    def covered(self, rows: DataFrame, length: Column) -> DataFrame:
        """Rows with a time ``t`` once for each patch of the lattice that holds them: arithmetic on the row, no join."""
        first, step = self.sampler.lattice
        each = F.array(*[F.struct(F.lit(i).alias("scale"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(self.geometry.reaches())])
        rows = rows.withColumn("_g", F.explode(each))
        low = F.greatest(F.lit(0), F.floor((F.col("t") - F.col("_g.b") - first + step - 1) / step)).cast("long")
        high = F.least(F.floor((F.col("t") + F.col("_g.a") - first) / step), F.floor((length - 1 - first) / step)).cast("long")
        rows = rows.withColumn("seq", F.explode(F.when(low <= high, F.sequence(low, high)))).withColumn("t_anchor", F.col("seq") * step + first)
        return rows.withColumns({"scale": F.col("_g.scale"), "start": F.greatest(F.lit(0).cast("long"), F.col("t_anchor") - F.col("_g.a")), "stop": F.least(length, F.col("t_anchor") + F.col("_g.b") + 1)}).drop("_g")

    def packed(self, source: Field, anchors: DataFrame | None = None, value: str = "value") -> DataFrame:
        """One row for each patch with ``data`` and ``weights`` in order of time."""
        return pack_times(self.split(source, anchors), [k for k in source.keys if k != "t"], value)

    def patches_at(self, source: Field, t: int) -> DataFrame:
        """The patches of one anchor."""
        spark = source.df.sparkSession
        return self.packed(source, spark.createDataFrame([(0, int(t))], "seq long, t_anchor long"))


def pack_times(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Patch times to one row for each patch; ``by`` names the series."""
    own = cells.groupBy(*by, "seq", "scale", "t_anchor", "start", "stop").agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("v"), "w"))).alias("_p"))
    return own.select(*by, "seq", "scale", "t_anchor", "start", "stop", F.transform("_p", lambda x: x["v"]).alias("data"), F.transform("_p", lambda x: x["w"]).alias("weights"))


# ---------------------------------------------------------------- aggregations
def fold(packed: DataFrame, by: list[str], initial: Column, step: Callable[[Column, Column], Column], combine: Callable[[Column, Column], Column] | None = None, chunk: int = 1_000) -> DataFrame:
    """Left fold over the patches of each series in the order of ``seq``: ``state``.

    Without ``combine`` a series is one row, so it has to fit a task.  ``combine(a, b)`` gives the
    state after two stretches from their own states, each begun with ``initial``; then
    every ``chunk`` patches are folded apart, and their states in stretches of stretches.
    """
    at = ["_chunk"] if combine else []
    own = packed.withColumn("_chunk", F.floor(F.col("seq") / chunk)) if combine else packed
    ordered = own.groupBy(*by, *at).agg(F.array_sort(F.collect_list(F.struct("seq", "scale", "data"))).alias("_p"))
    states = ordered.select(*by, *at, F.aggregate("_p", initial, lambda a, p: step(a, p["data"])).alias("state"))
    if not combine:
        return states
    # the states of stretches meet in a tree, so no row holds a series
    own = states.select(*by, F.col("_chunk").cast("long").alias("seq"), F.col("state").alias("data"))
    return whole(own, by, Monoid(lambda data: data, combine, lambda _, x: x), initial)


def fold_opaque(packed: DataFrame, by: list[str], fn: Callable, initial, schema: str) -> DataFrame:
    """The same with a Python function of (state, data).

    Series are sorted by Spark and met row by row, so a task holds one Arrow batch and one
    state, however long a series is.  A series is folded by one task, as its order asks.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = tuple(getattr(row, b) for b in by)
                if own != key:
                    if key is not None:
                        out.append((*key, state))
                    key, state = own, initial
                state = fn(state, row.data)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=[*by, "state"])
                out = []
        if key is not None:
            out.append((*key, state))
        if out:
            yield pd.DataFrame(out, columns=[*by, "state"])

    return packed.select(*by, "seq", "scale", "data").repartition(*by).sortWithinPartitions(*by, "seq", "scale").mapInPandas(run, schema)


def mean(packed: DataFrame, by: list[str]) -> DataFrame:
    """Element by element over patches of one length (``pos, value``); others are an error.  Weights are ignored."""
    sized = packed.groupBy(*by).agg(F.count_distinct(F.size("data")).alias("_sizes"))
    ok = sized.where(F.when(F.col("_sizes") > 1, F.raise_error(F.lit("patches differ in length")).cast("boolean")).otherwise(F.lit(True))).drop("_sizes")
    cells = packed.select(*by, F.posexplode("data").alias("pos", "v"))
    out = cells.groupBy(*by, "pos").agg(F.avg("v").alias("value"))
    return out.join(ok, by) if by else out.crossJoin(ok)  # ok is one row without series


def hierarchical(packed: DataFrame, by: list[str], scales: tuple[int, ...] | None = None) -> DataFrame:
    """The last patch of each anchor and key; the key is a patch's length if that is one of the scales, else its range.

    A patch cut short by the start of its series may thus have another scale's length as its
    key; of patches with one key the last counts.
    """
    length, span = F.col("stop") - F.col("start"), F.concat(F.lit("["), F.col("start"), F.lit(","), F.col("stop"), F.lit(")"))
    names = F.when(length.isin([int(n) for n in scales]), length.cast("string")).otherwise(span) if scales else span
    return packed.withColumn("key", names).groupBy(*by, "t_anchor", "key").agg(F.max_by("data", F.struct("seq", "scale")).alias("data"))


def forecast(packed: DataFrame, by: list[str], horizon: int) -> DataFrame:
    """The last ``horizon`` values of each anchor's last patch.

    A patch of n values that is shorter than the horizon gives those from 2 n - horizon on, as
    a negative start counts from its end.
    """
    n = F.size("data")
    start = F.when(n >= horizon, n - horizon).otherwise(F.greatest(F.lit(0), 2 * n - horizon))
    last = packed.groupBy(*by, "t_anchor").agg(F.max_by("data", F.struct("seq", "scale")).alias("data"))
    return last.withColumn("data", F.slice("data", start + 1, F.greatest(n - start, F.lit(0))))


class TemporalAggregation(Configured):
    """How the patches of each series become one result, by any plan that has packed patches."""

    def merge(self, packed: DataFrame, by: list[str]) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class Fold(TemporalAggregation):
    """``state``: see :func:`fold`."""

    step: Callable[[Column, Column], Column]
    initial: float = 0.0
    combine: Callable[[Column, Column], Column] | None = None

    def merge(self, packed, by):
        return fold(packed, by, F.lit(self.initial), self.step, self.combine)


@dataclass(frozen=True)
class FoldBy(TemporalAggregation):
    """``state``: a fold whose step is an associative operation (see :mod:`fieldweave.operators.scan`); no row or task holds a series."""

    monoid: Monoid
    initial: float = 0.0

    def merge(self, packed, by):
        return whole(packed, by, self.monoid, F.lit(self.initial), tie="scale")

    def states(self, packed, by):
        """The state after every patch: ``by, seq, scale, state``."""
        return running(packed, by, self.monoid, F.lit(self.initial), tie="scale")


@dataclass(frozen=True)
class MeanOver(TemporalAggregation):
    """``pos, value``: see :func:`mean`."""

    def merge(self, packed, by):
        return mean(packed, by)


@dataclass(frozen=True)
class Hierarchical(TemporalAggregation):
    """``t_anchor, key, data``: see :func:`hierarchical`."""

    scales: tuple[int, ...] = ()

    def merge(self, packed, by):
        return hierarchical(packed, by, self.scales or None)


@dataclass(frozen=True)
class Forecast(TemporalAggregation):
    """``t_anchor, data``: see :func:`forecast`."""

    horizon: int = 1

    def merge(self, packed, by):
        return forecast(packed, by, self.horizon)
