"""Several sources on one set of patches: an equi-join of cells, then one expansion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.domains import Configured
from fieldweave.operators.aggregations import Aggregation
from fieldweave.operators.coregister import on_patches
from fieldweave.operators.temporal import TemporalAggregation, TemporalPatcher, pack_times
from fieldweave.plans.patcher import SpatialPatcher
from fieldweave.sources.fields import Field

PRIMARY = "primary"
Coregister = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class MatchedField(Configured):
    """A primary field, and secondary ones on the same cells.

    ``coreg[name](secondary value, primary value)`` brings a secondary to the primary's terms.
    """

    primary: Field
    secondaries: dict[str, Field]
    coreg: dict[str, Coregister]

    def __post_init__(self):
        if PRIMARY in self.secondaries:
            raise ValueError(f"{PRIMARY!r} is taken by the primary field")
        if self.secondaries.keys() != self.coreg.keys():
            raise ValueError(f"secondaries {sorted(self.secondaries)} and coreg {sorted(self.coreg)} differ")

    @property
    def sources(self) -> list[str]:
        return [PRIMARY, *self.secondaries]

    def field(self) -> Field:
        """One wide field: a column for each source; cells of the primary."""
        keys = list(self.primary.keys)
        out = self.primary.df.select(*keys, F.col(self.primary.values[0]).alias(PRIMARY))
        for name, other in self.secondaries.items():
            out = out.join(other.df.select(*keys, F.col(other.values[0]).alias(f"_{name}")), keys, "left")
        out = out.select(*keys, PRIMARY, *[self.coreg[n](F.col(f"_{n}"), F.col(PRIMARY)).alias(n) for n in self.secondaries])
        return replace(self.primary, df=out, values=tuple(self.sources))

    def select(self, indexer) -> DataFrame:
        return self.field().select(indexer)


def valid(name: str) -> Column:
    """Is the value there and finite?"""
    v = F.col(name).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def _checked(aggregations: dict[str, Aggregation], matched: MatchedField) -> None:
    if unknown := aggregations.keys() - set(matched.secondaries):
        raise ValueError(f"no such source: {sorted(unknown)}")


@dataclass(frozen=True)
class MatchedSpatialPatcher(Configured):
    """Lockstep patches; secondaries without an aggregation aren't merged."""

    spatial: SpatialPatcher
    aggregations: dict[str, Aggregation] = field(default_factory=dict)
    masks: bool = True

    def split(self, matched: MatchedField, patches: dict[str, Callable] | None = None) -> DataFrame:
        """Patch cells with a column and a ``<source>_valid`` for each source.

        ``patches`` names opaque functions of whole patches, (secondary array, primary array) -> array, which
        follow the column expressions (see :func:`fieldweave.operators.coregister.on_patches`).
        """
        _checked(self.aggregations, matched)
        out = self.spatial.split(matched.field())
        if patches:
            if unknown := patches.keys() - set(matched.secondaries):
                raise ValueError(f"no such source: {sorted(unknown)}")
            out = on_patches(out, matched.primary.domain, patches, PRIMARY)
        return out.withColumns({f"{n}_valid": valid(n) for n in matched.sources}) if self.masks else out

    def merge(self, patch_cells: DataFrame, matched: MatchedField) -> DataFrame:
        """One row for each cell of the primary's domain: ``<source>`` or ``<source>_<output>``; one shuffle for all."""
        _checked(self.aggregations, matched)
        keys, w = list(matched.primary.keys), F.coalesce("w", F.lit(1.0))
        each = {PRIMARY: self.spatial.aggregation, **self.aggregations}
        found = patch_cells.groupBy(*keys).agg(*[c.alias(f"{n}__{k}") for n, agg in each.items() for k, c in agg.grouped(F.col(n), w).items()])
        out = matched.primary.df.select(*keys).join(found, keys, "left")
        for n, agg in each.items():
            rest = [c for c in out.columns if not c.startswith(f"{n}__")]
            own = agg.finish(out.select(*rest, *[F.col(f"{n}__{k}").alias(k) for k in agg.grouped(F.col(n), w)]))
            names = {k: n if len(agg.outputs) == 1 else f"{n}_{k}" for k in agg.outputs}
            out = own.select(*rest, *[F.coalesce(k, agg.untouched()[k]).alias(v) for k, v in names.items()])
        return out


@dataclass(frozen=True)
class MatchedTemporalPatcher(Configured):
    """Lockstep ranges of several series, joined by time before they are cut; sources without an aggregation aren't merged."""

    temporal: TemporalPatcher
    aggregations: dict[str, TemporalAggregation] = field(default_factory=dict)

    def split(self, matched: MatchedField) -> DataFrame:
        _checked({k: v for k, v in self.aggregations.items() if k != PRIMARY}, matched)
        return self.temporal.split(matched.field()).withColumns({f"{n}_valid": valid(n) for n in matched.sources})

    def merge(self, patch_times: DataFrame, matched: MatchedField) -> dict[str, DataFrame]:
        """The result of each source with an aggregation, by name."""
        _checked({k: v for k, v in self.aggregations.items() if k != PRIMARY}, matched)
        by = [k for k in matched.primary.keys if k != "t"]
        return {n: own.merge(pack_times(patch_times, by, n), by) for n, own in self.aggregations.items()}


@dataclass(frozen=True)
class MatchedSpatioTemporalPatcher(Configured):
    """Lockstep patches of several cubes; sources without an aggregation aren't merged by :meth:`merge`."""

    spacetime: object
    aggregations: dict[str, TemporalAggregation] = field(default_factory=dict)

    def split(self, matched: MatchedField, length: int) -> DataFrame:
        return self.spacetime.split(matched.field(), length).withColumns({f"{n}_valid": valid(n) for n in matched.sources})

    def merge(self, patch_cells: DataFrame, matched: MatchedField) -> dict[str, DataFrame]:
        """The temporal aggregation of each source by spatial anchor and offset, by name."""
        _checked({k: v for k, v in self.aggregations.items() if k != PRIMARY}, matched)
        return {n: self.spacetime.merge(patch_cells, matched.primary, own, n) for n, own in self.aggregations.items()}

    def merge_mean(self, patch_cells: DataFrame, matched: MatchedField) -> dict[str, DataFrame]:
        return {n: self.spacetime.merge_mean(patch_cells, matched.primary, n) for n in matched.sources}
