"""The spatial plan: geometry x sampler x window x aggregation over a field.

``split`` gives patch cells (``seq``, anchors, offsets ``o_<dim>``, the cell, its values and
the weight ``w``).  ``merge`` deals them by cell.  Where the sampler is a lattice and the
operator works on single cells, ``merge_cells`` stays inside each cell's row: no join and
no shuffle, for a field of any size.

Shapes without a fixed size (caps, k nearest, radius, polygons) go through the same plan: their
patches are the points, features or cells near each anchor, with weight 1 or the shape's
own (a window needs a box), mapped whole, merged by cell or by anchor.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.domains import Configured, PointDomain, VectorDomain
from fieldweave.functions.windows import Boxcar, Window
from fieldweave.operators.aggregations import Aggregation, OverlapAdd
from fieldweave.operators.geometry import Neighbourhood, RadiusGraph, Rectangular, SphericalCap, centroid
from fieldweave.operators.opaque import Opaque
from fieldweave.operators.samplers import RegularStride, Sampler, anchor_name
from fieldweave.plans.policy import ErrorPolicy, Hooks, Journal, MapResult, anchor_key, check_streaming, deal_by_bytes, map_gathered, map_patches, read_patches
from fieldweave.sources.fields import Field
from fieldweave.tables import written


@dataclass(frozen=True)
class SpatialPatcher(Configured):
    geometry: Rectangular | Neighbourhood
    sampler: Sampler | None = None
    window: Window = field(default_factory=Boxcar)
    aggregation: Aggregation | Opaque = field(default_factory=OverlapAdd)
    errors: ErrorPolicy = field(default_factory=ErrorPolicy)
    journal: Journal | None = None
    hooks: Hooks | None = None
    #: Patches over this many bytes are an error; tasks hold one Arrow batch at a time.
    max_patch_bytes: int | None = None
    #: Tasks of :meth:`map` hold patches of about so many bytes together, dealt by their sizes.
    max_task_bytes: int | None = None
    #: Accepted for plans written with it; tasks already read ahead.
    prefetch: int = 0

    def get_config(self) -> dict:
        parts = {k: getattr(self, k) for k in ("geometry", "sampler", "window", "aggregation", "errors", "journal")}
        return {"kind": type(self).__name__, **{k: v.get_config() if v is not None else None for k, v in parts.items()}, "max_patch_bytes": self.max_patch_bytes, "max_task_bytes": self.max_task_bytes, "prefetch": self.prefetch}

    # ------------------------------------------------------------ anchors
    def _names(self, domain) -> list[str]:
        return ["a_id"] if isinstance(domain, PointDomain | VectorDomain) else [anchor_name(d) for d in domain.dims]

    def anchors(self, source: Field) -> DataFrame:
        """``seq`` and anchors, without those that the journal has as done."""
        out = self.sampler.table_of(source, self.geometry)
        return self.journal.pending(out, anchor_key(*self._names(source.domain))) if self.journal else out

    def n_anchors(self, source: Field) -> int:
        """By arithmetic or from the drawn list; the field isn't read."""
        return self.sampler.count(source.domain, self.geometry)

    # ------------------------------------------------------------ split
    def _lattice(self, source: Field) -> bool:
        return isinstance(self.geometry, Rectangular) and isinstance(self.sampler, RegularStride) and self.geometry.boundary in ("drop", "shrink") and self.journal is None

    def _weight(self, domain, offset: Callable[[str], Column]) -> Column:
        sizes = self.geometry.sizes(domain)
        return self.window.weight([offset(d) for d in sizes], list(sizes.values()))

    def split(self, source: Field, anchors: DataFrame | None = None) -> DataFrame:
        """Patch cells with weights.

        ``anchors`` replaces the sampler: (seq, ax, ay) places, labels on a grid, or polygons
        (seq, ring), as the geometry wants them; a sampler of points or features stands on the drawn ones.
        """
        if not self.hooks:
            return self._split(source, anchors)
        self.hooks.call("on_split_start", self.n_anchors(source) if self.journal is None and anchors is None else -1)
        if self.hooks.observe:
            return self.hooks.watched(self._split(source, anchors), "on_split_end", False)
        out = written(self._split(source, anchors))
        self.hooks.call("on_split_end")
        return out

    def _split(self, source: Field, anchors: DataFrame | None) -> DataFrame:
        domain = source.domain
        if isinstance(self.geometry, Neighbourhood):
            places = self._places(source) if anchors is None else anchors
            # a cube: what is counted by places meets these first, then their times; a distance alone is each row's own
            if isinstance(domain, PointDomain) and len(source.keys) > 1 and type(self.geometry) not in (RadiusGraph, SphericalCap):
                key = source.keys[0]
                own = Field(source.df.select(key, "x", "y").distinct(), domain, (key,), ())
                out = self.geometry.patches(places, own).join(source.df.drop("x", "y"), key)
            else:
                out = self.geometry.patches(places, source)
            return out if "w" in out.columns else out.withColumn("w", F.lit(1.0))
        if self._lattice(source) and anchors is None:
            out = self.geometry.cover(source.df, domain, self.sampler)
        else:
            out = self.geometry.expand(self.anchors(source) if anchors is None else anchors, source.df, domain)
        return out.withColumn("w", self._weight(domain, lambda d: F.col(f"o_{d}")))

    def _places(self, source: Field) -> DataFrame:
        """Where the drawn points are, or the drawn features' centroids."""
        if not isinstance(source.domain, PointDomain | VectorDomain):
            raise ValueError(f"{type(self.geometry).__name__} needs its anchors on {type(source.domain).__name__}")
        return self.anchors(source).join(self._located(source), "a_id").select("seq", "ax", "ay")

    def _located(self, source: Field) -> DataFrame:
        """``a_id, ax, ay`` of all points, or of all features by their centroids."""
        at = source.df
        if isinstance(source.domain, VectorDomain):
            at = at.select(*source.keys, centroid(F.col("ring")).alias("_p")).select(*source.keys, "_p.x", "_p.y")
        own = at.select(F.col(source.keys[0]).alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        return own.distinct() if len(source.keys) > 1 else own

    def patch_at(self, source: Field, anchor) -> DataFrame:
        """The cells of one patch, whatever the shape.

        Boxes: ``{dimension: index}``, cut from the field by its window alone.  Other shapes: the id of a point
        or feature, a place ``(x, y)``, labels ``{dimension: label}`` on a grid, or a ring as a list of places.
        """
        spark, domain = source.df.sparkSession, source.domain
        if isinstance(self.geometry, Neighbourhood):
            return self._split(source, self._one_place(source, anchor))
        one = spark.createDataFrame([(0, *(int(anchor[d]) for d in domain.dims))], "seq long, " + ", ".join(f"{n} long" for n in self._names(domain)))
        near = source.df
        for d, n in self.geometry.sizes(domain).items():
            near = near.where((F.col(d) >= anchor[d]) & (F.col(d) < anchor[d] + n))  # reaches the scan
        return self.geometry.expand(one, near, domain).withColumn("w", self._weight(domain, lambda d: F.col(f"o_{d}")))

    def _one_place(self, source: Field, anchor) -> DataFrame:
        """An anchor table of one row for shapes without a box."""
        spark = source.df.sparkSession
        if isinstance(anchor, dict):
            return spark.createDataFrame([(0, *(float(v) for v in anchor.values()))], "seq long, " + ", ".join(f"{anchor_name(d)} double" for d in anchor))
        if isinstance(anchor, list):
            return spark.createDataFrame([(0, [tuple(map(float, p)) for p in anchor])], "seq long, ring array<struct<x:double,y:double>>")
        if isinstance(anchor, tuple):
            return spark.createDataFrame([(0, *map(float, anchor))], "seq long, ax double, ay double")
        if not isinstance(source.domain, PointDomain | VectorDomain):
            raise ValueError(f"{type(self.geometry).__name__} needs a place on {type(source.domain).__name__}, not {anchor!r}")
        at = self._located(source).where(F.col("a_id") == anchor)
        return at.select(F.lit(0).cast("long").alias("seq"), "ax", "ay")

    def packed(self, source: Field, value: str | None = None, anchors: DataFrame | None = None) -> DataFrame:
        """One row for each patch: ``seq``, anchors, ``shape``, ``data`` and ``weights`` in row-major order.

        Patches without a box hold ``at``, the keys of their cells in order, in place of anchors.
        """
        cells, value = self.split(source, anchors), value or source.values[0]
        return pack_at(cells, list(source.keys), value) if isinstance(self.geometry, Neighbourhood) else pack(cells, source.domain, value)

    # ------------------------------------------------------------ apply and merge
    def map(self, source: Field, operator: Callable, value: str | None = None, anchors: DataFrame | None = None) -> MapResult:
        """Run an opaque operator on whole patches (see :func:`map_patches`).

        Points within a radius in the plane are cut out of blocks where the operator runs (see :func:`map_gathered`); other
        neighbourhoods, and those with hooks or tasks of so many bytes, are packed first, a row of the shuffle for each pair.
        """
        if self._gathers(source):
            name, places = value or source.values[0], self._places(source) if anchors is None else anchors
            own = source.df.select(*source.keys, "x", "y", F.col(name).cast("double").alias("_v"))
            return map_gathered(self.geometry.gathered(places, own), list(source.keys), "_v", self.geometry.radius, operator, self.errors, self.max_patch_bytes)
        packed = self.packed(source, value, anchors)
        if self.max_task_bytes:
            packed = deal_by_bytes(packed, self.max_task_bytes)
        return map_patches(packed, operator, self.errors, self.max_patch_bytes, self.hooks)

    def _gathers(self, source: Field) -> bool:
        near = self.geometry
        return type(near) is RadiusGraph and near.metric == "euclidean" and near.radius > 0 and isinstance(source.domain, PointDomain) and not self.hooks and not self.max_task_bytes

    def read(self, source: Field, reader: Callable, anchors: DataFrame | None = None) -> MapResult:
        """Patches from an opaque ``reader(anchor)`` on the executors, for fields that Spark can't read itself.

        ``anchor`` has ``seq``, the anchor's columns and ``shape``; shapes without a box have ``at``, the keys of the
        patch's cells in order, in place of the anchor's columns, and the reader gives a value for each.  Reads that
        fail follow the error policy.  Neighbourhoods that can't be placed raise at once.
        """
        if isinstance(self.geometry, Neighbourhood):
            placed = self._split(source, anchors)
            asked = pack_at(placed.select("seq", *source.keys, F.lit(0.0).alias("value"), "w"), list(source.keys)).select("seq", "at", "shape")
            return read_patches(asked, reader, self.errors, self.max_patch_bytes, self.hooks)
        sizes = self.geometry.sizes(source.domain)
        placed = self.geometry.placed(self.anchors(source), source.domain)
        asked = placed.withColumn("shape", F.array(*[F.col(f"n_{d}").cast("int") for d in sizes])).drop(*(f"n_{d}" for d in sizes))
        return read_patches(asked, reader, self.errors, self.max_patch_bytes, self.hooks)

    def merge(self, patch_cells: DataFrame, source: Field, value: str | Column = "value", dense: bool = True, aggregation: Aggregation | None = None) -> DataFrame:
        """One row for each cell from patch cells of any origin.

        Cells outside of the domain (of padded patches) are left out.  ``dense`` adds the
        cells that no patch covers.
        """
        agg, v = aggregation or self.aggregation, F.col(value) if isinstance(value, str) else value
        own, keys = patch_cells, list(source.keys)
        for d, n in getattr(source.domain, "dims", {}).items():
            own = own.where((F.col(d) >= 0) & (F.col(d) < n))
        if isinstance(agg, Opaque):
            out = agg.by_cell(own, keys, v, F.coalesce("w", F.lit(1.0)))
        else:
            out = agg.finish(own.groupBy(*keys).agg(*[c.alias(k) for k, c in agg.grouped(v, F.coalesce("w", F.lit(1.0))).items()]))
        if dense:
            empty = agg.untouched()
            out = source.df.select(*keys).join(out, keys, "left").select(*keys, *[F.coalesce(c, empty[c]).alias(c) for c in agg.outputs])
        return self._merged(out)

    def merge_anchors(self, patch_cells: DataFrame, value: str | Column = "value", aggregation: Aggregation | None = None) -> DataFrame:
        """One row for each anchor (``seq``): its patch's values as one."""
        agg, v = aggregation or self.aggregation, F.col(value) if isinstance(value, str) else value
        return self._merged(agg.finish(patch_cells.groupBy("seq").agg(*[c.alias(k) for k, c in agg.grouped(v, F.coalesce("w", F.lit(1.0))).items()])))

    def _merged(self, out: DataFrame) -> DataFrame:
        if not self.hooks:
            return out
        self.hooks.call("on_merge_start", -1)
        if self.hooks.observe:
            return self.hooks.watched(out, "on_merge_end", True)
        out = written(out)
        self.hooks.call("on_merge_end", out.count())
        return out

    def merge_cells(self, source: Field, operator: Callable[[Column], Column] | None = None, aggregation: Aggregation | None = None) -> DataFrame:
        """Split, apply and merge inside each row, for a lattice and an operator on cells.

        ``operator(cover)`` gives the value from a cover (``seq``, anchors and offsets by name)
        and the row's columns.  Nothing is joined or shuffled.
        """
        if not self._lattice(source):
            raise ValueError("merging inside rows needs a lattice sampler, drop or shrink, and no journal")
        agg, domain = aggregation or self.aggregation, source.domain
        value = operator or (lambda cover: F.col(source.values[0]))
        terms = self.geometry.terms(domain, self.sampler)
        if terms is not None:  # few covers: plain compiled arithmetic
            cols = {f"_v{i}": F.when(ok, value(x)) for i, (ok, x) in enumerate(terms)}
            cols |= {f"_w{i}": self._weight(domain, lambda d, x=x: x[f"o_{d}"]) for i, (_, x) in enumerate(terms)}
            rows = source.df.select(*source.keys, *[c.alias(k) for k, c in cols.items()])
            known = [(F.col(f"_v{i}"), F.col(f"_w{i}")) for i in range(len(terms))]
            if more := agg.prepared(known):
                rows = rows.withColumns(more)
            return self._merged(rows.select(*source.keys, *[c.alias(k) for k, c in agg.unrolled(known).items()]))
        made = F.transform(self.geometry.covers(domain, self.sampler), lambda x: F.struct(value(x).alias("v"), self._weight(domain, lambda d: x[f"o_{d}"]).alias("w")))
        rows = source.df.withColumn("_covers", made)
        return self._merged(rows.select(*source.keys, *[c.alias(k) for k, c in agg.local(F.col("_covers")).items()]))

    def stream_merge(self, source: Field, path: str, chunk: int, operator=None, weights: bool = False, shard: int | None = None) -> None:
        """Merge into a chunked table on disk (see :mod:`fieldweave.sources.tiles`).

        With ``weights`` an overlap-add is kept as its two sums, ``value`` and ``weight``, so
        that later patches can still be added; ``shard`` groups chunks by folders.
        """
        from fieldweave.sources.tiles import write_chunks

        check_streaming(self.aggregation)
        if weights:
            if not isinstance(self.aggregation, OverlapAdd):
                raise ValueError("only an overlap-add has a sum of weights")
            cells, value = self.split(source), F.col(source.values[0])
            sums = cells.groupBy(*source.keys).agg(F.coalesce(F.sum(value * F.col("w")), F.lit(0.0)).alias("value"), F.coalesce(F.sum(F.when(value.isNotNull(), F.col("w"))), F.lit(0.0)).alias("weight"))
            write_chunks(sums, path, chunk, ("value", "weight"), shard=shard)
            return
        merged = self.merge_cells(source, operator) if self._lattice(source) else self.merge(self.split(source), source)
        write_chunks(merged, path, chunk, self.aggregation.outputs, shard=shard)

    # ------------------------------------------------------------ whole-field statistics
    def reduce(self, source: Field, reducer, value: str | None = None) -> DataFrame:
        """A global statistic of all patches; without error policy, journal and hooks."""
        return reducer.reduce(self.split(source), value or source.values[0])

    def two_pass(self, source: Field, reducer, apply: Callable[[Column, Callable[[str], Column]], Column], aggregation: Aggregation | None = None) -> DataFrame:
        """Statistics first, then ``apply(value, statistic by name)`` on every cell, then the merge.

        The statistics are one row, which the second pass takes as literals.
        """
        stats = self.reduce(source, reducer).first().asDict()
        value = apply(F.col(source.values[0]), lambda name: F.lit(stats[name]))
        if self._lattice(source):
            return self.merge_cells(source, lambda cover: value, aggregation)
        return self.merge(self.split(source), source, value, aggregation=aggregation)


def pack(patch_cells: DataFrame, domain, value: str = "value") -> DataFrame:
    """Cell form to packed form."""
    dims = list(domain.dims)
    at = F.struct(*[f"o_{d}" for d in dims], F.col(value).alias("v"), "w")
    rows = patch_cells.groupBy("seq", *[anchor_name(d) for d in dims]).agg(F.array_sort(F.collect_list(at)).alias("_p"), *[(F.max(f"o_{d}") + 1).cast("int").alias(f"_n_{d}") for d in dims])
    return rows.select("seq", *[anchor_name(d) for d in dims], F.array(*[f"_n_{d}" for d in dims]).alias("shape"), F.transform("_p", lambda x: x["v"]).alias("data"), F.transform("_p", lambda x: x["w"]).alias("weights"))


def pack_at(patch_cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Cells of patches without a box to one row for each: ``at`` (keys), ``shape``, ``data`` and ``weights`` in the order of the keys."""
    rows = patch_cells.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct(F.struct(*keys).alias("at"), F.col(value).alias("v"), "w"))).alias("_p"))
    return rows.select("seq", F.transform("_p", lambda x: x["at"]).alias("at"), F.array(F.size("_p")).alias("shape"), F.transform("_p", lambda x: x["v"]).alias("data"), F.transform("_p", lambda x: x["w"]).alias("weights"))


def unpack_at(packed: DataFrame, value: str = "value") -> DataFrame:
    """The reverse of :func:`pack_at`."""
    return packed.select("seq", F.explode(F.arrays_zip("at", "data", "weights")).alias("_x")).select("seq", "_x.at.*", F.col("_x.data").alias(value), F.col("_x.weights").alias("w"))


def unpack(packed: DataFrame, domain, value: str = "value") -> DataFrame:
    """Packed form to cell form."""
    dims = list(domain.dims)
    out = packed.select("*", F.posexplode(F.arrays_zip("data", "weights")).alias("_i", "_x"))
    below, cols = F.lit(1), {}
    for k in reversed(range(len(dims))):
        cols[f"o_{dims[k]}"] = (F.floor(F.col("_i") / below) % F.get("shape", F.lit(k))).cast("long")
        below = below * F.get("shape", F.lit(k))
    out = out.withColumns(cols).withColumns({d: F.col(anchor_name(d)) + F.col(f"o_{d}") for d in dims})
    return out.select("seq", *[anchor_name(d) for d in dims], *[f"o_{d}" for d in dims], *dims, F.col("_x.data").alias(value), F.col("_x.weights").alias("w"))


def parallel_map(patcher: SpatialPatcher, source: Field, operator: Callable, on_error: str = "raise") -> DataFrame:
    """Packed patches after the operator, in the order of anchors."""
    if patcher.journal is not None:
        raise NotImplementedError("parallel_map keeps no journal")
    done = map_patches(patcher.packed(source), operator, ErrorPolicy(on_error), patcher.max_patch_bytes)
    return done.patches.orderBy("seq")


# ---------------------------------------------------------------- as a chain of transforms
def grid_sampler(patcher: SpatialPatcher) -> Callable[[Field], DataFrame]:
    return patcher.packed


def apply_to_chips(operator: Callable, policy: ErrorPolicy | None = None) -> Callable[[DataFrame], DataFrame]:
    return lambda packed: map_patches(packed, operator, policy).patches


def stitch(patcher: SpatialPatcher, source: Field) -> Callable[[DataFrame], DataFrame]:
    return lambda packed: patcher.merge(unpack(packed, source.domain), source)
