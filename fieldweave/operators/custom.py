"""Samplers and neighbourhoods that a user writes in Python: table functions over Arrow.

A sampler is asked for its anchors part by part, so that parts are made by many tasks; a neighbourhood
is asked for the cells of each anchor, by a lateral join, and only keys travel: the field's values come
by an equi-join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.operators.geometry import Neighbourhood
from fieldweave.operators.samplers import Sampler, anchor_name
from fieldweave.plans.policy import picklable
from fieldweave.tables import written


def _function(schema: str, rows: Callable[..., Iterable[tuple]]):
    picklable(rows)

    class Rows:
        def eval(self, *args):
            yield from rows(*args)

    return F.udtf(Rows, returnType=schema, useArrow=False)


@dataclass(frozen=True)
class CustomSampler(Sampler):
    """``fn(domain, part, parts)`` yields the anchors of one part: a tuple of indices, or the id of a point or feature.

    Parts are asked for once, each by a task of its own; anchors are numbered part after part in
    the order in which they come.  Anchors outside of a raster or grid are an error.
    """

    fn: Callable
    parts: int = 1

    def table(self, spark: SparkSession, domain, geometry) -> DataFrame:
        dims = getattr(domain, "dims", None)
        names = [anchor_name(d) for d in dims] if dims else ["a_id"]
        sizes, parts, fn = list(dims.values()) if dims else None, self.parts, self.fn

        def rows(part: int):
            for k, anchor in enumerate(fn(domain, part, parts)):
                own = tuple(map(int, anchor)) if isinstance(anchor, tuple | list) else (int(anchor),)
                if sizes and (len(own) != len(sizes) or not all(0 <= a < n for a, n in zip(own, sizes, strict=True))):
                    raise ValueError(f"anchor {own} isn't in the domain")
                yield (k, *own)

        made = _function("_k long, " + ", ".join(f"{n} long" for n in names), rows)
        asked = spark.range(0, parts, 1, parts).withColumnRenamed("id", "_part")
        found = written(asked.lateralJoin(made(F.col("_part").outer())))
        counts = {r["_part"]: r["count"] for r in found.groupBy("_part").count().collect()}  # as many rows as parts
        before, total = [], 0
        for p in range(parts):
            before.append((p, total))
            total += counts.get(p, 0)
        offsets = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))
        return found.join(offsets, "_part").select((F.col("_before") + F.col("_k")).alias("seq"), *names)

    def count(self, domain, geometry) -> int:
        return self.table(SparkSession.active(), domain, geometry).count()


@dataclass(frozen=True)
class CustomNeighbourhood(Neighbourhood):
    """``fn(anchor)`` yields the keys of a patch's cells, as tuples, with a weight behind them if ``weighted``.

    ``anchor`` is a dict of the anchor's columns (``ax, ay`` for points and features, ``ar, ac`` on a raster ...).
    Keys that the field doesn't have are left out.
    """

    fn: Callable
    weighted: bool = False

    def patches(self, anchors: DataFrame, source) -> DataFrame:
        names, fn = [c for c in anchors.columns if c != "seq"], self.fn
        kinds = dict(source.df.dtypes)
        schema = ", ".join(f"{k} {kinds[k]}" for k in source.keys) + ", w double" * self.weighted

        def rows(*values):
            for found in fn(dict(zip(names, values, strict=True))):
                yield tuple(found) if isinstance(found, tuple | list) else (found,)

        made = _function(schema, rows)
        return anchors.lateralJoin(made(*[F.col(n).outer() for n in names])).join(source.df, list(source.keys))
