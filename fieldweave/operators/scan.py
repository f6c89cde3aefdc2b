"""Scans in order over a cluster: running sums, and running states of any associative operation.

``prefix_sums`` sorts by ranges, adds up inside each sorted partition as its rows pass by, and adds
what the partitions before hold (as many rows as partitions).  ``running`` works on numbered
elements of many series: stretches of ``CHUNK`` numbers are combined, then stretches of
stretches, until one is left; on the way back each level hands its members what stands
before them.  So no row or task holds a series, however long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.domains import Configured
from fieldweave.tables import written

#: Numbers of a stretch.
CHUNK = 128


def prefix_sums(df: DataFrame, order: list[str], amount: str, before: str = "before") -> DataFrame:
    """``df`` with the sum of ``amount`` (longs, null: 0) over all rows earlier in ``order``, which must tell rows apart."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(names.index(amount)).fill_null(0).to_numpy(zero_copy_only=False)
            upto = total + np.cumsum(own)
            local = pa.array(upto - own, pa.int64())
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part), pa.int64()), local], names=[*names, "_part", "_local"])

    schema = df.schema.simpleString()[7:-1] + ",_part:bigint,_local:bigint"
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    found = placed.groupBy("_part").agg(F.sum(amount).alias("n")).orderBy("_part").collect()  # as many rows as partitions
    sums, total = [], 0
    for r in found:
        sums.append((r["_part"], total))
        total += r["n"] or 0
    offsets = F.broadcast(df.sparkSession.createDataFrame(sums, "_part long, _before long"))
    return placed.join(offsets, "_part").select(*names, (F.col("_local") + F.col("_before")).alias(before))


@dataclass(frozen=True)
class Monoid(Configured):
    """An associative operation on elements that act on a state.

    ``lift(data)`` makes an element, ``combine(x, y)`` is x and then y, ``act(state, x)`` the state after x.
    """

    lift: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    act: Callable[[Column, Column], Column]


def affine(scale: float, term: Callable[[Column], Column]) -> Monoid:
    """``state * scale + term(data)``: maps x -> m x + b, closed under composition."""
    return Monoid(
        lambda data: F.struct(F.lit(float(scale)).alias("m"), term(data).cast("double").alias("b")),
        lambda x, y: F.struct((x["m"] * y["m"]).alias("m"), (x["b"] * y["m"] + y["b"]).alias("b")),
        lambda state, x: state * x["m"] + x["b"],
    )


def total_of() -> Monoid:
    """Sums of numbers."""
    return Monoid(lambda data: data.cast("double"), lambda x, y: x + y, lambda state, x: state + x)


def _stretches(elements: DataFrame, by: list[str]) -> DataFrame:
    """``by, _c, _l``: the members of each stretch of ``_i`` in order."""
    return elements.groupBy(*by, F.floor(F.col("_i") / CHUNK).alias("_c")).agg(F.array_sort(F.collect_list(F.struct("_i", "_k", "_m"))).alias("_l"))


def _folded(members: Column, combine) -> Column:
    """All members of a list, which isn't empty, as one."""
    return F.aggregate(F.slice(members, 2, F.greatest(F.size(members) - 1, F.lit(0))), F.element_at(members, 1)["_m"], lambda a, x: combine(a, x["_m"]))


def _running(elements: DataFrame, by: list[str], monoid: Monoid, last: int) -> DataFrame:
    """``by, _i, _k, _m, _b``: every element, and all that stands before it in its series as one (null: nothing)."""
    lists = _stretches(elements, by)
    if last >= CHUNK:
        lists = written(lists)
        above = lists.select(*by, F.col("_c").alias("_i"), F.lit(0).alias("_k"), _folded(F.col("_l"), monoid.combine).alias("_m"))
        before = _running(above, by, monoid, last // CHUNK).select(*(F.col(b).alias(f"_by_{b}") for b in by), F.col("_i").alias("_at"), F.col("_b").alias("_before"))
        met = F.col("_c") == F.col("_at")
        for b in by:
            met = met & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
        lists = lists.join(before, met)
    else:
        kind = elements.schema["_m"].dataType
        lists = lists.withColumn("_before", F.lit(None).cast(kind))
    # what stands before each member: each step adds one to the list and keeps the last
    both = lambda a, m: F.when(a.isNull(), m).otherwise(monoid.combine(a, m))
    start = F.array(F.col("_before"))
    runs = F.aggregate("_l", start, lambda a, x: F.concat(a, F.array(both(F.element_at(a, -1), x["_m"]))))
    return lists.select(*by, F.explode(F.arrays_zip(F.col("_l").alias("_l"), F.slice(runs, 1, F.size("_l")).alias("_r"))).alias("_x")).select(*by, "_x._l.*", F.col("_x._r").alias("_b"))


def running(patches: DataFrame, by: list[str], monoid: Monoid, initial: Column, data: str = "data", seq: str = "seq", tie: str | None = None) -> DataFrame:
    """``by, seq, (tie), state``: the state after each patch of each series in the order of ``seq`` (and ``tie``).

    ``seq`` are numbers from 0 up; those of one stretch, ``CHUNK`` numbers, share a row.
    """
    names = [seq, *([tie] if tie else [])]
    own = written(patches.select(*by, F.col(seq).cast("long").alias("_i"), (F.col(tie).cast("int") if tie else F.lit(0)).alias("_k"), monoid.lift(F.col(data)).alias("_m")))
    last = own.agg(F.max("_i")).first()[0] or 0
    found = _running(own, by, monoid, last)
    upto = F.when(F.col("_b").isNull(), F.col("_m")).otherwise(monoid.combine(F.col("_b"), F.col("_m")))
    return found.select(*by, F.col("_i").alias(seq), *([F.col("_k").alias(tie)] if tie else []), monoid.act(initial, upto).alias("state")).select(*by, *names, "state")


def whole(patches: DataFrame, by: list[str], monoid: Monoid, initial: Column, data: str = "data", seq: str = "seq", tie: str | None = None) -> DataFrame:
    """``by, state``: the state after the last patch of each series, by the way up alone."""
    own = patches.select(*by, F.col(seq).cast("long").alias("_i"), (F.col(tie).cast("int") if tie else F.lit(0)).alias("_k"), monoid.lift(F.col(data)).alias("_m"))
    own = written(own)
    last = own.agg(F.max("_i")).first()[0] or 0
    while last > 0:
        own = _stretches(own, by).select(*by, F.col("_c").alias("_i"), F.lit(0).alias("_k"), _folded(F.col("_l"), monoid.combine).alias("_m"))
        last //= CHUNK
    if own.schema and last == 0:  # several patches may share number 0
        own = own.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_k", "_m"))).alias("_l")).where(F.size("_l") > 0).select(*by, _folded(F.col("_l"), monoid.combine).alias("_m"))
    return own.select(*by, monoid.act(initial, F.col("_m")).alias("state"))
