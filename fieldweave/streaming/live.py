"""Fields that grow: merging and folding as Structured Streaming queries.

:func:`fold` folds rows as batches bring them.  :func:`fold_in_order` folds a key's rows in the
order of their times, whatever order they come in: rows wait in keyed state until the watermark
has passed them, so the result is that of a batch, and survives restarts with the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldweave.operators.aggregations import Aggregation, Reservoir, Sketch
from fieldweave.plans.patcher import SpatialPatcher
from fieldweave.plans.policy import check_streaming
from fieldweave.sources.fields import Field


def merge(cells: DataFrame, source: Field, patcher: SpatialPatcher, aggregation: Aggregation | None = None) -> DataFrame:
    """Merge of a stream of cells: every update of a cell is a row (output mode ``update`` or ``complete``)."""
    agg = aggregation or patcher.aggregation
    check_streaming(agg)
    weight = patcher._weight(source.domain, lambda d: F.col(f"o_{d}"))
    covered = patcher.geometry.cover(cells, source.domain, patcher.sampler).withColumn("w", weight)
    return agg.finish(covered.groupBy(*source.keys).agg(*[c.alias(k) for k, c in agg.grouped(F.col(source.values[0]), F.col("w")).items()]))


def windowed(cells: DataFrame, time: str, width: str, late: str, by: list[str], aggregation: Aggregation, value: str = "value") -> DataFrame:
    """Event-time windows with a watermark, merged by the same aggregations."""
    check_streaming(aggregation)
    own = cells.withWatermark(time, late).groupBy(F.window(time, width), *by)
    return aggregation.finish(own.agg(*[c.alias(k) for k, c in aggregation.grouped(F.col(value), F.lit(1.0)).items()]))


def sketches(cells: DataFrame, time: str, width: str, late: str, by: list[str], sketch: Sketch, value: str = "value") -> DataFrame:
    """``window, by, sketch``: a state for each event-time window and group, to be stored, and merged with any others by ``sketch.merge``."""
    if isinstance(sketch, Reservoir):
        raise ValueError("a reservoir ranks its rows, which streams can't")
    own = cells.withWatermark(time, late).withColumn("window", F.window(time, width))
    return sketch.sketch(own, value, ("window", *by))


def fold(rows: DataFrame, key: str, order: str, value: str, step, initial: float) -> DataFrame:
    """A left fold for each key that goes on from batch to batch: ``key, state``.

    Rows of one batch are folded in their order.
    """

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (acc,) = state.get if state.exists else (initial,)
        for row in pd.concat(list(pdfs)).sort_values(order).itertuples():
            acc = step(acc, getattr(row, value))
        state.update((float(acc),))
        yield pd.DataFrame({key: [k[0]], "state": [float(acc)]})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, state double", "acc double", "update", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """Rows that wait, the state so far, and timers at the first waiting row or at the end of a key's rest."""

    def __init__(self, key: str, time: str, order: str, value: str, step, initial: float, idle_ms: int | None):
        self.key, self.time, self.order, self.value, self.step, self.initial, self.idle_ms = key, time, order, value, step, initial, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state double, last long")
        self.waiting = handle.getListState("waiting", "t long, o long, v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = []
        for batch in rows:
            times = (batch[self.time].astype("datetime64[us]").astype("int64") // 1000).tolist()
            came += zip(times, batch[self.order].astype("int64").tolist(), batch[self.value].astype(float).tolist(), strict=True)
        for row in came:
            self.waiting.appendValue(row)
        yield self._settled(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settled(key, timerValues.getCurrentWatermarkInMs())

    def _settled(self, key, watermark: int) -> pd.DataFrame:
        """Fold what the watermark has passed, in order, and set the timer for what comes next."""
        acc, last = self.state.get() if self.state.exists() else (self.initial, None)
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, rest, out = [r for r in waiting if r[0] <= watermark], [r for r in waiting if r[0] > watermark], []
        for t, o, v in ready:
            acc = self.step(acc, v)
            out.append((key[0], pd.Timestamp(t, unit="ms"), o, float(acc)))
            last = t
        if ready:
            self.state.update((float(acc), last))
            self.waiting.put(rest) if rest else self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.handle.registerTimer(rest[0][0])
        elif self.idle_ms is not None and last is not None:
            if watermark >= last + self.idle_ms:
                self.state.clear()  # the key's next row begins anew
            else:
                self.handle.registerTimer(last + self.idle_ms)
        return pd.DataFrame(out, columns=["key", "time", "order", "state"]) if out else pd.DataFrame({"key": pd.Series(dtype=object), "time": pd.Series(dtype="datetime64[us]"), "order": pd.Series(dtype="int64"), "state": pd.Series(dtype=float)})

    def close(self) -> None:
        pass


def fold_in_order(rows: DataFrame, key: str, time: str, order: str, value: str, step, initial: float, late: str, idle_seconds: int | None = None) -> DataFrame:
    """``key, time, order, state``: the state after each row of a key, in the order of (``time``, ``order``).

    Rows more than ``late`` behind the latest time seen are dropped.  A row comes out when the watermark has passed it, so
    those of the last ``late`` wait.  A key without rows for ``idle_seconds`` of event time is forgotten, and begins with
    ``initial`` again.  Times count in milliseconds.  Needs (and sets) the RocksDB state store.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = dict(rows.dtypes)[key]
    processor = _InOrder(key, time, order, value, step, initial, None if idle_seconds is None else 1000 * idle_seconds)
    own = rows.select(key, time, order, value).withWatermark(time, late)
    out = own.groupBy(key).transformWithStateInPandas(processor, f"key {kind}, time timestamp, order long, state double", "Append", "EventTime")
    return out.withColumnRenamed("key", key)
