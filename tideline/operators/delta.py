"""Price-change operators: consecutive pairs, delta trigger, time evictor."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.numeric import price_changed
from tideline.functions.windows import tumbling
from tideline.operators.ordered import (
    CELL,
    MAX_ROWS,
    Cells,
    cut,
    join_small,
    with_following,
    with_next,
)
from tideline.operators.windowed import first_row

THRESHOLD = 0.05


def with_window(df: DataFrame, window: str | Column) -> DataFrame:
    """Add flat ``window_start`` / ``window_end`` columns."""
    w = tumbling(window) if isinstance(window, str) else window
    return df.withColumn("_w", w).select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *df.columns
    )


def price_warnings(
    prices: DataFrame, window: str | Column, threshold: float = THRESHOLD,
    changed: Callable[[str, str], Column] | None = None, max_rows: int = MAX_ROWS,
) -> DataFrame:
    """The older row of each pair of consecutive prices that differ too much.

    Pairs are formed by arrival within one symbol and window. ``changed`` may
    replace the predicate on the (old, new) columns.
    """
    flat = with_window(prices, window)
    pairs = with_next(
        flat, ["symbol", "window_start"], "arrival",
        {"next_price": "price", "next_arrival": "arrival"}, max_rows,
    )
    test = changed or (lambda old, new: price_changed(old, new, threshold))
    return pairs.where(F.col("next_arrival").isNotNull() & test("price", "next_price")).select(
        *flat.columns
    )


def _moved(ref: float, price: float, threshold: float) -> bool:
    if price == 0:
        return ref != 0
    return abs(ref / price - 1.0) > threshold


def _in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a group side by side in order, the first one marked ``_start``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_start", F.row_number().over(w) == 1)


def _fire(price: str, threshold: float):
    """Mark rows that fire, given the reference price each cell is entered with."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = None
        for batch in batches:
            fired = []
            for start, entry, p in zip(
                batch.column("_start").to_pylist(),
                batch.column("_entry").to_pylist(),
                batch.column(price).to_pylist(),
            ):
                if start:
                    ref = entry
                if p is not None and p != p:
                    p = None  # not a number: as a missing price
                hit = ref is not None and p is not None and _moved(ref, p, threshold)
                fired.append(hit)
                if hit or ref is None:
                    ref = p
            yield batch.append_column("_fired", pa.array(fired, pa.bool_()))

    return scan


class _CellTrace:
    """Where every possible entry price of a cell leads to.

    Prices of a positive feed fire an entry price for the first time at a new
    highest or lowest price, so only these rows are kept, each with the
    reference price that the cell is left with after firing there. References
    that fire at the same row go on as one, and neighbouring rows that have come
    to share their reference are kept as one price range. Once all entry prices
    from ``least`` to ``most``, the range of the cells before, have fired, no
    further row is kept; the first cell of a key (no range) keeps its first row.
    """

    COMPACT_AT = 10_000

    def __init__(self, threshold: float, least: float | None, most: float | None):
        self.threshold = threshold
        self.least, self.most = least, most
        self.complete = False
        self.low = self.high = None
        self.position = 0
        # Reference prices by number, and the reference each has gone over to.
        self.refs: list[float] = []
        self.parents: list[int] = []
        self.active: list[tuple[float, int]] = []
        # Position, lowest and highest price, reference number.
        self.records: list[tuple[int, float, float, int]] = []

    def add(self, price: float) -> None:
        fired = []
        while self.active and _moved(self.active[0][0], price, self.threshold):
            fired.append(self.active.pop(0)[1])
        while self.active and _moved(self.active[-1][0], price, self.threshold):
            fired.append(self.active.pop()[1])
        record = not self.complete and (
            price <= 0 or self.high is None or price > self.high or price < self.low
        )
        if price > 0:
            self.high = price if self.high is None else max(self.high, price)
            self.low = price if self.low is None else min(self.low, price)
        if record:
            self.complete = self._all_fired()
        if fired or record:
            node = len(self.refs)
            self.refs.append(price)
            self.parents.append(node)
            for old in fired:
                self.parents[old] = node
            insort(self.active, (price, node))
            if record:
                self.records.append((self.position, price, price, node))
        self.position += 1
        if len(self.refs) >= max(self.COMPACT_AT, 2 * len(self.active)):
            self._compact()

    def _all_fired(self) -> bool:
        if self.most is None:
            return True
        if self.high is None:
            return False
        above = self.high > self.most and (
            self.most <= 0 or _moved(self.most, self.high, self.threshold)
        )
        below = 0 < self.low < self.least and _moved(self.least, self.low, self.threshold)
        return above or below

    def _roots(self) -> list[int]:
        # A reference only ever goes over to a later one.
        roots = list(range(len(self.refs)))
        for node in range(len(self.refs) - 1, -1, -1):
            if self.parents[node] != node:
                roots[node] = roots[self.parents[node]]
        return roots

    def _compact(self) -> None:
        roots = self._roots()
        alive = sorted(node for _, node in self.active)
        number = {node: i for i, node in enumerate(alive)}
        merged: list[tuple[int, float, float, int]] = []
        for at, low, high, node in self.records:
            root = number[roots[node]]
            last = merged[-1] if merged else None
            if last and last[3] == root and low > 0 and last[1] > 0 and last[0] > 0:
                merged[-1] = (last[0], min(last[1], low), max(last[2], high), root)
            else:
                merged.append((at, low, high, root))
        self.refs = [self.refs[node] for node in alive]
        self.parents = list(range(len(alive)))
        self.active = [(ref, number[node]) for ref, node in self.active]
        self.records = merged

    def result(self) -> list[tuple[int, float, float, float]]:
        self._compact()
        return [(at, low, high, self.refs[node]) for at, low, high, node in self.records]


# What a cell trace holds, besides keys and cell number.
_TRACE = T.StructType([
    T.StructField("_at", T.LongType()),
    T.StructField("_low", T.DoubleType()),
    T.StructField("_high", T.DoubleType()),
    T.StructField("_exit", T.DoubleType()),
])


def _trace(keys: Sequence[str], price: str, threshold: float):
    def emit(key: pa.RecordBatch, trace: _CellTrace) -> pa.RecordBatch:
        found = trace.result()
        columns = list(key.take(pa.array([0] * len(found), pa.int64())).columns)
        for i, kind in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.float64())):
            columns.append(pa.array([r[i] for r in found], kind))
        return pa.RecordBatch.from_arrays(columns, names=[*keys, CELL, *_TRACE.names])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trace = None, None
        for batch in batches:
            head = batch.select([*keys, CELL])
            columns = ["_start", price, "_least", "_most"]
            for i, (start, p, least, most) in enumerate(
                zip(*[batch.column(c).to_pylist() for c in columns])
            ):
                if start:
                    if trace is not None:
                        yield emit(key, trace)
                    key, trace = head.slice(i, 1), _CellTrace(threshold, least, most)
                if p is not None:
                    trace.add(p)
        if trace is not None:
            yield emit(key, trace)

    return scan


def _enter(keys: Sequence[str], threshold: float):
    """Walk the cells of a key in order and note the price each is entered with."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, cell, leave = None, None, None
        for batch in batches:
            rows, entries = [], []
            columns = ["_start", CELL, "_low", "_high", "_exit"]
            for i, (start, at, low, high, end) in enumerate(
                zip(*[batch.column(c).to_pylist() for c in columns])
            ):
                if start or at != cell:
                    ref = None if start else (ref if leave is None else leave)
                    cell, leave = at, None
                    rows.append(i)
                    entries.append(ref)
                    if ref is None:
                        # The first price of the key is its first reference.
                        leave = end
                if leave is None and (
                    _moved(ref, low, threshold) or _moved(ref, high, threshold)
                ):
                    leave = end
            picked = batch.select([*keys, CELL]).take(pa.array(rows, pa.int64()))
            yield picked.append_column("_entry", pa.array(entries, pa.float64()))

    return scan


def delta_trigger(
    prices: DataFrame, keys: Sequence[str], order: str = "arrival", price: str = "price",
    threshold: float = THRESHOLD, max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Rows whose price differs from that of the last row that fired.

    The first price of a key is the first reference and does not fire; the
    reference moves only when a row fires. With the window among the keys this
    is the delta trigger of a window.

    The scan is sequential per key, so a hot key is cut into cells: each cell is
    first traced for all prices it could be entered with, the cells of a key are
    then walked through by these traces, and at last all cells are scanned in
    parallel from their known entry price.
    """
    cells = cut(prices, keys, order, max_rows)
    rows = cells.of(prices)
    if cells.splits is None:
        rows = rows.withColumn("_entry", F.lit(None).cast("double"))
    else:
        rows = join_small(rows, _entry_prices(prices, cells, price, threshold), cells.by, "left")
    rows = _in_order(rows, cells.by, [order])
    out = T.StructType(list(rows.schema.fields) + [T.StructField("_fired", T.BooleanType())])
    return rows.mapInArrow(_fire(price, threshold), out).where("_fired").select(*prices.columns)


def _entry_prices(prices: DataFrame, cells: Cells, price: str, threshold: float) -> DataFrame:
    """The reference price each cell of a hot key is entered with."""
    keys = cells.keys
    known = F.nanvl(F.col(price).cast("double"), F.lit(None).cast("double"))
    hot = cells.hot(prices.select(*keys, cells.order, known.alias(price)))
    before = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    ranges = hot.groupBy(*cells.by).agg(F.min(price).alias("_lo"), F.max(price).alias("_hi"))
    ranges = ranges.select(
        *cells.by, F.min("_lo").over(before).alias("_least"), F.max("_hi").over(before).alias("_most")
    )
    hot = join_small(hot, ranges, cells.by, "left")
    fields = [hot.schema[c] for c in cells.by]
    traced = T.StructType(fields + _TRACE.fields)
    traces = _in_order(hot, cells.by, [cells.order]).mapInArrow(
        _trace(keys, price, threshold), traced
    )
    entered = T.StructType(fields + [T.StructField("_entry", T.DoubleType())])
    return _in_order(traces, keys, [CELL, "_at"]).mapInArrow(_enter(keys, threshold), entered)


def first_of_fired(
    prices: DataFrame, window: str | Column, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS
) -> DataFrame:
    """The first row of the window, once for each firing of its delta trigger.

    Windows are per symbol; ``fired_arrival`` tells the rows that fired. First rows are
    a partial aggregate, so both sides of the join are spread over symbols and windows.
    """
    keys = ["symbol", "window_start", "window_end"]
    flat = with_window(prices, window)
    fired = delta_trigger(flat, keys, threshold=threshold, max_rows=max_rows).select(
        *[F.col(k).alias(f"_f_{k}") for k in keys], F.col("arrival").alias("fired_arrival")
    )
    firsts = first_row(prices, window, ["symbol"], ["price", "event_time", "arrival"])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in keys])
    return firsts.join(fired, same).select(*firsts.columns, "fired_arrival")


def evicted_delta_trigger(
    prices: DataFrame, keys: Sequence[str], keep_ms: int, time_ms: str = "ts_ms",
    order: str = "arrival", price: str = "price", threshold: float = THRESHOLD,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """For each row that fires, the first row that arrived at most ``keep_ms`` before.

    A row exactly ``keep_ms`` older is evicted already. Times must not decrease
    in arrival order. Gives the fired row's columns and those of the first kept
    row as ``first_<column>``.
    """
    fired = delta_trigger(prices, keys, order, price, threshold, max_rows)
    return with_following(
        fired, F.col(time_ms) - keep_ms, prices, keys, time_ms, order,
        {f"first_{c}": c for c in (order, time_ms, price)}, max_rows,
    )
