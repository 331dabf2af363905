"""Functions over all rows of a window, in order, without holding the window.

``window_apply`` takes what no partial aggregate can express: the rows of a group come
to the function one Arrow batch after the other, in order. Spark sorts (and spills)
them; a task holds one batch and what the function keeps. A group is one sequence, so
one task reads it: where a function is associative use ``windowed.window_reduce``, for
the relative price change ``delta.delta_trigger``, which cut hot groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tideline.operators.delta import with_window

#: Takes the rows of one group in order, gives the columns of its result.
GroupFunction = Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]


def _starts(batch: pa.RecordBatch, keys: Sequence[str]) -> list[int]:
    """Where the key differs from that of the row before; the first row always counts."""
    new = np.zeros(len(batch), bool)
    new[:1] = True
    for name in keys:
        column = batch.column(name)
        here, before = column.slice(1), column.slice(0, max(0, len(batch) - 1))
        new[1:] |= np.asarray(pc.fill_null(pc.not_equal(here, before), False))
        new[1:] |= np.asarray(pc.xor(pc.is_null(here), pc.is_null(before)))
    return np.flatnonzero(new).tolist()


def _pieces(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each stretch of equal keys in a batch."""
    for batch in batches:
        starts = _starts(batch, keys)
        for a, b in zip(starts, [*starts[1:], len(batch)]):
            key = (batch.column(k)[a].as_py() for k in keys)
            yield tuple("nan" if isinstance(k, float) and math.isnan(k) else k for k in key), batch.slice(a, b - a)


def group_apply(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], fn: GroupFunction, schema: T.StructType | str
) -> DataFrame:
    """``keys`` and the columns of ``schema`` that ``fn`` gives for each group.

    ``fn`` gets the rows of a group in ``order``, in batches, and need not read them
    all. Null and NaN keys are groups of their own; an empty table gives no rows.
    """
    state = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    out = T.StructType([df.schema[k] for k in keys] + list(state.fields))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_pieces(batches, keys), key=lambda piece: piece[0]):
            first = next(group)[1]
            name = first.select(list(keys)).slice(0, 1)

            def rows(first=first, group=group):
                yield first
                for _, piece in group:
                    yield piece

            for result in fn(rows()):
                repeated = name.take(pa.array(np.zeros(len(result), np.int64)))
                columns = [*repeated.columns, *(result.column(c) for c in state.names)]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def window_apply(
    df: DataFrame, window: str | Column, keys: Sequence[str], order: str, fn: GroupFunction,
    schema: T.StructType | str,
) -> DataFrame:
    """A user's function of all rows of each (window, keys), in ``order``."""
    flat = with_window(df, window)
    return group_apply(flat, [*keys, "window_start", "window_end"], [order], fn, schema)


def delta_trigger_where(
    prices: DataFrame, keys: Sequence[str], moved: Callable[[float, float], bool],
    order: str = "arrival", price: str = "price",
) -> DataFrame:
    """Rows whose price differs, by any predicate, from that of the last row that fired.

    ``moved(reference, price)`` is a plain function. The first price of a key is the
    first reference and does not fire; missing prices (null, NaN) neither fire nor
    become a reference. As nothing is known of the predicate, a key is one pass.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = None
        for batch in batches:
            fired = []
            for i, p in enumerate(batch.column(price).to_pylist()):
                if p is None or p != p:
                    continue
                if reference is None:
                    reference = p
                elif moved(reference, p):
                    fired.append(i)
                    reference = p
            if fired:
                yield batch.take(pa.array(fired, pa.int64()))

    rest = T.StructType([f for f in prices.schema.fields if f.name not in keys])
    return group_apply(prices, keys, [order], scan, rest).select(*prices.columns)
