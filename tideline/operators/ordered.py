"""Row-order operators that stay parallel inside one hot key.

A window function ordered within a key puts the whole key on one task. Here the
few keys that hold more rows than a task should take are cut, along the order
column, into cells of about equal size; the window function runs per (key, cell)
and the cell borders are stitched from a small table of cell summaries.

Only keys above ``max(max_rows, all rows / MAX_CELLS)`` are cut, so there are at
most ``MAX_CELLS`` of them with at most ``2 * MAX_CELLS`` cells altogether. That
fixed bound, independent of the data, is what makes the split and summary tables
safe to collect and to broadcast.

Rows are counted per key when the operator is built: one pass over the key
columns with partial sums. Where no key is hot, as is usual, the plan is then the
plain window function; a second pass finds the borders only of hot keys.

``order`` must be one numeric or timestamp column, unique within a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ROWS = 1_000_000
MAX_CELLS = 2048

CELL = "_cell"


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Null-safe join with a broadcast table of bounded size (see the module text)."""
    renamed = small.select(
        *[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in small.columns if c not in on]
    )
    same = reduce(Column.__and__, [df[k].eqNullSafe(renamed[f"_r_{k}"]) for k in on])
    joined = df.join(F.broadcast(renamed), same, how)
    return joined.drop(*[f"_r_{k}" for k in on])


def _held(small: DataFrame) -> DataFrame | None:
    """The rows of a small table, computed once; None where there are none."""
    rows = small.toArrow()
    return small.sparkSession.createDataFrame(rows, small.schema) if rows.num_rows else None


@dataclass(frozen=True)
class Cells:
    """How the rows of each key are cut; without ``splits`` no key is hot."""

    keys: tuple[str, ...]
    order: str
    splits: DataFrame | None

    @property
    def by(self) -> list[str]:
        """Columns that name a cell."""
        return [*self.keys] if self.splits is None else [*self.keys, CELL]

    def of(self, df: DataFrame) -> DataFrame:
        """Every row with its cell number; keys that are not hot have cell 0 only."""
        return df if self.splits is None else self._numbered(df, "left")

    def hot(self, df: DataFrame) -> DataFrame:
        """The rows of hot keys only, with their cell number."""
        return self._numbered(df, "inner")

    def numbers(self) -> DataFrame:
        """All cells of the hot keys."""
        last = F.expr("(size(_blocks) - 1) * _width + size(element_at(_blocks, -1))")
        return self.splits.select(*self.keys, F.explode(F.sequence(F.lit(0), last)).alias(CELL))

    def _numbered(self, df: DataFrame, how: str) -> DataFrame:
        passed = f"size(filter(_blocks, b -> b[0] < `{self.order}`))"
        number = F.expr(
            f"case when _blocks is null or {passed} = 0 then 0 else ({passed} - 1) * _width +"
            f" size(filter(element_at(_blocks, {passed}), x -> x < `{self.order}`)) end"
        )
        joined = join_small(df, self.splits, self.keys, how)
        return joined.withColumn(CELL, number.cast("int")).drop("_blocks", "_width")


def cut(df: DataFrame, keys: Sequence[str], order: str, max_rows: int = MAX_ROWS) -> Cells:
    """Find the hot keys of ``df`` and where to cut them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    limit = F.greatest(F.lit(max_rows), F.coalesce(total, F.lit(0)) / MAX_CELLS)
    hot = _held(
        counts.where(F.col("_n") > limit).select(
            *keys, F.least(F.ceil(F.col("_n") / limit), F.lit(MAX_CELLS)).alias("_pieces")
        )
    )
    if hot is None:
        return Cells(tuple(keys), order, None)
    rows = join_small(df.select(*keys, order), hot, keys, "inner")
    # One text literal keeps the plan small; thousands of literals would not.
    grid = ",".join(str(i / MAX_CELLS) for i in range(1, MAX_CELLS))
    borders = rows.groupBy(*keys, "_pieces").agg(
        F.percentile_approx(
            order, F.split(F.lit(grid), ",").cast("array<double>"), 10 * MAX_CELLS
        ).alias("_q")
    )
    every = F.expr(
        f"array_distinct(filter(_q, (x, i) -> (i + 1) * _pieces div {MAX_CELLS}"
        f" > i * _pieces div {MAX_CELLS}))"
    )
    picked = borders.select(*keys, every.alias("_q")).where(F.size("_q") > 0)
    # Two levels of about sqrt(cells) borders each, so a row looks at few of them.
    width = F.ceil(F.sqrt(F.size("_q"))).cast("int")
    blocks = F.expr(
        "transform(sequence(0, (size(_q) - 1) div _width),"
        " k -> slice(_q, cast(k * _width + 1 as int), _width))"
    )
    splits = picked.withColumn("_width", width).select(*keys, "_width", blocks.alias("_blocks"))
    return Cells(tuple(keys), order, _held(splits))


def _with_neighbour(
    df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str], forward: bool,
    max_rows: int,
) -> DataFrame:
    cells = cut(df, keys, order, max_rows)
    payload = F.struct(*dict.fromkeys(columns.values()))
    shift = F.lead if forward else F.lag
    inside = Window.partitionBy(*cells.by).orderBy(order)
    out = cells.of(df).withColumn("_near", shift(payload).over(inside))
    if cells.splits is not None:
        edge = (F.min_by if forward else F.max_by)(payload, F.col(order))
        edges = cells.hot(df).groupBy(*cells.by).agg(edge.alias("_edge"))
        across = Window.partitionBy(*keys).orderBy(CELL)
        borders = edges.select(*cells.by, shift("_edge").over(across).alias("_far"))
        out = join_small(out, borders, cells.by, "left")
        out = out.withColumn("_near", F.coalesce("_near", "_far"))
    return out.select(
        *df.columns, *[F.col("_near").getField(src).alias(name) for name, src in columns.items()]
    )


def with_next(
    df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str],
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add columns of the next row of the key: ``{new name: source column}``."""
    return _with_neighbour(df, keys, order, columns, True, max_rows)


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str],
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add columns of the previous row of the key: ``{new name: source column}``."""
    return _with_neighbour(df, keys, order, columns, False, max_rows)


def with_index(
    df: DataFrame, keys: Sequence[str], order: str, index: str = "idx", size: str = "n",
    max_rows: int = MAX_ROWS, keep_cell: bool = False,
) -> DataFrame:
    """Add the row's position in its key (from 0) and the number of rows of the key.

    With ``keep_cell`` the cell number stays where there is one; rows are then
    partitioned by key, or by (key, cell).
    """
    cells = cut(df, keys, order, max_rows)
    cell = Window.partitionBy(*cells.by)
    position = (F.row_number().over(cell.orderBy(order)) - 1).cast("bigint")
    out = cells.of(df).withColumns({index: position, size: F.count(F.lit(1)).over(cell)})
    if cells.splits is None:
        return out
    counts = cells.hot(df).groupBy(*cells.by).agg(F.count(F.lit(1)).alias("_c"))
    key = Window.partitionBy(*keys)
    offsets = counts.select(
        *cells.by,
        (F.sum("_c").over(key.orderBy(CELL)) - F.col("_c")).alias("_offset"),
        F.sum("_c").over(key).alias("_total"),
    )
    joined = join_small(out, offsets, cells.by, "left")
    return joined.select(
        *df.columns,
        *([CELL] if keep_cell else []),
        (F.col(index) + F.coalesce("_offset", F.lit(0))).alias(index),
        F.coalesce("_total", size).alias(size),
    )


def with_following(
    points: DataFrame, at: Column, rows: DataFrame, keys: Sequence[str], time: str, tie: str,
    columns: dict[str, str], max_rows: int = MAX_ROWS,
) -> DataFrame:
    """For each point, columns of the first row of its key later than ``at``.

    ``columns`` is ``{new name: column of rows}``; rows of equal time are taken
    by ``tie``. Points and rows are sorted together, so nothing is compared
    pairwise. Cells are cut by the rows; rows of one time stay in one cell. There
    should be no more points than rows in a key.
    """
    timed = rows.select(
        *keys, F.col(time).alias("_time"), F.col(tie).alias("_tie"),
        F.struct(*dict.fromkeys(columns.values())).alias("_row"),
    )
    cells = cut(timed, keys, "_time", max_rows)
    both = timed.withColumn("_kind", F.lit(0)).unionByName(
        points.select(
            *keys, at.alias("_time"), F.lit(1).alias("_kind"),
            F.struct(*points.columns).alias("_point"),
        ),
        allowMissingColumns=True,
    )
    # Sorted backwards, "the first later row" is the last one passed so far.
    backwards = (
        Window.partitionBy(*cells.by)
        .orderBy(F.col("_time").desc(), F.col("_kind").desc(), F.col("_tie").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = F.last("_row", ignorenulls=True).over(backwards)
    out = cells.of(both).withColumn("_near", found).where("_kind = 1")
    if cells.splits is not None:
        head = F.min_by("_row", F.struct("_time", "_tie")).alias("_head")
        heads = cells.hot(timed).groupBy(*cells.by).agg(head)
        across = Window.partitionBy(*keys).orderBy(F.col(CELL).desc()).rowsBetween(
            Window.unboundedPreceding, -1
        )
        far = join_small(cells.numbers(), heads, cells.by, "left").select(
            *cells.by, F.last("_head", ignorenulls=True).over(across).alias("_far")
        )
        out = join_small(out, far, cells.by, "left")
        out = out.withColumn("_near", F.coalesce("_near", "_far"))
    return out.select(
        "_point.*", *[F.col("_near").getField(src).alias(name) for name, src in columns.items()]
    )
