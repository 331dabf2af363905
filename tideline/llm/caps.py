"""Near-duplicate vectors by spherical-cap filters from structured product codes.

A filter is a direction; it holds the vectors inside a cap around it. Directions are
products of two small random codes, one for each half of the (rotated) coordinates, so
all directions whose cap holds a vector are listed from two short sorted lists. Close
vectors share a filter with high probability, distant ones hardly ever.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import map_batches, written
from tideline.llm.components import components

LEAST_COSINE = 0.93
#: Independent rotations, each with a code of its own.
CODES = 6
#: Code words of one half; fewer in low dimensions, where caps are large.
WORDS, WORDS_LOW, LOW_DIMENSION = 512, 32, 32
#: Least inner product with a filter, in deviations of a random vector's. A pair at
#: cosine 0.93 then shares one with probability 0.999, measured in 64 dimensions.
DEVIATIONS, MOST_HEIGHT = 3.72, 0.85
#: Vectors closer than this to a common one are counted together.
CELL_ANGLE = np.radians(1.0)
#: Angles nearer to the limit than this are settled by the vectors themselves.
MARGIN = 1e-6
SEED = 20
CHUNK = 128


@lru_cache(maxsize=8)
def product_code(dim: int) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Cap height, and for each code its rotation and the words of both halves."""
    rng = np.random.default_rng([SEED, dim])
    n = WORDS if dim >= LOW_DIMENSION else WORDS_LOW
    codes = []
    for _ in range(CODES):
        rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        halves = []
        for _ in range(2):
            words = rng.normal(size=(dim // 2, n))
            halves.append(words / np.linalg.norm(words, axis=0) / np.sqrt(2))
        codes.append((rotation, *halves))
    return min(DEVIATIONS / np.sqrt(dim), MOST_HEIGHT), codes


def filters_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter that exceeds the cap height; rows of ``x`` are unit vectors."""
    dim = max(8, x.shape[1] + x.shape[1] % 2)
    x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    height, codes = product_code(dim)
    rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK]
        for number, (rotation, left, right) in enumerate(codes):
            y = part @ rotation
            a, b = y[:, : dim // 2] @ left, y[:, dim // 2 :] @ right
            ia, ib = np.argsort(-a, 1), np.argsort(-b, 1)
            a, b = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
            # only words that exceed the height with the best word of the other half
            ka = max(1, int((a + b[:, :1] >= height).sum(1).max()))
            kb = max(1, int((b + a[:, :1] >= height).sum(1).max()))
            r, i, j = np.nonzero(a[:, :ka, None] + b[:, None, :kb] >= height)
            rows.append(r + at)
            n = left.shape[1]
            found.append((number * n + ia[r, i]) * n + ib[r, j])
    return np.concatenate(rows), np.concatenate(found)


def _unit(v) -> np.ndarray | None:
    """The vector in double precision at length one, or None where it has no direction."""
    if v is None or not len(v) or any(c is None for c in v):
        return None
    x = np.array(v, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or not top:
        return None
    x = x / top  # so that squares neither overflow nor vanish
    return x / np.sqrt(x @ x)


def _nodes(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(rid, id, label, dim, unit): rows that can link; rid stands for the whole row."""
    kinds = dict(df.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        units = [_unit(v) for v in batch.column(3).to_pylist()]
        good = pa.array([u is not None for u in units], pa.bool_())
        units = [u for u in units if u is not None]
        out = {n: batch.column(i).filter(good) for i, n in enumerate(("rid", "id", "label"))}
        return out | {
            "dim": pa.array([len(u) for u in units], pa.int32()),
            "unit": pa.array(units, pa.list_(pa.float64())),
        }

    rows = df.where(F.col(label).isNotNull()).select(_row(key, vector, label).alias("rid"), F.col(key).alias("id"), F.col(label).alias("label"), vector)
    schema = f"rid bigint, id {kinds[key]}, label {kinds[label]}, dim int, unit array<double>"
    return map_batches(rows, run, schema).dropDuplicates(["rid"])


def _row(key: str, vector: str, label: str):
    return F.xxhash64(F.col(key), F.col(label), F.col(vector))


def _listed(nodes: DataFrame) -> DataFrame:
    """(rid, bucket): the filters of each vector; a bucket is a label, dimension and filter."""

    def run(batch: pa.RecordBatch) -> dict:
        dims = np.array(batch.column(2).to_pylist(), np.int64)
        at, filters = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for d in np.unique(dims):
            own = np.nonzero(dims == d)[0]
            x = np.array(batch.column(3).take(pa.array(own)).to_pylist(), np.float64)
            rows, found = filters_of(x)
            at.append(own[rows])
            filters.append(found)
        at = pa.array(np.concatenate(at))
        return {n: batch.column(i).take(at) for i, n in enumerate(("rid", "label", "dim"))} | {"filter": np.concatenate(filters)}

    kind = dict(nodes.dtypes)["label"]
    found = map_batches(nodes.select("rid", "label", "dim", "unit"), run, f"rid bigint, label {kind}, dim int, filter bigint")
    return found.select("rid", F.xxhash64("label", "dim", "filter").alias("bucket"))


def _with_angles(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (x, y, ...) with the cosine and angle of their vectors; other labels' fall away."""
    side = lambda n: nodes.select(F.col("rid").alias(n), *(F.col(c).alias(n + c) for c in ("label", "dim", "unit")))
    both = pairs.join(side("x"), "x").join(side("y"), "y").where("xlabel = ylabel and xdim = ydim")
    columns = pairs.columns

    def run(batch: pa.RecordBatch) -> dict:
        ends = batch.column(len(columns)), batch.column(len(columns) + 1)
        x, y = (np.array(c.flatten()).reshape(len(batch), -1) if len(set(c.value_lengths().to_pylist())) < 2 else c.to_pylist() for c in ends)
        if isinstance(x, list):
            cos = np.array([np.dot(p, q) for p, q in zip(x, y)])
            gap = np.array([np.linalg.norm(np.subtract(p, q)) for p, q in zip(x, y)])
        else:
            cos = (x * y).sum(1)
            gap = np.sqrt(((x - y) ** 2).sum(1))
        angle = 2 * np.arcsin(np.minimum(1, gap / 2))  # exact for small angles too
        return {n: batch.column(i) for i, n in enumerate(columns)} | {"cosine": cos, "angle": angle}

    schema = ", ".join([*(f"{n} {t}" for n, t in pairs.dtypes), "cosine double, angle double"])
    return map_batches(both.select(*columns, "xunit", "yunit"), run, schema)


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``df``.

    Vectors of equal label and dimension link at a cosine of 0.93 or more. Vectors
    within one degree of the first vector of one of their buckets form a cell with it;
    cells, not vectors, are paired by filters. From the angle of two cells' centres and
    the cells' radii it follows mostly that all or none of their vectors link; only in
    between are the vectors compared. So many near copies of one vector are counted
    without listing their pairs. All links are checked in double precision.

    Null labels, and vectors that are null, empty, zero or not finite link with
    nothing. Equal rows are one vector; rows that share an id with another vector are
    vectors of their own. Rows with a null id are kept where nothing with an id is near.
    """
    nodes = written(_nodes(df, key, vector, label), "vectors")
    listed = written(_listed(nodes), "filters")
    heads = listed.groupBy("bucket").agg(F.min("rid").alias("y"), F.max("rid").alias("last")).where("y < last").drop("last")
    near = listed.join(heads, "bucket").where("rid <> y").select(F.col("rid").alias("x"), "y").distinct()
    near = _with_angles(near, nodes).where(F.col("angle") <= CELL_ANGLE)
    best = near.groupBy("x").agg(F.min_by("angle", "y").alias("far"), F.min("y").alias("y"))
    cells = nodes.select("rid", "id").join(best, F.col("rid") == F.col("x"), "left").select(
        "rid", "id", F.coalesce("y", "rid").alias("cell"), F.coalesce("far", F.lit(0.0)).alias("far")
    )
    cells = written(cells, "cells")
    sized = written(cells.groupBy("cell").agg(F.count("*").alias("size"), F.max("far").alias("radius")), "sizes")

    centres = listed.join(sized.select(F.col("cell").alias("rid")), "rid", "left_semi")
    pairs = centres.withColumnRenamed("rid", "x").join(centres.select(F.col("rid").alias("y"), F.col("bucket").alias("other")), (F.col("bucket") == F.col("other")) & (F.col("x") < F.col("y")))
    side = lambda n: sized.select(F.col("cell").alias(n), F.col("size").alias(n + "size"), F.col("radius").alias(n + "radius"))
    pairs = _with_angles(pairs.select("x", "y").distinct(), nodes).join(side("x"), "x").join(side("y"), "y")
    limit = float(np.arccos(LEAST_COSINE))
    spread = F.col("xradius") + F.col("yradius")
    single = (F.col("xsize") == 1) & (F.col("ysize") == 1) & (spread == 0)
    all_link = F.when(single, F.col("cosine") >= LEAST_COSINE).otherwise(F.col("angle") + spread <= limit - MARGIN)
    some_link = F.when(single, F.col("cosine") >= LEAST_COSINE).otherwise(F.col("angle") - spread <= limit + MARGIN)
    pairs = written(pairs.where(some_link).withColumn("whole", all_link), "cell_pairs")

    whole = pairs.where("whole")
    gained = whole.select(F.col("x").alias("cell"), F.col("ysize").alias("n")).unionByName(whole.select(F.col("y").alias("cell"), F.col("xsize").alias("n")))
    gained = gained.groupBy("cell").agg(F.sum("n").alias("gained"))
    part = pairs.where("not whole").select(F.col("x").alias("xcell"), F.col("y").alias("ycell"))
    members = cells.select("rid", "cell")
    part = part.join(members.select(F.col("rid").alias("x"), F.col("cell").alias("xcell")), "xcell").join(
        members.select(F.col("rid").alias("y"), F.col("cell").alias("ycell")), "ycell"
    )
    part = written(_with_angles(part.select("x", "y", "xcell", "ycell"), nodes).where(F.col("cosine") >= LEAST_COSINE), "part_links")
    single_links = part.select(F.col("x").alias("rid")).unionByName(part.select(F.col("y").alias("rid"))).groupBy("rid").agg(F.count("*").alias("own"))

    edges = whole.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(part.select(F.col("xcell").alias("a"), F.col("ycell").alias("b")).distinct())
    found = components(edges)
    named = cells.join(found, F.col("cell") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cell"))
    named = written(named.select("rid", "id", "cell", "comp"), "named")
    names = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    counts = sized.join(gained, "cell", "left").select("cell", (F.col("size") - 1 + F.coalesce("gained", F.lit(0))).alias("base"))
    result = named.join(names, "comp").join(counts, "cell").join(single_links, "rid", "left").select(
        "rid", (F.col("base") + F.coalesce("own", F.lit(0))).alias("n_links"), "component_id"
    )
    rows = df.select(F.col(key).alias("id"), _row(key, vector, label).alias("at")).join(result, F.col("at") == F.col("rid"), "left")
    component = F.coalesce("component_id", "id")
    return rows.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )
