"""Near-duplicate documents by SuperMinHash signatures, banding and exact checks.

Every element of a set walks through the signature's positions in a random order of
its own and offers step + random fraction at each; a position keeps the least offer.
Offers of one element are never at the same position, so the positions are
negatively correlated and the estimate varies less than with independent hashes. As
offers grow by one a step, a set is done when all positions hold an earlier step's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, forget, map_batches, mixed, pieces, utf8, window_hashes, word_hashes, written
from tideline.llm.components import components

SHINGLE_WORDS = 5
PERCENT = 75
POSITIONS = 128
#: Four rows a band: a pair of similarity 0.75 shares none of the 32 in 5 of a million cases.
ROWS = 4
BANDS = POSITIONS // ROWS
#: Least equal positions of 128, compared by four bits, to check a pair on its full sets;
#: a pair of similarity 0.75 has 98 on average and a deviation under 4.8.
LEAST_EQUAL = 78
#: Pairs that agree so much are looked at before the others.
LIKELY_EQUAL = 98
LANES = [f"lane{i}" for i in range(POSITIONS // 16)]
#: Partners of a class that are checked first, the most promising ones.
FIRST_CHECKS = 4
#: Elements worked on together; bounds a task's memory.
BLOCK = 100_000


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of the whole sequence where it is shorter."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(SHINGLE_WORDS, len(words))))


def _signature_block(elements: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    m = POSITIONS
    least = np.full(n * m, 0xFFFFFFFF, np.uint32)
    order = np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1))
    for step in range(m):
        h = mixed(elements + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = step + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(m - step) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(elements))
        position = order[rows, at]
        order[rows, at] = order[:, step]
        offer = np.uint32(step << 24) | (h >> np.uint64(40)).astype(np.uint32)
        np.minimum.at(least, owner * m + position, offer)
        done = least.reshape(n, m).max(1) < (step + 1) << 24
        going = ~done[owner]
        if not going.any():
            break
        if 2 * going.sum() < len(going):
            elements, owner, order = elements[going], owner[going], order[going]
    return least.reshape(n, m)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``POSITIONS`` values for each set, none of them empty."""
    out = [np.empty((0, POSITIONS), np.uint32)]
    start = 0
    while start < len(sets):
        end, size = start + 1, len(sets[start])
        while end < len(sets) and size + len(sets[end]) <= BLOCK:
            size += len(sets[end])
            end += 1
        if size <= BLOCK:
            part = sets[start:end]
            owner = np.repeat(np.arange(len(part)), [len(s) for s in part])
            out.append(_signature_block(np.concatenate(part), owner, len(part)))
        else:  # one long set, in pieces: the least offers of its parts
            pieces = [sets[start][i : i + BLOCK] for i in range(0, size, BLOCK)]
            each = [_signature_block(p, np.zeros(len(p), np.int64), 1) for p in pieces]
            out.append(reduce(np.minimum, each))
        start = end
    return np.concatenate(out)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if n else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def set_class(elements: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes())).astype(np.int64))


def signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_shingles, cls, bands, lane0, ...): null from cls on for empty sets.

    The lanes hold four bits of each position, sixteen to a long.
    """

    def sign(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        sets = [shingles(t) for t in utf8(texts)]
        full = [i for i, s in enumerate(sets) if len(s)]
        sig = signatures([sets[i] for i in full])
        bands = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + sig[:, i::ROWS].astype(np.uint64))
        bits = (mixed(sig.astype(np.uint64)) & np.uint64(15)).reshape(len(full), len(LANES), 16)
        lanes = (bits << np.arange(0, 64, 4, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)
        take = np.full(len(sets), -1)
        take[full] = np.arange(len(full))
        take = pa.array(take, pa.int64(), mask=take < 0)
        return pa.RecordBatch.from_pydict({
            "id": ids,
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "cls": pa.array([set_class(sets[i]) for i in full], pa.int64()).take(take),
            "bands": _lists(bands.view(np.int64)).take(take),
            **{name: pa.array(lanes[:, i]).take(take) for i, name in enumerate(LANES)},
        })

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1)):
                yield sign(batch.column(0).slice(at, len(texts)), texts)
                at += len(texts)

    kind = dict(df.dtypes)[key]
    schema = f"id {kind}, n_shingles bigint, cls bigint, bands array<bigint>, " + ", ".join(f"{n} bigint" for n in LANES)
    return df.select(key, text).mapInArrow(run, schema)


def _equal_positions() -> Column:
    """At how many positions the lanes of two nodes, x and y, agree."""

    def unequal(lane: str) -> Column:
        d = F.col("x" + lane).bitwiseXOR(F.col("y" + lane))
        for shift in (2, 1):  # the lowest bit of four gathers all of them
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return POSITIONS - reduce(lambda p, q: p + q, map(unequal, LANES))


def _may_link(least: int) -> Column:
    """Sizes and signatures of two nodes, x and y, allow the similarity asked for."""
    sizes = (100 * F.least("xn", "yn") >= PERCENT * F.greatest("xn", "yn"))
    return sizes & (_equal_positions() >= least)


def _marks(name: str) -> list[Column]:
    """What a node is compared by, named for one side of a pair."""
    lanes = (F.col(c).alias(name + c) for c in LANES)
    return [F.col("cls").alias(name), F.col("n_shingles").alias(name + "n"), *lanes]


def _sets(classes: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, elements): full sets of ``classes``, made anew from the texts of their documents."""
    wanted = classes.join(nodes.select("cls", "rep"), "cls")
    texts = docs.join(wanted, docs["id"] == wanted["rep"]).select("cls", "text")

    def make(batch: pa.RecordBatch) -> dict:
        rows = []
        for c, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            s = shingles(t)
            if len(s) and set_class(s) == c:  # an id may have another text as well
                rows.append((c, s.view(np.int64)))
        return {
            "cls": pa.array([r[0] for r in rows], pa.int64()),
            "elements": pa.array([r[1] for r in rows], pa.list_(pa.int64())),
        }

    made = map_batches(texts, make, "cls bigint, elements array<bigint>")
    return written(made.dropDuplicates(["cls"]), "sets")


def _alike() -> Column:
    """The full sets of x and y are similar enough."""
    shared = F.size(F.array_intersect("xset", "yset"))
    return 100 * shared >= PERCENT * (F.size("xset") + F.size("yset") - shared)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = _sets(ends, nodes, docs)
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("xset")), "a").join(
        sets.select(F.col("cls").alias("b"), F.col("elements").alias("yset")), "b"
    )
    return both.where(_alike()).select("a", "b").distinct()


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, main, cls, comp) of buckets that hold classes of several components.

    ``main`` is the component of the bucket's head.
    """
    labelled = members.join(found, members["cls"] == found["node"], "left").select(
        "bucket", "cls", F.coalesce("component", "cls").alias("comp"), (F.col("cls") == F.col("head")).alias("is_head")
    )
    several = (
        labelled.groupBy("bucket")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.when(F.col("is_head"), F.col("comp"))).alias("main"))
        .where("low < high")
        .select("bucket", "main")
    )
    return written(labelled.join(several, "bucket").select("bucket", "main", "cls", "comp"), "apart")


def _between(rest: DataFrame, marks: DataFrame, test: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of a bucket's classes in different components that pass ``test``.

    Of a pair at least one side is outside the component of the bucket's head.
    ``marks`` has what the test compares, ``extra`` the names of columns beyond a node's.
    """
    told = rest.join(marks, "cls")
    side = lambda n: [*_marks(n), *(F.col(c).alias(n + c) for c in extra)]
    odd = told.where("comp <> main").select("bucket", F.col("comp").alias("xc"), *side("x"))
    every = told.select(F.col("bucket").alias("other"), F.col("main").alias("ymain"), F.col("comp").alias("yc"), *side("y"))
    apart = (F.col("xc") != F.col("yc")) & ((F.col("yc") == F.col("ymain")) | (F.col("x") < F.col("y")))
    pairs = odd.join(every, (F.col("bucket") == F.col("other")) & apart & test)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components of ``found`` (node, component) and further links (a, b)."""
    names = found.select(F.col("node").alias("at"), F.col("component").alias("name"))
    ends = links.join(names, F.col("a") == F.col("at"), "left").select(F.coalesce("name", "a").alias("a"), "b")
    ends = ends.join(names, F.col("b") == F.col("at"), "left").select("a", F.coalesce("name", "b").alias("b"))
    own = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(own.unionByName(ends))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``df``.

    Documents link when their sets of 5-word shingles have a similarity of at least
    0.75; a component is what links reach, named by its smallest id, and ``kept``
    marks that document. Equal sets make one class, and only classes are compared:

    1. in every band bucket all classes are compared, by signature, with two of it, which
       differ from bucket to bucket; the likest partners of a class are checked first;
    2. links among these, on full sets, give first components;
    3. where a bucket still holds several components, every pair of classes from
       different ones is compared: first pairs with likely links, then, between the
       components these leave, all others, on full sets inside the join. Pairs inside
       a component add nothing to it.

    Documents without words or text link with nothing. Rows with a null id get their
    class's component and are kept only if it has no id. Rows that repeat an id are
    judged by their own text.
    """
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    marks = written(signed(docs, "id", "text"), "signatures")
    nodes = written(
        marks.where("cls is not null")
        .groupBy("cls")
        .agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), *(F.first(c).alias(c) for c in LANES)),
        "classes",
    )
    able = nodes.where("rep is not null")
    members = able.select("cls", F.explode("bands").alias("bucket"))
    # of the classes of a bucket, those first and last in an order of its own
    own = F.col("cls").bitwiseXOR(F.col("bucket"))
    shared = members.groupBy("bucket").agg(F.min(own).alias("first"), F.max(own).alias("last")).where("first < last")
    heads = [F.col(c).bitwiseXOR(F.col("bucket")).alias(h) for c, h in (("first", "head"), ("last", "tail"))]
    members = written(members.join(shared.select("bucket", *heads), "bucket"), "buckets")

    stars = members.select(F.col("cls").alias("x"), F.explode(F.array("head", "tail")).alias("y")).where("x <> y").distinct()
    stars = stars.join(able.select(*_marks("x")), "x").join(able.select(*_marks("y")), "y").where(_may_link(LEAST_EQUAL))
    likest = Window.partitionBy("x").orderBy(F.desc("equal"), "y")
    stars = stars.select("x", "y", _equal_positions().alias("equal")).withColumn("nth", F.row_number().over(likest))
    stars = stars.where(F.col("nth") <= FIRST_CHECKS).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    stars = written(stars.distinct(), "stars")
    links = written(verified(stars, able, docs), "links")
    first = components(links)

    marked = able.select("cls", "n_shingles", *LANES)
    likely = written(_between(_apart(members, first), marked, _may_link(LIKELY_EQUAL)), "likely")
    second = _joined(first, verified(likely, able, docs))
    rest = _apart(members, second)
    sets = _sets(rest.select("cls").distinct(), able, docs).withColumnRenamed("elements", "set")
    links = _between(rest, marked.join(sets, "cls"), _may_link(LEAST_EQUAL) & _alike(), ("set",))
    final = _joined(second, links)

    named = nodes.select("cls", "rep").join(final, nodes["cls"] == final["node"], "left")
    named = named.select("cls", "rep", F.coalesce("component", "cls").alias("comp"))
    names = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = named.join(names, "comp").select("cls", "component_id")
    out = marks.select("id", "n_shingles", "cls").join(of_class, "cls", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )
