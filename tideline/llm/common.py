"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from weakref import WeakSet

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import shared_dir

#: Entries a task keeps of what it has worked out for words; it starts anew beyond.
CACHE_ENTRIES = 400_000
#: Bytes of text turned into Python objects at once.
PIECE_BYTES = 4_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files lie; every machine of the cluster has them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object] | None], schema: str,
    text: str | None = None,
) -> DataFrame:
    """``fn`` of each Arrow batch, as columns by name.

    With the name of a column of texts, a batch is cut into slices of about
    ``PIECE_BYTES`` of it, so that what ``fn`` makes of one stays small.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, text) if text else batches:
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, text: str, keep: Callable[[list], list[bool]], raw: bool) -> DataFrame:
    """The rows of ``df`` whose text ``keep`` says True of, with all their columns.

    ``keep`` gets some texts at a time, as bytes if ``raw``. Only the texts go to the
    Python workers and only verdicts come back; the rows stay in the JVM, which spills
    them.
    """

    @F.arrow_udf("boolean")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        for column in batches:
            verdicts = []
            for part in pieces(column):
                verdicts += keep(utf8(part) if raw else part.to_pylist())
            yield pa.array(verdicts, pa.bool_())

    return df.where(good(F.col(text)))


def pieces(column: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in slices of about ``PIECE_BYTES``; a longer text is one of its own."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0), np.int64)
    groups = np.cumsum(sizes) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield column.slice(a, b - a)


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut as ``pieces`` cuts their column of texts."""
    for batch in batches:
        at = 0
        for part in pieces(batch.column(text)):
            yield batch.slice(at, len(part))
            at += len(part)


def utf8(column: pa.Array) -> list[bytes | None]:
    """Texts as bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


class Cache(dict):
    """What ``make`` gives for a key, kept for a bounded number of keys."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Generations(dict):
    """A cache that forgets, when full, what has not been used since it was last full."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: What this process keeps from task to task and can ``forget``.
KEPT: WeakSet = WeakSet()


def forget() -> None:
    """Empties what tasks of other operators have left: a Python worker serves one after another."""
    for kept in list(KEPT):
        kept.forget()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words, in order; to make one is cheaper than to look it up."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer, so that close inputs get unrelated bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


#: Bytes that :func:`bytes.split` cuts at: the blanks of the word patterns.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def held_out(doc_id: str, folds: int, fold: int):
    """True for rows whose crc32 of the id, as text, leaves ``fold``; null ids are not held out."""
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
    return F.coalesce(rest == fold, F.lit(False))
