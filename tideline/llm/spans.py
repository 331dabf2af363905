"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences and clauses, every run of three consecutive ones is
hashed, and runs that occurred before, in the same text or in one with a smaller id,
are removed together with all sentences they cover.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tideline.llm.common import LOWER, forget, utf8, window_hashes

SPAN_SENTENCES = 3
#: Runs with fewer words are too common to be copies.
MIN_WORDS = 8
#: A sentence or clause ends with these.
MARKS = b".!?;:,|"
UNIT = re.compile(rb"[^.!?;:,|\n]*[.!?;:,|\n]+|[^.!?;:,|\n]+")


def sentences(text: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Where each sentence starts, hashes of the sentences, numbers of their words.

    Case, blanks and the marks between sentences do not count. What has no word belongs to the sentence before.
    """
    starts, hashes, counts = [], [], []
    for m in UNIT.finditer(text):
        words = m[0].translate(LOWER, MARKS).split()
        if words:
            starts.append(m.start())
            hashes.append(xxhash.xxh64_intdigest(b" ".join(words)))
            counts.append(len(words))
    return starts, np.array(hashes, np.uint64), np.array(counts, np.int64)


def runs(hashes: np.ndarray, counts: np.ndarray, size: int, min_words: int) -> tuple[np.ndarray, int]:
    """A hash of each run of ``size`` sentences, zero where it is too short, and its size.

    A text with fewer sentences is one run.
    """
    k = min(size, len(hashes))
    if not k:
        return np.empty(0, np.int64), 0
    found = window_hashes(hashes, k).view(np.int64).copy()
    total = np.concatenate([[0], np.cumsum(counts)])
    found[total[k:] - total[:-k] < min_words] = 0
    return found, k


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while a column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def span_hashes(docs: DataFrame, size: int, min_words: int) -> DataFrame:
    """(id, h): each different run of each text."""

    def run(batches):
        forget()
        for batch in batches:
            ids, out = [], []
            for i, t in enumerate(utf8(batch.column(1))):
                _, hashes, counts = sentences(t or b"")
                found = np.unique(runs(hashes, counts, size, min_words)[0])
                found = found[found != 0]
                ids.append(np.full(len(found), i))
                out.append(found)
            if ids:
                at = pa.array(np.concatenate(ids), pa.int64())
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(at), "h": np.concatenate(out)})

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, h bigint")


def without_repeats(text: bytes, earlier: set[int], size: int, min_words: int) -> tuple[bytes, int, int]:
    """The text without sentences in repeated runs; sentences and how many of them went.

    A run goes when it is in ``earlier`` or has occurred before in this text.
    """
    starts, hashes, counts = sentences(text)
    found, k = runs(hashes, counts, size, min_words)
    if not k:
        return text, 0, 0
    first = np.zeros(len(found), bool)
    first[np.unique(found, return_index=True)[1]] = True
    gone = (~first | np.isin(found, np.fromiter(earlier, np.int64, len(earlier)))) & (found != 0)
    covered = np.zeros(len(starts), bool)
    for i in range(k):
        covered[i : i + len(gone)] |= gone
    if not covered.any():
        return text, len(starts), 0
    ends = [*starts[1:], len(text)]
    left = [text[: starts[0]], *(text[a:b] for a, b, c in zip(starts, ends, covered) if not c)]
    return b"".join(left), len(starts), int(covered.sum())


def drop_repeated_spans(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SPAN_SENTENCES,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """All rows and columns of ``df``, ``text`` without repeated runs of sentences.

    Adds ``n_sentences`` and ``n_removed`` (with an underscore where a column has that
    name). The first occurrence, by (key, place in the text), stays. Texts may end up
    empty; a null text stays null. Rows that repeat a key count as one document, so
    they do not lose spans to each other; rows without a key only lose what they
    repeat themselves. Counts are combined before the shuffle, and the join by hash
    is one that Spark can split where a run is very frequent.
    """
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    found = span_hashes(docs, size, min_words)
    shared = found.groupBy("h").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last")
    later = found.join(shared.select("h", "head"), "h").where("id <> head")
    earlier = free_name(df, "earlier")
    listed = later.groupBy("id").agg(F.collect_set("h").alias(earlier))
    joined = df.join(listed.withColumnRenamed("id", free_name(df, "id_")), F.col(key) == F.col(free_name(df, "id_")), "left")
    joined = joined.select(*(df[c] for c in df.columns), earlier)
    n_sentences, n_removed = free_name(df, "n_sentences"), free_name(df, "n_removed")
    at = df.columns.index(text)

    def clean(batches):
        forget()
        for batch in batches:
            texts = utf8(batch.column(at))
            rows = [
                (None, 0, 0) if t is None else without_repeats(t, set(gone or ()), size, min_words)
                for t, gone in zip(texts, batch.column(len(batch.columns) - 1).to_pylist())
            ]
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array([r[0] for r in rows], pa.binary()).cast(pa.string())
            columns += [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)]
            names = [*batch.schema.names[:-1], n_sentences, n_removed]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType([*df.schema, StructField(n_sentences, LongType()), StructField(n_removed, LongType())])
    return joined.mapInArrow(clean, schema)
