"""Quality rules by compression: ratios of whole texts and of chunks against bands.

Repetitive text compresses too well, random or encoded text too badly. How well
clean text compresses depends on its length, so limits are given by length.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tideline.llm.common import BLANKS, filter_batches, map_batches, utf8

LEVEL = 3
CHUNK_BYTES = 2048
#: (bytes below which the limits hold, least ratio, greatest ratio), raw by compressed.
BANDS = (
    (128, 0.0, 2.2),
    (256, 0.9, 2.5),
    (512, 1.05, 2.6),
    (1024, 1.15, 2.8),
    (2048, 1.25, 3.0),
    (4096, 1.3, 3.2),
    (16384, 1.35, 3.5),
    (65536, 1.4, 4.0),
    (float("inf"), 1.4, 4.5),
)
#: A text goes when more than this share of its chunks is out of its band.
BAD_CHUNKS = 0.3
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
    " n_repeat_words bigint, base_failed boolean, ratio double, n_chunks bigint,"
    " n_repetitive_chunks bigint, n_dense_chunks bigint, kept boolean"
)


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for below, low, high in bands if n_bytes < below)


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of three that occur at least twice in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    repeated = np.fromiter(map(counts.__getitem__, windows), np.int64, n) > 1
    covered = np.zeros(n + 2, bool)
    for i in range(3):
        covered[i : i + n] |= repeated
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def chunk_ratios(text: bytes, packer, chunk_bytes: int = CHUNK_BYTES) -> list[tuple[int, float]]:
    """(bytes, ratio) of each chunk; a rest under half a chunk belongs to the one before."""
    starts = list(range(0, len(text), chunk_bytes))
    if len(starts) > 1 and len(text) - starts[-1] < chunk_bytes // 2:
        starts.pop()
    parts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
    return [(len(p), len(p) / len(packer.compress(p))) for p in parts]


def judged(text: bytes | None, packer, bands=BANDS) -> tuple:
    """The columns of ``SCHEMA`` for one text; a null counts as an empty text."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "replace"))
    blanks = len(text) - len(text.translate(None, BLANKS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeats = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    ratio = len(text) / len(packer.compress(text)) if text else 0.0
    low, high = band(len(text), bands)
    chunks = chunk_ratios(text, packer)
    repetitive = sum(r > band(size, bands)[1] for size, r in chunks)
    dense = sum(r < band(size, bands)[0] for size, r in chunks)
    fits = low <= ratio <= high and repetitive + dense <= BAD_CHUNKS * len(chunks)
    return (
        n, chars - blanks, symbols, duplicate_lines(text), repeats, failed,
        ratio, len(chunks), repetitive, dense, fits and not failed,
    )


def compression_rules(
    df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keys`` of every row with its counts, ratios and verdict ``kept``.

    Words are split at ASCII blanks. ``base_failed``: under 50 words, or more than
    half of the words in repeated windows of three. A text is kept when it does not
    fail those, its ratio lies in the band of its length, and not more than 30 % of
    its chunks of 2048 bytes are out of theirs. Null and empty texts have no words
    and are not kept. One text is held at a time; repeated rows are judged alike.
    """
    kinds = dict(df.dtypes)
    fields = [f.split() for f in SCHEMA.split(", ")]
    names = [f[0] for f in fields]
    types = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def judge(batch: pa.RecordBatch) -> dict:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        rows = [judged(t, packer) for t in utf8(batch.column(len(keys)))]
        columns = list(zip(*rows)) or [[] for _ in names]
        out = {k: batch.column(i) for i, k in enumerate(keys)}
        return out | {
            name: pa.array(c, types[kind]) for (name, kind), c in zip(fields, columns)
        }

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), SCHEMA])
    return map_batches(df.select(*keys, text), judge, schema)


def keep_fitting(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns."""

    def fitting(texts: list[bytes | None]) -> list[bool]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        return [judged(t, packer)[-1] for t in texts]

    return filter_batches(df, text, fitting, raw=True)
