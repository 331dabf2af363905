"""License scans by diagonal voting.

Hashes of all runs of three words are joined to the places where license templates have
them. Hits of one copy of a template share the offset between text and template, their
diagonal; words put in or left out move it a little, so neighbouring diagonals are
merged. Spans with enough votes are compared with the template word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import map_batches, utf8, window_hashes, word_hashes
from tideline.llm.license_texts import PHRASES, TEMPLATES

GRAM = 3
#: Diagonals of one copy are at most so far from the next.
NEAR = 4
#: Least share of a template's runs that must vote for a span.
LEAST_VOTES = 0.3
#: Least share of a template's words that a span must have, in order.
LEAST_SHARE = 0.8
#: One-line forms, of fewer words, differ by a word or two: they must stand there whole.
WHOLE_BELOW = 20
_WORD = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
_TABLE = bytes(
    b if b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
_PHRASES = [(label, phrase.encode().split()) for label, phrase in PHRASES]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of each place where the words of a phrase stand."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for label, phrase in _PHRASES:
        if b" " + b" ".join(phrase) + b" " in joined:
            n = len(phrase)
            found += [(i, label) for i, w in enumerate(words) if w == phrase[0] and words[i : i + n] == phrase]
    return found


def common_words(template: list[bytes], span: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits of an integer."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    row = full
    for w in span:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(template) - row.bit_count()


def share_of(template: list[bytes], span: list[bytes]) -> float:
    """Share of the template's words that the span has in order; 1 or 0 for one-line forms."""
    if len(template) < WHOLE_BELOW:
        return float(b" " + b" ".join(template) + b" " in b" " + b" ".join(span) + b" ")
    return common_words(template, span) / len(template)


def template_places(spark: SparkSession, templates) -> DataFrame:
    """(h, template, tpos) of every run of words; as many rows as the templates have words."""
    rows = []
    for t, (_, text) in enumerate(templates):
        grams = window_hashes(word_hashes(words_of(text.encode())), GRAM).view(np.int64)
        rows += [(int(h), t, i) for i, h in enumerate(grams)]
    return spark.createDataFrame(rows, "h bigint, template int, tpos int")


def spans(df: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(row_key, template, first_word, end_word, votes) of merged diagonals in ``df`` (row_key, text)."""

    known = sorted({w for _, text in templates for w in words_of(text.encode())})
    hashes = dict(zip(known, word_hashes(known).tolist()))

    def grams(batch: pa.RecordBatch) -> dict:
        """Runs all of whose words are in some template; no other has a place there."""
        each, ats, places = [], [], []
        for at, t in enumerate(utf8(batch.column(1))):
            words = words_of(t)
            made = np.fromiter((hashes.get(w, 0) for w in words), np.uint64, len(words))
            have, n = made != 0, max(0, len(made) - GRAM + 1)
            starts = np.flatnonzero(np.logical_and.reduce([have[i : i + n] for i in range(GRAM)]))
            each.append(window_hashes(made, GRAM)[starts])
            ats.append(np.full(len(starts), at))
            places.append(starts)
        empty = np.empty(0, np.int64)
        return {
            "row_key": batch.column(0).take(pa.array(np.concatenate([empty, *ats]))),
            "pos": np.concatenate([empty, *places]).astype(np.int32),
            "h": np.concatenate([np.empty(0, np.uint64), *each]).view(np.int64),
        }

    runs = map_batches(df.select("row_key", "text"), grams, "row_key bigint, pos int, h bigint", "text")
    places = template_places(df.sparkSession, templates)  # of fixed size: broadcast
    hits = runs.join(F.broadcast(places), "h")
    diagonals = hits.groupBy("row_key", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    near = Window.partitionBy("row_key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > NEAR, F.lit(True))
    copies = diagonals.withColumn("apart", apart.cast("int")).withColumn("copy", F.sum("apart").over(near))
    sizes = [max(1, len(words_of(t.encode())) - GRAM + 1) for _, t in templates]
    least = F.array(*(F.lit(max(1, int(LEAST_VOTES * n))) for n in sizes))
    return (
        copies.groupBy("row_key", "template", "copy")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first_word"), (F.max("last") + GRAM).alias("end_word"))
        .where(F.col("votes") >= F.element_at(least, F.col("template") + 1))
        .drop("copy")
    )


SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string,"
    " labels string, score double, spans array<struct<label:string,first_word:bigint,end_word:bigint,share:double>>"
)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """``key`` of every row with places of phrases, labels, score and verified spans.

    Words are runs of ASCII letters, digits and all other characters from U+0080.
    ``labels`` are those of phrases and of templates with a span that has at least
    80 % of the template's words in order, all of them side by side where they are
    fewer than 20; ``score`` is the greatest such share, 1
    where a phrase occurs, else 0. Null texts count as empty. Rows are told apart by
    a hash of id and text, so null and repeated ids do no harm.
    """
    kind = dict(df.dtypes)[key]
    docs = df.select(
        F.xxhash64(F.col(key), F.col(text)).alias("row_key"), F.col(key).alias("id"), F.col(text).alias("text")
    )
    found = spans(docs, templates).groupBy("row_key").agg(
        F.sort_array(F.collect_list(F.struct("template", "first_word", "end_word"))).alias("found")
    )
    joined = docs.join(found, "row_key", "left").select("id", "text", "found")
    wanted = [(label, words_of(t.encode())) for label, t in templates]

    def verify(batch: pa.RecordBatch) -> dict:
        rows = []
        for t, candidates in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
            words = words_of(t)
            places = phrase_places(words)
            good = []
            for c in candidates or ():
                label, template = wanted[c["template"]]
                a, b = max(0, c["first_word"] - NEAR), c["end_word"] + NEAR
                share = share_of(template, words[a:b])
                if share >= LEAST_SHARE:
                    good.append({"label": label, "first_word": c["first_word"], "end_word": c["end_word"], "share": share})
            base = {label for _, label in places}
            starts = [i for i, _ in places]
            rows.append((
                len(words), len(places), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(base | {s["label"] for s in good})),
                1.0 if base else max((s["share"] for s in good), default=0.0), good,
            ))
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
        columns = list(zip(*rows)) or [[]] * 8
        return {key: batch.column(0)} | {n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)}

    return map_batches(joined, verify, f"`{key}` {kind}, {SCHEMA}", "text")
