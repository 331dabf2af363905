"""How far the word use of each source is from that of the others of its language.

Arrow kernels inside ``mapInArrow`` lower, split, encode and count the words of each
batch; the partial counts are merged by term into sparse columns, and shards of terms
become matrices (term by source) from which the divergences are summed. All
arithmetic is on integers, so results do not depend on the order of the sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import written

#: What stands between terms: ASCII without letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a term has to occur in.
MIN_DOCS = 3
#: Shares are counted in parts of this, and every term has this many occurrences beforehand.
UNIT, PRIOR = 1_000_000_000, 1
#: Places of the report of a source's own terms.
TOP_TERMS = 200
#: Bytes of text that a task counts at once.
SLICE_BYTES = 16_000_000
#: Terms of a shard and sources of a block, which bound the matrix of one group.
SHARD_TERMS, BLOCK_SOURCES = 20_000, 256
#: Entries worked on at once when a shard is summed.
STEP = 1_000_000


def _slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text; a longer text is a piece of its own."""
    sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0))
    groups = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def counted(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of some texts, one row for each group and term."""
    words = pc.split_pattern_regex(pc.ascii_lower(text.fill_null("")), BETWEEN)
    of = pa.table({"lang": lang.fill_null(""), "source": source.fill_null("")})
    terms = words.flatten().dictionary_encode()
    tokens = pa.table({"doc": pc.list_parent_indices(words), "code": terms.indices})
    by_doc = tokens.group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    groups = of.append_column("doc", pa.array(np.arange(len(of)), pa.int64())).group_by(
        ["lang", "source"], use_threads=False
    ).aggregate([("doc", "list")])
    of_doc = np.empty(len(of), np.int32)
    of_doc[np.asarray(groups["doc_list"].combine_chunks().flatten())] = np.repeat(
        np.arange(len(groups), dtype=np.int32), np.asarray(pc.list_value_length(groups["doc_list"]))
    )
    rows = pa.table({
        "group": pa.array(of_doc[np.asarray(by_doc["doc"])]),
        "code": by_doc["code"],
        "n": by_doc["count_all"],
    })
    merged = rows.group_by(["group", "code"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    out = pa.table({
        "lang": groups["lang"].take(merged["group"]),
        "source": groups["source"].take(merged["group"]),
        "term": terms.dictionary.take(merged["code"].combine_chunks()),
        "n": merged["n_sum"],
        "docs": merged["count_all"],
    })
    return out.filter(pc.not_equal(out["term"], ""))


def partial_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs) of each slice of a batch."""

    def run(batches):
        for batch in batches:
            for piece in _slices(batch, 2):
                yield from counted(*piece.columns).combine_chunks().to_batches()

    columns = [F.col(c).cast("string") for c in (lang, source, text)]
    return df.select(*columns).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def kept_terms(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, docs, n, sources): terms of at least ``min_docs`` documents of a language.

    ``sources`` lists (source, n). One shuffle: counts meet by (lang, term), so a
    frequent term brings a row for each source and slice, never for each document.
    """
    by_term = partial_counts(df, text, lang, source).repartition("lang", "term")
    by_source = by_term.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources")
    ).where(F.col("docs") >= min_docs)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + PRIOR) / (total + PRIOR terms)), in decimals so that nothing overflows.

    Where a language keeps no term no share is used, and any will do.
    """
    top = (count + F.lit(PRIOR)).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = F.greatest(total + F.lit(PRIOR) * terms, F.lit(1)).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, below)


def group_totals(df: DataFrame, terms: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, total, terms, lang_total, place): each group that occurs, numbered within its language."""
    groups = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    totals = terms.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    filled = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    return filled.withColumn("place", place)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) elementwise."""
    d = p - q
    return d * d // q


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum over the rows of ``divergence(p[:, i], q[:, j])`` for all i and j, some rows at a time."""
    out = np.zeros((p.shape[1], q.shape[1]), np.int64)
    rows = max(1, STEP // max(1, p.shape[1] * q.shape[1]))
    for a in range(0, len(p), rows):
        out += divergence(p[a : a + rows, :, None], q[a : a + rows, None, :]).sum(axis=0)
    return out


def _matrix(table: pa.Table, codes: np.ndarray, n_terms: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Sources of a block, their shares of a term they do not use, and (term, source) shares.

    Rows without a term name the sources; ``codes`` numbers the terms of the others.
    """
    named = np.asarray(pc.is_null(table["term"]))
    heads = table.filter(pa.array(named))
    places = np.asarray(heads["place"])
    order = np.argsort(places)
    absent = np.asarray(heads["p"])[order]
    matrix = np.broadcast_to(absent, (n_terms, len(absent))).copy()
    column = np.searchsorted(places[order], np.asarray(table["place"])[~named])
    matrix[codes[~named], column] = np.asarray(table["p"])[~named]
    return heads["source"].combine_chunks().take(pa.array(order)), absent, matrix


PAIRS = "lang string, source string, item string, value bigint, seen bigint, absent bigint, terms bigint"


def shard_pairs(key: tuple, table: pa.Table) -> pa.Table:
    """Partial sums of one shard of terms for all pairs of two blocks of sources."""
    lang, _, left, right = (k.as_py() for k in key)
    terms = table["term"].combine_chunks().dictionary_encode()
    codes = np.asarray(terms.indices.fill_null(0))
    n_terms = len(terms.dictionary)
    block = np.asarray(table["block"])
    sides = [_matrix(table.filter(pa.array(block == b)), codes[block == b], n_terms) for b in (left, right)]
    out = []
    for (names, p0, p), (items, q0, q) in [sides] if left == right else [sides, sides[::-1]]:
        n, m = len(names), len(items)
        i, j = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
        off = (i != j) if left == right else np.ones(n * m, bool)
        i, j = i[off], j[off]
        out.append(pa.table({
            "lang": pa.array([lang] * len(i), pa.string()),
            "source": names.take(pa.array(i)), "item": items.take(pa.array(j)),
            "value": pair_sums(p, q)[i, j], "seen": np.full(len(i), n_terms, np.int64),
            "absent": divergence(p0[i], q0[j]),
            "terms": np.full(len(i), table["terms"][0].as_py(), np.int64),
        }))
    return pa.concat_tables(out)


def source_pairs(counts: DataFrame, groups: DataFrame, shard_terms: int = SHARD_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """(lang, source, item, value): divergence of each group from each other source of its language.

    A shard holds about ``shard_terms`` terms, a task one shard of two blocks of
    sources; what a term adds where neither block uses it is added once at the end.
    """
    shards = F.floor(F.col("terms") / shard_terms) + 1
    common = ["lang", "source", "place", "terms"]
    used = counts.select(*common, "term", "p", F.expr(f"pmod(xxhash64(term), floor(terms / {shard_terms}) + 1)").alias("shard"))
    heads = groups.select(
        *common, F.lit(None).cast("string").alias("term"), share(F.lit(0), F.col("total"), F.col("terms")).alias("p"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), shards - 1)).alias("shard"),
    )
    last = groups.groupBy("lang").agg(F.floor(F.max("place") / block_sources).alias("last_block"))
    rows = used.unionByName(heads).withColumn("block", F.floor(F.col("place") / block_sources))
    rows = rows.join(last, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last_block")))
    keyed = rows.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    sums = keyed.groupBy("lang", "shard", "left", "right").applyInArrow(shard_pairs, PAIRS)
    total = sums.groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("absent").alias("absent"), F.max("terms").alias("terms")
    )
    return total.select("lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("absent")).alias("value"))


def own_terms(counts: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a group uses more than its language does."""
    p, q = F.col("p").cast("decimal(20,0)"), F.col("q").cast("decimal(20,0)")
    value = F.call_function("div", (p - q) * (p - q), q)
    return counts.where("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))


def audit(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
    shard_terms: int = SHARD_TERMS,
    block_sources: int = BLOCK_SOURCES,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) of ``df``.

    Part ``pair`` ranks all other sources of the language by the sum over its terms of
    floor((p - q)^2 / q), part ``term`` the ``top`` terms that the group uses more than
    its language; p and q are shares of the kept terms with one occurrence added.
    Null text, language and source are empty strings; groups without words count as
    such, and so do repeated rows. Ties go by the item's UTF-8 bytes. An empty table
    gives no rows. Other columns of ``df`` play no part.
    """
    terms = written(kept_terms(df, text, lang, source, min_docs), "kept_terms")
    groups = written(group_totals(df, terms, lang, source), "source_totals")
    used = terms.select("lang", "term", F.col("n").alias("lang_n"), F.explode("sources").alias("s"))
    used = used.select("lang", "term", "lang_n", F.col("s.source").alias("source"), F.col("s.n").alias("n"))
    counts = used.join(groups, ["lang", "source"]).select(
        "lang", "source", "place", "terms", "term",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(counts, groups, shard_terms, block_sources).withColumn("rank", F.row_number().over(by_value))
    own = own_terms(counts).withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(own.withColumn("part", F.lit("term")).select(*columns))
