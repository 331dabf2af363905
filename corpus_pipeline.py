"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and returns the columns of ``documents``,
the last one the pieces of packed sequences. Stages are written as Parquet and read
again, so that a lost executor costs no more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import compression, packing, spans, superminhash, toxicity
from tideline.llm.common import read, tokenizer_file, written
from tideline.llm.spans import free_name

#: Words beyond ASCII blanks, hash sets and token ids: SQL can't express any stage.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, fitted to the labelled ones left, calls toxic go.

    Every row is judged by its own text; null and empty ones score like a sentence
    without words.
    """
    model = toxicity.trained(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the compression bands go; null and empty texts are among them."""
    return compression.keep_fitting(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays, the one with the smallest id.

    Rows are judged one by one, by an identity made of the id and a hash of all
    columns: rows that share an id but not the text are different documents, and of
    rows with equal ids and alike texts the smaller hash stays. Rows without an id come
    after all others. Of fully equal rows one stays. Rows without words are like
    nothing and stay.
    """
    row = free_name(docs, "row")
    hashes = (F.xxhash64(*docs.columns), F.xxhash64(F.lit("second"), *docs.columns))
    name = F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))
    identity = F.struct(
        F.col("doc_id").isNull().alias("nameless"), name.alias("id"),
        *(h.alias(n) for h, n in zip(hashes, ("h1", "h2"))),
    )
    rows = docs.withColumn(row, identity)
    verdict = superminhash.near_duplicates(rows, row).where("kept").select(F.col(row).alias("kept_row")).distinct()
    kept = rows.join(verdict, F.col(row) == F.col("kept_row"), "left_semi")
    return kept.dropDuplicates([row]).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of sentences that occurred before go; texts and their lengths change.

    Documents that nothing is left of go too. Null texts stay null.
    """
    cleaned = spans.drop_repeated_spans(docs).select(*docs.columns)
    cleaned = cleaned.where("text is null or text <> ''")
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences; a null text counts as an empty one."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near-duplicates", drop_near_copies),
    ("repeated spans", drop_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
