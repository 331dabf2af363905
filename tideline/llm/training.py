"""Bounded, reproducible samples of labelled texts to fit a classifier on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled texts taken of each class.
PER_CLASS = 4000
#: Most bytes of text taken in all; a text that does not fit in what is left is passed over.
SAMPLE_BYTES = 20_000_000


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int = PER_CLASS,
    max_bytes: int = SAMPLE_BYTES,
) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels, the first of each class in the order of a hash of the id.

    Rows without a label, text or id take no part; of rows that repeat an id the
    smallest text counts. Only ids are sorted; texts are fetched for the chosen ones,
    which the two bounds keep small: a text longer than what is left of the bytes is
    passed over and the next one tried. Empty tables give an empty sample.
    """
    known = (
        labels.where(F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .join(docs.where(F.col("text").isNotNull()).select("doc_id").distinct(), "doc_id")
        .withColumn("at", F.xxhash64("doc_id"))
    )
    halves = [known.where(F.col("y") == y).orderBy("at", "doc_id").limit(per_class) for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("at", "doc_id", "y").agg(F.min("text").alias("text"))
    sizes = found.select("at", F.octet_length("text").alias("size")).orderBy("at", "doc_id").toPandas()
    last, skipped, left = -(2**63), [], max_bytes
    for at, size in zip(sizes["at"].tolist(), sizes["size"].tolist()):
        if size <= left:
            last, left = at, left - size
        else:
            skipped.append(at)
    skipped = [at for at in skipped if at <= last]
    fitting = F.col("at") <= last
    if skipped:
        fitting &= ~F.col("at").isin(skipped)
    rows = found.where(fitting).select("y", "at", "text").toPandas()
    rows = rows.sort_values(["at", "text"], ignore_index=True)
    return list(rows["text"]), rows["y"].to_numpy(np.int64)


class Adam:
    """Gradient steps with running moments, for a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step_no = params, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.var = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.step_no += 1
        for k, g in grads.items():
            self.mean[k] = 0.9 * self.mean[k] + 0.1 * g
            self.var[k] = 0.999 * self.var[k] + 0.001 * g * g
            m = self.mean[k] / (1 - 0.9**self.step_no)
            v = self.var[k] / (1 - 0.999**self.step_no)
            self.params[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
