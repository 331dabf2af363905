"""Toxicity by multiple-instance learning: sentences are the instances of a text.

A sentence is toxic with probability sigmoid(bias + sum of word weights), a text
when any of its sentences is (noisy-or). The weights are fitted to labels of whole
texts, yet afterwards tell which sentences are to blame.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import Cache, filter_batches, map_batches
from tideline.llm.training import Adam, labelled_sample, sigmoid

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
PREFIXES = range(2, 7)
MAX_FEATURES = 4096
#: Least G-squared between a feature and the labels (chance: far below one in a million).
LEAST_G2 = 24.0
ROUNDS = 400
RATE = 0.1
L2 = 1e-4
START_BIAS = -4.0
THRESHOLD = 0.5
#: Most labelled texts taken of each class.
PER_CLASS = 2500


def features(word: str) -> list[str]:
    """The word and its beginnings, which inflected forms share."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, words) of each sentence; a text without any has one empty sentence."""
    empty = True
    for m in SENTENCE.finditer(text):
        words = set(WORD.findall(m[0].lower()))
        if words:
            empty = False
            yield m.start(), m.end(), words
    if empty:
        yield 0, 0, set()


@dataclass
class NoisyOr:
    bias: float = START_BIAS
    weights: dict[str, float] = field(default_factory=dict)

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def _chosen(bags: list[list[list[str]]], y: np.ndarray) -> list[str]:
    """Features that occur in texts of one class far more often than in the other's."""
    counts = [Counter(), Counter()]
    of_word = Cache(features)
    for bag, label in zip(bags, y):
        counts[label].update({f for w in {w for words in bag for w in words} for f in of_word[w]})
    n = np.bincount(y, minlength=2).astype(float)
    names = [f for f in counts[0].keys() | counts[1].keys() if counts[0][f] + counts[1][f] >= 3]
    names.sort()
    table = np.array([[counts[0][f], counts[1][f]] for f in names], float).reshape(-1, 2)
    share = table.sum(1, keepdims=True) / n.sum()
    g2 = np.zeros(len(names))
    for seen, p in ((table, share), (n - table, 1 - share)):
        want = np.maximum(n * p, 1e-12)
        g2 += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / want), 0).sum(1)
    order = np.argsort(-g2, kind="stable")[:MAX_FEATURES]
    return [names[i] for i in order if g2[i] >= LEAST_G2]


def fit(texts: list[str], y: np.ndarray) -> NoisyOr:
    """Weights by full gradient steps on the likelihood of the texts' labels.

    With one class only, or no texts, nothing can be learnt: every weight is zero.
    """
    if len(set(y.tolist())) < 2:
        return NoisyOr(START_BIAS if not len(y) or y[0] == 0 else -START_BIAS)
    same: dict[str, str] = {}  # each word is held once
    bags = [[[same.setdefault(w, w) for w in words] for _, _, words in sentences(t)] for t in texts]
    names = _chosen(bags, y)
    index = {f: i for i, f in enumerate(names)}
    of_word = Cache(lambda w: [index[f] for f in features(w) if f in index])
    rows, cols, owner, plain = [], [], [], np.zeros(len(bags))
    for d, bag in enumerate(bags):
        for words in bag:
            hit = [i for w in words for i in of_word[w]]
            if hit:
                rows += [len(owner)] * len(hit)
                cols += hit
                owner.append(d)
            else:
                plain[d] += 1
    rows, cols, owner = (np.array(x, np.int64) for x in (rows, cols, owner))
    params = {"w": np.zeros(len(names)), "b": np.array([START_BIAS])}
    adam = Adam(params, RATE)
    for _ in range(ROUNDS):
        w, b = params["w"], params["b"][0]
        z = b + np.bincount(rows, w[cols], minlength=len(owner))
        total = plain * np.logaddexp(0, b)
        total += np.bincount(owner, np.logaddexp(0, z), minlength=len(y))
        # of the log-likelihood by the sum of softplus of a text's sentences
        slope = np.where(y == 1, 1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-3), -1.0)
        slope /= len(y)
        gz = slope[owner] * sigmoid(z)
        gb = gz.sum() + (slope * plain).sum() * sigmoid(np.array(b))
        gw = np.bincount(cols, gz[rows], minlength=len(names))
        adam.step({"w": L2 * w - gw, "b": np.array([-gb])})
    return NoisyOr(float(params["b"][0]), dict(zip(names, params["w"].tolist())))


def _softplus(z: float) -> float:
    return z if z > 30 else math.log1p(math.exp(z))


def text_score(text: str | None, model: NoisyOr, weight: Cache) -> tuple[float, int]:
    """Noisy-or of the sentences, and how many of them are toxic by themselves."""
    total, n = 0.0, 0
    for _, _, words in sentences(text or ""):
        z = model.bias + sum(map(weight.__getitem__, words))
        total += _softplus(z)
        n += z >= 0
    return -math.expm1(-total), n


def score(df: DataFrame, model: NoisyOr, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """``keys`` of every row with ``score`` and how many sentences are to blame.

    Null and empty texts get the score of one sentence without words. Whole texts
    are read, one at a time; repeated rows score alike.
    """
    kinds = dict(df.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        weight = Cache(model.word_weight)
        rows = [text_score(t, model, weight) for t in batch.column(len(keys)).to_pylist()]
        out = {k: batch.column(i) for i, k in enumerate(keys)}
        return out | {
            "score": pa.array([r[0] for r in rows], pa.float64()),
            "n_toxic_sentences": pa.array([r[1] for r in rows], pa.int64()),
        }

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "score double, n_toxic_sentences bigint"])
    return map_batches(df.select(*keys, text), run, schema)


def keep_clean(df: DataFrame, model: NoisyOr, text: str = "text") -> DataFrame:
    """The rows of ``df`` that score below the threshold, with all their columns."""

    def clean(texts: list[str | None]) -> list[bool]:
        weight = Cache(model.word_weight)
        return [text_score(t, model, weight)[0] < THRESHOLD for t in texts]

    return filter_batches(df, text, clean, raw=False)


def locate(df: DataFrame, model: NoisyOr, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per offending sentence: key, character span, probability and the sentence."""

    def run(batch: pa.RecordBatch) -> dict:
        weight = Cache(model.word_weight)
        rows = []
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for start, end, words in sentences(t or ""):
                z = model.bias + sum(map(weight.__getitem__, words))
                if z >= 0:
                    rows.append((k, start, end, float(sigmoid(np.array(z))), t[start:end]))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.string())
        names = (key, "start", "end", "probability", "sentence")
        return {n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)}

    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, start bigint, end bigint, probability double, sentence string"
    return map_batches(df.select(key, text), run, schema)


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> NoisyOr:
    """A model fitted to a bounded sample (see :mod:`training`) of the labelled rows."""
    return fit(*labelled_sample(docs, labels, label, PER_CLASS))
