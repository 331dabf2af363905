"""Quality by attention-based multiple-instance learning: passages of a text.

Every passage is encoded, a gated attention weighs the passages of a text, and the
weighted sum of their encodings is scored. All of it is fitted to labels of texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import map_batches, utf8
from tideline.llm.training import Adam, labelled_sample, sigmoid

PASSAGE_WORDS = 64
HIDDEN = 16
ROUNDS = 300
RATE = 0.02
L2 = 1e-4
THRESHOLD = 0.7
#: Most labelled texts taken of each class.
PER_CLASS = 2500
SEED = 7

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_PLAIN = b".,;:'\"-()?"
_ODD = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGITS + _PLAIN)
_HIGH = bytes(range(128, 256))
_CLASSES = (_UPPER, _LOWER, _DIGITS, _PLAIN, _ODD, _HIGH, b"|", b"!")
N_FEATURES = len(_CLASSES) + 6


def passage_features(words: list[bytes]) -> list[float]:
    """Shares of character classes and of repeated words, word lengths, size."""
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    text = b"".join(words)
    size = len(text)
    different = set(words)
    return [
        *((size - len(text.translate(None, c))) / size for c in _CLASSES),
        len(different) / n,
        sum(map(eq, words, words[1:])) / n,
        size / n / 10,
        max(map(len, different)) / 40,
        sum(w[-1] in b".?!" for w in words) / n,
        n / PASSAGE_WORDS,
    ]


def passages(text: bytes | None) -> list[list[float]]:
    """Features of each passage of the whole text; a text without words has an empty one."""
    words = (text or b"").split()
    starts = range(0, max(1, len(words)), PASSAGE_WORDS)
    return [passage_features(words[i : i + PASSAGE_WORDS]) for i in starts]


def bags(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the text that each belongs to."""
    each = [passages(t) for t in texts]
    owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
    return np.array([p for x in each for p in x], float).reshape(-1, N_FEATURES), owner


@dataclass
class GatedAttention:
    params: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = self.params
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["wb"])
        a, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (a * g) @ p["q"]
        e = np.exp(np.clip(e, -40, 40))
        e /= np.bincount(owner, e, minlength=n)[owner]
        z = _sums(owner, e[:, None] * h, n)
        return {"x": x, "h": h, "a": a, "g": g, "att": e, "z": z, "s": z @ p["c"] + p["cb"][0]}

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, number of passages and first word of the weightiest passage of each text."""
        x, owner = bags(texts)
        f = self.forward(x, owner, len(texts))
        count = np.bincount(owner, minlength=len(texts))
        order = np.lexsort((np.arange(len(owner)), -f["att"], owner))
        first = order[np.cumsum(count) - count]
        start = first - (np.cumsum(count) - count)
        return sigmoid(f["s"]), count, start * PASSAGE_WORDS


def _sums(owner: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by owner; owners are sorted and each has a row."""
    if not n:
        return np.zeros((0, x.shape[1]))
    return np.add.reduceat(x, np.searchsorted(owner, np.arange(n)), axis=0)


def fit(texts: list[bytes], y: np.ndarray) -> GatedAttention:
    """Full gradient steps on the cross entropy; classes count as often as they occur.

    With one class only, or no texts, every text gets that class's score (or 1/2).
    """
    rng = np.random.default_rng(SEED)
    k = HIDDEN
    p = {
        "w": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, k)), "wb": np.zeros(k),
        "v": rng.normal(0, k**-0.5, (k, k)), "u": rng.normal(0, k**-0.5, (k, k)),
        "q": rng.normal(0, k**-0.5, k), "c": np.zeros(k), "cb": np.zeros(1),
    }
    if len(set(y.tolist())) < 2:
        p["cb"][0] = 0.0 if not len(y) else 4.0 * (2 * int(y[0]) - 1)
        return GatedAttention(p, np.zeros(N_FEATURES), np.ones(N_FEATURES))
    x, owner = bags(texts)
    model = GatedAttention(p, x.mean(0), x.std(0) + 1e-3)
    adam = Adam(p, RATE)
    n = len(texts)
    for _ in range(ROUNDS):
        f = model.forward(x, owner, n)
        ds = (sigmoid(f["s"]) - y) / n
        dz = ds[:, None] * p["c"]
        att, h, a, g = f["att"], f["h"], f["a"], f["g"]
        datt = (dz[owner] * h).sum(1)
        de = att * (datt - np.bincount(owner, att * datt, minlength=n)[owner])
        da = de[:, None] * p["q"] * g * (1 - a * a)
        dg = de[:, None] * p["q"] * a * g * (1 - g)
        dh = att[:, None] * dz[owner] + da @ p["v"].T + dg @ p["u"].T
        dpre = dh * (1 - h * h)
        grads = {
            "w": f["x"].T @ dpre, "wb": dpre.sum(0), "v": h.T @ da, "u": h.T @ dg,
            "q": (a * g).T @ de, "c": f["z"].T @ ds, "cb": np.array([ds.sum()]),
        }
        for name in ("w", "v", "u", "q", "c"):
            grads[name] += L2 * p[name]
        adam.step(grads)
    return model


def score(df: DataFrame, model: GatedAttention, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """``keys`` of every row with ``score``, number of passages and the weightiest one.

    Null and empty texts are scored by one empty passage. Whole texts are read.
    """
    kinds = dict(df.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        scores, count, start = model.score(utf8(batch.column(len(keys))))
        out = {k: batch.column(i) for i, k in enumerate(keys)}
        return out | {"score": scores, "n_passages": count.astype(np.int64), "top_passage_word": start.astype(np.int64)}

    schema = [*(f"`{k}` {kinds[k]}" for k in keys), "score double, n_passages bigint, top_passage_word bigint"]
    return map_batches(df.select(*keys, text), run, ", ".join(schema))


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality") -> GatedAttention:
    """A model fitted to a bounded sample (see :mod:`training`) of the labelled rows."""
    texts, y = labelled_sample(docs, labels, label, PER_CLASS)
    return fit([t.encode() for t in texts], y)
