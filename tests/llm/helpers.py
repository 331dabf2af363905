"""Documents with the awkward cases that every operator has to take."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, cls bigint, id string"


def prose(seed, n_words):
    rng = random.Random(seed)
    words = [rng.choice("ba ke lo mi nu ra se to vi zu".split()) + rng.choice("na me ri st nd".split()) for _ in range(n_words)]
    for i in range(9, n_words, 10):
        words[i] += "."
    return " ".join(words)


def awkward_rows():
    """(doc_id, text): null id, null and empty text, blanks, a repeated row, copies, a long text."""
    long = prose(5, 30_000)
    base = prose(1, 120)
    return [
        (1, base), (2, base), (2, base), (3, base.replace("bana", "bano", 1)), (4, None), (5, ""), (6, " \n\t "),
        (7, "one"), (None, prose(2, 80)), (8, long), (9, "Ünïcode 🙂 " * 60), (10, "a b c d e f " * 40), (11, "x" * 5000),
    ]


def documents(spark, rows):
    """A table with columns whose names operators use themselves."""
    full = [(i, t, "en", "src", len(t or ""), 0.5, 7, "z") for i, t in rows]
    return spark.createDataFrame(full, DOCS)
