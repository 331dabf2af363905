"""Chat trees, vectors, classifiers and the pipeline."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import connect, difference
from tests.llm.helpers import awkward_rows, documents, prose
from tideline.llm import attention, caps, chat, compression, toxicity, training
from tideline.llm.common import filter_batches
from tideline.llm.components import components

TREE = "tree bigint, node bigint, parent bigint, role string, text string, score double, name string, n bigint"


def test_best_paths_of_a_tree(spark):
    rows = [
        (1, 1, None, "user", "hi <|im_end|>", 0.0), (1, 2, 1, "assistant", "a <\\|x", 1.0), (1, 3, 1, "assistant", "b", 3.0),
        (1, 4, 2, "user", None, 9.0), (1, 5, 3, None, "", 1.0), (None, 1, 77, "assistant", "lost", None),
        (2, 1, 2, "user", "circle", 1.0), (2, 2, 1, "user", "circle", 1.0), (1, 3, 1, "assistant", "z", 3.0),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TREE)
    made = chat.conversations(df, "tree", "node", "parent", score="score", best=None)
    got = made.select("tree", "leaf", "rank", "n_turns", "formatted", "loss_spans", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    found = {(r.tree, r.leaf): r for r in got}
    assert {k: r["rank"] for k, r in found.items()} == {(1, "4"): 1, (1, "5"): 2, (None, "1"): 1}
    first = found[(1, "4")]
    assert [tuple(t) for t in first.turns] == [("user", "hi <|im_end|>"), ("assistant", "a <\\|x"), ("user", "")]
    assert first.loss == "a <\\|x" and first.formatted.count("<|im_end|>") == 3
    assert found[(1, "5")].loss == "b" and found[(None, "1")].loss == "lost"
    assert chat.conversations(df, "tree", "node", "parent", score="score").count() == 2
    assert chat.conversations(df.limit(0), "tree", "node", "parent").collect() == []


def test_escapes_can_be_undone(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("<|\\%0A\nx") for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    kept = df.select("t", chat.unescaped(chat.escaped(F.col("t"))).alias("a"), chat.role_unescaped(chat.role_escaped(F.col("t"))).alias("b"), chat.escaped(F.col("t")).alias("e"))
    for r in kept.collect():
        assert r.t == r.a == r.b and "<|" not in r.e


def test_chat_and_vectors_match_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name in ("op1_chat_paths", "op7_cap_filters"):
        assert difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir) is None


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for c in range(6):
        centre = rng.normal(size=64)
        for spread in (0.0, 1e-4, 0.03, 0.05, 0.2):
            for _ in range(6):
                v = centre + spread * np.linalg.norm(centre) * rng.normal(size=64) / 8
                rows.append((at, [float(x) for x in np.float32(v * rng.choice([0.01, 1, 50]))], c % 2))
                at += 1
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [], 1), (904, [1.0, None], 1), (None, [1.0, 2.0], 1), (905, rows[0][1], None), (906, [1.0, 2.0, 3.0], 0), rows[3]]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id bigint, embedding array<float>, label int, dim int")
    got = caps.near_vectors(df).collect()
    assert len(got) == len(rows) + len(odd)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    comp = np.arange(len(rows))
    while (new := np.array([comp[n].min() for n in near])).tolist() != comp.tolist():
        comp = new
    by_id = {r.vec_id: r for r in got}
    missed = sum(abs(int(n.sum()) - 1 - by_id[i].n_links) for i, n in enumerate(near))
    assert missed <= 0.005 * near.sum()
    assert sum(by_id[i].component_id != comp[i] for i in range(len(rows))) <= 1
    assert all(by_id[i].n_links == 0 and by_id[i].kept for i in (900, 901, 902, 903, 904, 905, 906, None))
    assert caps.near_vectors(df.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7), (None, 3), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(9)} == {100} and got[201] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def toxic_corpus(n):
    rows = []
    for i in range(n):
        text = prose(i, 60 + i % 200)
        if i % 3 == 0:
            words = text.split()
            words[len(words) // 2] = ("vilegrub", "vilegrubs", "snarkpit")[i % 9 // 3]
            text = " ".join(words)
        rows.append((i, text, int(i % 3 == 0)))
    return rows


def test_noisy_or_finds_the_offending_sentence(spark):
    rows = toxic_corpus(600)
    docs = documents(spark, [r[:2] for r in rows] + [(9000, None), (9001, ""), (None, "vilegrub"), (9002, rows[1][1])])
    labels = spark.createDataFrame([(r[0], r[2], None) for r in rows[:450]] + [(None, 1, 1), (3, None, 1)], "doc_id bigint, toxic int, quality int")
    model = toxicity.trained(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(scores[i] >= 0.5) == bool(y) for i, _, y in rows[450:]]
    assert sum(held) / len(held) > 0.97
    assert 0 <= scores[9000] == scores[9001] < 0.5
    spots = toxicity.locate(docs, model).collect()
    assert spots and all(("vilegrub" in r.sentence) or ("snarkpit" in r.sentence) for r in spots)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert 9000 in kept and 450 not in kept and 451 in kept
    empty = documents(spark, [])
    assert toxicity.score(empty, toxicity.trained(empty, labels)).collect() == []


def test_attention_scores_held_out_texts(spark):
    rows = []
    for i in range(400):
        words = prose(i, 150).split()
        if i % 4 == 0:
            words[60:100] = [w + "##$" for w in words[60:100]]
        rows.append((i, " ".join(words)))
    docs = documents(spark, rows + [(9000, None), (9001, ""), *awkward_rows()[8:]])
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)], "doc_id bigint, quality int")
    model = attention.trained(docs, labels)
    got = {r.doc_id: r for r in attention.score(docs, model).collect()}
    right = [(got[i].score >= 0.7) == (i % 4 > 0) for i in range(300, 400)]
    assert sum(right) / len(right) > 0.97
    assert got[9000].score == got[9001].score and 0 <= got[9000].score <= 1
    assert attention.score(documents(spark, []), model).collect() == []


def test_sample_is_bounded_and_reproducible(spark):
    docs = documents(spark, [(i, "w" * 10) for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, toxic int")
    texts, y = training.labelled_sample(docs, labels, "toxic", per_class=10)
    assert Counter(y.tolist()) == {0: 10, 1: 10}
    assert len(training.labelled_sample(docs, labels, "toxic", max_bytes=75)[0]) == 7


def test_sample_passes_over_texts_that_do_not_fit(spark):
    rows = [(i, "w" * (700 if i < 10 else 10)) for i in range(50)]
    docs = documents(spark, rows + rows[20:] + rows[20:])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, toxic int")
    texts, y = training.labelled_sample(docs, labels, "toxic", max_bytes=600)
    assert sorted(map(len, texts)) == [10] * 40
    assert training.labelled_sample(docs, labels, "toxic", max_bytes=5)[0] == []
    assert training.labelled_sample(documents(spark, []), labels, "toxic")[0] == []


def test_filters_keep_all_columns_and_long_texts(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "x" * 9_000_000, "b" * 3, *("a" * i for i in range(50))])]
    docs = documents(spark, rows)
    kept = filter_batches(docs, "text", lambda texts: [t is not None and len(t) % 3 == 0 for t in texts], raw=True)
    assert kept.columns == docs.columns
    want = [i for i, t in rows if t is not None and len(t) % 3 == 0]
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == want


def test_turns_with_columns_named_as_the_trees(spark):
    rows = [(1, 0, "user", "a", 9, 8), (1, 1, "assistant", "b", 9, 8), (2, 0, "user", None, 9, 8)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, node int, parent int")
    made = chat.conversations(chat.from_turns(df), "conv_id", "node", "parent").collect()
    assert sorted((r.tree, r.n_turns) for r in made) == [(1, 2), (2, 1)]
    other = chat.from_turns(df, node="at", parent="above")
    assert {(r.node, r.parent) for r in other.collect()} == {(9, 8)}


def _alike(a, b):
    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    x, y = grams(a), grams(b)
    return bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)


def test_near_copies_are_judged_row_by_row(spark, sf_dir):
    """Against a plain loop over all pairs, with null ids and ids of several texts."""
    one, two, other = prose(1, 200), prose(2, 150), prose(3, 90)
    near = one.replace("bana", "bano", 1)
    rows = [
        (4, one), (4, two), (4, near), (5, two), (None, one), (None, other), (None, other), (None, None),
        (6, ""), (6, None), (2, other), (9, prose(8, 20_000)), (9, prose(8, 20_000)), *awkward_rows(),
    ]
    got = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), sf_dir).collect()
    different = list(dict.fromkeys(rows))
    group = list(range(len(different)))
    for i in range(len(different)):
        for j in range(i):
            if _alike(different[i][1], different[j][1]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    want = []
    for g in set(group):
        members = [different[i] for i in range(len(group)) if group[i] == g]
        want.append(min((m[0] is None, m[0] or 0) for m in members))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(want)
    again = corpus_pipeline.drop_near_copies(spark, documents(spark, rows[::-1]).repartition(7), sf_dir).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_later_stages_of_the_pipeline_on_awkward_rows(spark, sf_dir):
    docs = documents(spark, awkward_rows())
    fitting = corpus_pipeline.drop_low_quality(spark, docs, sf_dir)
    assert fitting.columns == docs.columns
    want = Counter(r.doc_id for r in compression.compression_rules(docs).where("kept").collect())
    assert Counter(r.doc_id for r in fitting.collect()) == want and want[2] == 2
    cleaned = corpus_pipeline.drop_repeats(spark, docs, sf_dir).collect()
    assert all(r.text is None or r.text and r.n_chars == len(r.text) for r in cleaned)
    assert {1, None, 7, 8} <= {r.doc_id for r in cleaned}
    pieces = corpus_pipeline.pack_sequences(spark, docs, sf_dir).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(i for i, _ in awkward_rows())


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near-duplicates", "repeated spans", "packing"]
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf_dir)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
