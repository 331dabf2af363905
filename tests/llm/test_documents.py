"""Operators on documents: brute force, round trips and awkward input."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from tests.llm.helpers import awkward_rows, documents, prose
from tideline.llm import compression, licenses, packing, spans, superminhash, tokens, transducer
from tideline.llm.common import map_batches, tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def awkward(spark):
    return documents(spark, awkward_rows()).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def test_compression_counts_equal_plain_loops(awkward):
    got = Counter(tuple(r)[:7] for r in compression.compression_rules(awkward).collect())
    want = Counter()
    for i, text in awkward_rows():
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want[(i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)] += 1
    assert got == want


def test_compression_bands():
    packer = zstandard.ZstdCompressor(level=3)
    rng = random.Random(1)
    noise = b" ".join(base64.b64encode(rng.randbytes(30)) for _ in range(600))
    assert compression.judged(prose(3, 400).encode(), packer)[-1]
    assert not compression.judged(noise, packer)[-1]
    half = prose(3, 3000) + " " + " ".join(f"the same words come {i % 7}" for i in range(3000))
    assert not compression.judged(half.encode(), packer)[-1]
    assert [n for n, _ in compression.chunk_ratios(b"x" * 5000, packer)] == [2048, 2952]
    assert [n for n, _ in compression.chunk_ratios(b"x" * 5200, packer)] == [2048, 2048, 1104]


def brute_components(rows):
    sets = []
    for _, text in rows:
        words = WORD.findall(lower(text or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return Counter((doc, len(sets[i]), least[find(i)] if least[find(i)] is not None else doc) for i, (doc, _) in enumerate(rows))


def near_copies(seed):
    """A hot group of copies edited at random places, and documents that share a passage."""
    rng, rows = random.Random(seed), awkward_rows()
    base, passage = prose(50, 150).split(), prose(51, 60)
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = f"edit{rng.randint(0, 9)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, prose(60 + i, 40) + " " + passage) for i in range(20)]
    rng.shuffle(rows)
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_copies(3)
    got = superminhash.near_duplicates(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept for r in got if r.doc_id is None)


def test_operators_empty_what_others_have_kept():
    """A worker that has packed texts does not hold their words while it does other work."""
    encoder = tokens.encoder(tokenizer_file("word_bpe_49k.json"))

    class Caught:
        dtypes = [("id", "bigint"), ("doc_id", "bigint"), ("text", "string")]

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run

    def works(make):
        frame = Caught()
        make(frame)
        encoder.encode(b"some words that stay")
        assert encoder.young
        list(frame.run(iter([])))
        return not encoder.young and not encoder.old

    assert works(lambda df: superminhash.signed(df, "doc_id", "text"))
    assert works(lambda df: spans.span_hashes(df, 3, 8))
    assert works(lambda df: map_batches(df, lambda batch: None, "doc_id bigint"))
    assert encoder.encode(b"some words") == encoder.encode(b"some words")


def test_near_duplicates_of_nothing(nothing):
    assert superminhash.near_duplicates(nothing).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = np.unique(pool[:800]), np.unique(pool[200:])
    equal = (superminhash.signatures([a])[0] == superminhash.signatures([b])[0]).mean()
    assert abs(equal - 0.6) < 0.15
    tiny = superminhash.signatures([pool[:1]])[0]
    assert sorted(tiny >> 24) == list(range(superminhash.POSITIONS))  # each position once


def test_repeated_spans(spark):
    passage = " ".join(f"Passage number {w} has words of its own here." for w in ("one", "two", "three", "four", "five"))
    rows = [(2, "Start of two. " + passage + " End of two."), (1, "First of one. " + passage), (3, "Nothing in common with others, at all."), (4, None), (5, ""), (None, passage + " " + passage)]
    got = {r.doc_id: r for r in spans.drop_repeated_spans(documents(spark, rows)).collect()}
    assert got[1].text == rows[1][1] and got[3].text == rows[2][1]
    assert got[2].text == "Start of two. End of two." or got[2].text == "Start of two.  End of two."
    assert got[2].n_removed == 5 and got[4].text is None and got[5].text == ""
    assert got[None].text.count("Passage number one") == 1
    assert "n_removed" in got[1].asDict() and got[1].id == "z" and got[1].lang == "en"


def test_repeated_spans_on_awkward_rows(awkward, nothing):
    out = spans.drop_repeated_spans(awkward)
    assert out.count() == len(awkward_rows()) and out.columns[:8] == awkward.columns
    assert spans.drop_repeated_spans(nothing).collect() == []
    again = spans.drop_repeated_spans(out)  # its own columns are there by now
    assert again.columns[-2:] == ["n_sentences_", "n_removed_"]


def packed_ids(rows):
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]


def test_packing_puts_each_id_in_one_piece(awkward):
    got = packing.pack(awkward, tokenizer_file("word_bpe_49k.json"), with_ids=True).collect()
    want = Counter((i, len(ids)) for (i, _), ids in zip(awkward_rows(), packed_ids(awkward_rows())))
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(n * k for (_, n), k in want.items())
    ids = {(i, len(x)): x for (i, _), x in zip(awkward_rows(), packed_ids(awkward_rows()))}
    for r in got:
        part = ids[(r.doc_id, r.doc_tokens)][r.start : r.start + r.length]
        assert part.tolist() == r.ids and zlib.crc32(part.tobytes()) == r.ids_crc32
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in rows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0


@pytest.mark.parametrize("seed", range(6))
def test_packer_keeps_every_limit(seed):
    rng = random.Random(seed)
    limits = packing.Limits(64, rng.choice([3, 8]), rng.choice([20, 64]))
    packer, total = packing.Packer(limits, 4), 0
    for i in range(300):
        n = rng.choice([1, 2, 5, 30, 64, 200])
        total += n
        packer.add(packing.Piece(i, 0, n, rng.randint(0, n)))
    packer.finish()
    assert sum(p.length for s in packer.closed for p in s) == total
    for s in packer.closed:
        size = sum(p.length for p in s)
        assert size & (size - 1) == 0 and size <= 64 and len(s) <= limits.segments
        assert sum(p.loss for p in s) <= limits.loss


def test_empty_table_packs_to_nothing(nothing):
    assert packing.pack(nothing, tokenizer_file("word_bpe_49k.json")).collect() == []


TEXTS = ["", " ", "\n\n  a", "it's we'll 'tis", "<|endoftext|>", "x<|endoftext|> y", "　 é", "🙂 x\x1c\x1dy z\x85 q", "a" * 3000, "ab" * 900, "!" * 700, " " * 900 + "x", "0123456789" * 80]


def test_streaming_codec_equals_the_library():
    path = tokenizer_file("byte_bpe_50k.json")
    codec, tok = transducer.codec(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(" \n\tabcdeß'st!?.01|<>🙂") for _ in range(300)) for _ in range(60)]
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        parts = list(codec.encode(t))
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == ids
        assert "".join(codec.decode(parts)) == tok.decode(ids, skip_special_tokens=False)
    broken = [codec.merges.ids[b"\xe2"], codec.merges.ids[b"\x82"], codec.merges.ids[b"x"]]
    assert "".join(codec.decode([np.array([i], "<u4").tobytes() for i in broken])) == "�x"


def test_lookahead_suffices_for_random_merges():
    rng = random.Random(2)
    for _ in range(150):
        tokens, merges = {bytes([b]): i for i, b in enumerate(b"abc")}, []
        for _ in range(rng.randint(1, 14)):
            a, b = rng.choice(list(tokens)), rng.choice(list(tokens))
            if a + b not in tokens and len(a + b) < 9:
                tokens[a + b] = len(tokens)
                merges.append((a, b))
        m = transducer.Merges(tokens, merges)
        for _ in range(20):
            s = bytes(rng.choice(b"aabbc") for _ in range(rng.randint(0, 120)))
            streamed = [i for part in m.stream(s[j : j + 3] for j in range(0, len(s), 3)) for i in part]
            assert streamed == m.encode(s)


def test_round_trip_of_awkward_rows(awkward, nothing):
    path = tokenizer_file("byte_bpe_50k.json")
    got = Counter(tuple(r) for r in transducer.round_trip(awkward, path).collect())
    tok, want = Tokenizer.from_file(path), Counter()
    for i, t in awkward_rows():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4")
        want[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want and transducer.round_trip(nothing, path).collect() == []
    back = transducer.decode_column(transducer.encode_column(awkward, path), path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in awkward_rows())


def test_license_places_and_labels(spark, nothing):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 100)
    changed = mit.replace("free of charge", "entirely free of all charge").replace("publish,", "")
    rows = [
        (1, "Text. Released under the MIT License. More: GNU general-public LICENSE, mit license"), (2, changed),
        (3, "Licensed under CC BY-NC 4.0."), (4, None), (5, ""), (6, prose(1, 300)), (None, "apache license"), (6, "All rights reserved."),
    ]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text in rows:
        words = pattern.findall(lower(text or ""))
        places = [(k, label) for label, p in licenses.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[(i, len(words))]
        starts = [k for k, _ in places]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
    by_id = {(r.doc_id, r.labels) for r in got.values()}
    assert {(2, "mit"), (3, "cc-by,cc-by-nc"), (6, "all-rights-reserved"), (6, ""), (None, "apache")} <= by_id
    assert licenses.scan(nothing).collect() == []


def test_common_words_by_bits():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        assert licenses.common_words(a, b) == table[-1][-1]


def test_batches_cut_by_their_texts(spark):
    """A call of a batch function sees about PIECE_BYTES of text, and every row once."""
    rows = [(i, "x" * 3_000_000 if i % 4 else None) for i in range(12)]
    df = documents(spark, rows).select("doc_id", "text").coalesce(1)
    got = map_batches(df, lambda b: {"ids": [b.column(0).to_pylist()]}, "ids array<bigint>", "text").collect()
    assert sorted(i for r in got for i in r.ids) == list(range(12))
    assert max(sum(1 for i in r.ids if i % 4) for r in got) <= 2


def test_license_runs_only_of_template_words(spark, monkeypatch):
    made = []
    real = licenses.map_batches

    def spy(df, fn, schema, *text):
        out = real(df, fn, schema, *text)
        if schema.startswith("row_key"):
            made.append(out)
        return out

    monkeypatch.setattr(licenses, "map_batches", spy)
    rows = [(1, "zzz all rights reserved qqq the software vvv"), (2, "zzz qqq vvv www"), (3, "the"), (4, None)]
    found = licenses.scan(documents(spark, rows)).collect()
    assert {r.doc_id: r.labels for r in found} == {1: "all-rights-reserved", 2: "", 3: "", 4: ""}
    assert [r.pos for r in made[0].collect()] == [1]


def test_capitals_and_marks_of_words_known():
    """Ids as by the library, which is not asked again for known words in capitals or with marks."""
    path = tokenizer_file("word_bpe_49k.json")
    enc, asked = tokens.WordEncoder(path), []
    library = enc.tokenizer

    class Spy:
        def encode(self, text, **kw):
            asked.append(text)
            return library.encode(text, **kw)

        def encode_batch(self, texts, **kw):
            asked.extend(texts)
            return library.encode_batch(texts, **kw)

    enc.tokenizer = Spy()
    for t in (", . )", "élan été", "Élan ÉTÉ élan, (élan) Élan. x<|endoftext|> É) 5) É5."):
        want = np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert enc.encode(t.encode()) == want
    asked.clear()
    t = "Élan ÉTÉ été. Élan) élan"
    assert enc.encode(t.encode()) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert not asked
