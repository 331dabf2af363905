"""Repair, main text and divergence against brute force and small pages."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict
import re

import pytest

from tideline.llm import divergence, html, repair
from tests.llm.helpers import awkward_rows, documents, prose

# -- repair --------------------------------------------------------------------

GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(codes):
    """(cost, audit) by dynamic programming over whole labels, from the front."""
    best = {repair.NOTHING: (0, "")}

    def inserted(labels):
        for _ in range(4):
            for s, (cost, audit) in list(labels.items()):
                t, label = repair.NEXT[s], (cost + 5, audit + "I")
                if t not in labels or label < labels[t]:
                    labels[t] = label
        return labels

    best = inserted(best)
    for c in codes:
        after = {}
        for s, (cost, audit) in best.items():
            edits = [("D", s, 2)]
            if c != "d":
                more = 5 if c.isupper() else 0
                own = {"s": 1, "u": 2, "a": 3}.get(c.lower())
                if own == 1 and s == 0 or own in (2, 3) and own == repair.NEXT[s]:
                    edits.append(("K", own, more))
                if own != repair.NEXT[s]:
                    edits.append(("R", repair.NEXT[s], 1 + more))
            for e, t, price in edits:
                label = (cost + price, audit + e)
                if t not in after or label < after[t]:
                    after[t] = label
        best = inserted(after)
    return min(best[s] for s in repair.ENDS if s in best)


def written_roles(codes, audit):
    rows, roles = repair.steps(audit)
    return "".join((role or codes[row])[0].lower() for row, role in zip(rows, roles))


def test_search_is_cheapest_on_all_short_conversations():
    for n in range(6):
        for codes in itertools.product("suxdUA", repeat=n):
            codes = "".join(codes)
            cost, audit = repair.search(codes)
            assert (cost, audit) == cheapest(codes), codes
            assert GOOD.fullmatch(written_roles(codes, audit)), codes


def test_segments_give_what_one_search_gives():
    rng = random.Random(4)
    for _ in range(60):
        codes = "".join(rng.choice("suaxdSUAX") for _ in range(rng.randint(1, 40)))
        size = rng.randint(1, 9)
        parts = [codes[i : i + size] for i in range(0, len(codes), size)]
        assert repair.joined(repair.segment_table(p, i == 0) for i, p in enumerate(parts)) == repair.search(codes)


TURNS = "conv_id bigint, turn bigint, role string, text string, fault string, row string, alive boolean, name string"


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, "f", "r", True, "n") for r in rows], TURNS)
    found = repair.faults(df, "conv_id", "turn", "role", "text")
    out = repair.with_digest(found, repair.verdicts(found, segment_rows=3))
    return {r["conv"]: r.asDict() for r in out.collect()}


def test_repair_of_awkward_conversations(spark):
    long = "word " * 200_000 + "end."
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."),
        (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 4, "assistant", "cut off"),
        (3, None, None, None), (3, 1, "", ""), (4, 0, "system", "Be."), (4, 1, "assistant", long),
        (None, 0, "user", "A."), (None, 1, "assistant", "B."),
    ]
    rows += [(5, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(400)]
    got = repaired(spark, rows)
    assert set(got) == {1, 2, 3, 4, 5, None}
    assert (got[1]["cost"], got[1]["audit"]) == (0, "KK")
    assert got[1]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    assert (got[2]["duplicate"], got[2]["truncated"], got[2]["gaps"], got[2]["illegal"]) == (1, 1, 3, 1)
    assert (got[3]["blank"], got[3]["audit"], got[3]["cost"], got[3]["gaps"]) == (2, "DD", 4, 0)
    assert got[3]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[4]["cost"], got[4]["audit"]) == cheapest("sa")
    assert (got[5]["cost"], got[5]["audit"]) == (0, "K" * 400)
    assert got[None]["audit"] == "KK"


def test_repair_of_no_rows(spark):
    assert repaired(spark, []) == {}


# -- main text -------------------------------------------------------------------

BODY = "<p>One, two, and three things that make a paragraph long enough.</p><p>Second one, also of some length, with words.</p>"
TEXT = "One, two, and three things that make a paragraph long enough.\nSecond one, also of some length, with words."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just words", "just words"),
        (f"<nav><ul><li><a href='/a'>A</a></li></ul></nav><article>{BODY}</article><footer>&copy; x</footer>", TEXT),
        (f"<div class=ad>Buy, buy, buy</div><div id=main>{BODY}</div><aside>Read more, please, now</aside>", TEXT),
        (f"<header>Site, name</header><main><h1>T &amp; U</h1>{BODY}</main><script>var a='</p>';</script>", "T & U\n" + TEXT),
        (f"<article>{BODY}<form>Name, mail <input></form><style>p{{}}</style><!-- note --></article>", TEXT),
        (f"<article>{BODY}</article><div class='comments'><p>I, for one, disagree with all of this, dear author.</p></div>", TEXT),
        (f"<div class='cookie-notice'><p>We use cookies, many of them, all day long.</p></div><article>{BODY}</article>", TEXT),
        ("<article><p>a &lt;b&gt;\n\n  c&nbsp;d<br>e <b>f</b>g</p></article>", "a <b> c d e fg"),
        ("<article><p>open<p>next</article>", "open\nnext"),
        ("<p title='a>b'>x</p>", "x"), ("<p title='never closed>x</p><p>y</p>", "x\ny"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_deep_and_long_pages():
    assert html.main_text("<div>" * 20_000 + "deep words" + "</div>" * 20_000) == "deep words"
    paragraph = "<p>" + "word, " * 200_000 + "end</p>"
    assert html.main_text(f"<article>{paragraph}</article>") == ("word, " * 200_000 + "end")


def test_every_page_whole(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", f"<article>{BODY}</article>", "t", "n")] * 2 + [(None, None, None, None, None)]
    got = sorted(map(tuple, html.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0)]
    assert html.extract(spark.createDataFrame([], schema)).count() == 0


# -- divergence --------------------------------------------------------------------

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows, top=200):
    """The rows of the audit by plain loops over (lang, source, text)."""
    docs = [(a or "", s or "", WORD.findall((t or "").translate(UPPER))) for a, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        in_docs, counts = Counter(), defaultdict(Counter)
        for _, source, words in (d for d in docs if d[0] == lang):
            in_docs.update(set(words))
            counts[source].update(words)
        kept = [t for t, n in in_docs.items() if n >= 3]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        whole = share(sum(counts.values(), Counter()))
        p = {s: share(c) for s, c in counts.items()}
        f = lambda x, y: (x - y) ** 2 // y
        for s in p:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in p if o != s]
            own = [(t, f(p[s][t], whole[t])) for t in kept if counts[s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def sourced(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n bigint, term string")


@pytest.mark.parametrize("shard_terms, block_sources", [(20_000, 256), (3, 2)])
def test_divergence(spark, shard_terms, block_sources):
    rng = random.Random(2)
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"]), prose(i, rng.randint(0, 60))) for i in range(80)]
    rows += [("en", "silent", None), ("en", "silent", "12 -- 34"), ("xx", "one", "Only Once"), ("en", "a", "Ünï Ünï ünï")] * 2
    rows += [("de", "long", prose(9, 30_000))]
    got = divergence.audit(sourced(spark, rows), shard_terms=shard_terms, block_sources=block_sources)
    assert sorted(map(tuple, got.collect())) == audited(rows)


def test_divergence_of_awkward_documents(spark):
    rows = awkward_rows()
    got = divergence.audit(documents(spark, rows))
    assert sorted(map(tuple, got.collect())) == audited([("en", "src", t) for _, t in rows])
    assert divergence.audit(sourced(spark, [])).count() == 0
