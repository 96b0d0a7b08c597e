"""Source divergence equals a brute-force reading of the rules: nulls, copies, a lang without kept terms, one source."""

import random
import re
from collections import Counter

from counterpoise.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, top=divergence.TOP_TERMS):
    rows = [("" if t is None else t, "" if l is None else l, "" if s is None else s) for t, l, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(l, s, TERM.findall(t.translate(lower))) for t, l, s in rows]
    out = set()
    for lang in {l for l, _, _ in docs}:
        df = Counter(w for l, _, ws in docs if l == lang for w in set(ws))
        kept = sorted(w for w, c in df.items() if c >= divergence.MIN_DOCS)
        v = len(kept)
        sources = sorted({s for l, s, _ in docs if l == lang})
        counts = {s: Counter(w for l, s2, ws in docs if l == lang and s2 == s for w in ws if df[w] >= 3) for s in sources}
        whole = Counter(w for l, _, ws in docs if l == lang for w in ws if df[w] >= 3)

        def p(c, w):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + v)

        for s in sources:
            pair = [(o, sum((p(counts[s], w) - p(counts[o], w)) ** 2 // p(counts[o], w) for w in kept)) for o in sources if o != s]
            term = [(w, (p(counts[s], w) - p(whole, w)) ** 2 // p(whole, w)) for w in kept if counts[s][w] > 0 and p(counts[s], w) > p(whole, w)]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda t: (-t[1], t[0].encode()))
                for rank, (item, value) in enumerate(items[:limit], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def rows():
    rnd = random.Random(5)
    vocab = ["alpha", "Beta", "gamma", "Ünïcode", "x1y", "delta", "eps", "zeta", "eta", "the"]
    out = []
    for _ in range(300):
        text = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 12)))
        out.append((text, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", None])))
    copy = ("alpha beta beta gamma 42 the", "en", "s1")
    out += [copy] * 40 + [(None, "en", "s9"), ("", "fr", "a"), ("nothing shared", "fr", "b"), ("only", "it", "one")]
    return out


def test_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(t, l, s, 7) for t, l, s in data], "text string, lang string, source string, part int")
    got = {tuple(r) for r in divergence.audit(df).collect()}
    assert got == brute(data)
    assert any(r[2] == "term" for r in got)
    assert ("fr", "a", "pair", "b", 0, 1) in got


def test_term_ranks_are_cut(spark):
    data = rows()
    df = spark.createDataFrame(data, "text string, lang string, source string")
    got = {tuple(r) for r in divergence.audit(df, top_terms=2).collect()}
    assert got == brute(data, top=2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).count() == 0


def test_more_copies_and_groups_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    data = rows()
    df = spark.createDataFrame(data, "text string, lang string, source string")
    assert {tuple(r) for r in divergence.audit(df).collect()} == brute(data)


def test_sums_and_meetings_do_not_depend_on_how_many_rows_are_held(monkeypatch):
    import pyarrow as pa

    one, two = {"source": "a", "m": 1}, {"source": "b", "m": 3}
    texts = pa.RecordBatch.from_pydict({"lang": ["en", "en", "de"], "text": [b"x Y x", b"y", b"x"], "sources": [[one, two], [one], [two]]})
    terms = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "sources": [["a", "b", "c"], ["b", "a"]], "counts": [[1, 1, 2], [4, 5]]})

    def summed():
        out, df, met = Counter(), Counter(), Counter()
        for b in divergence._tally(iter([texts])):
            for r in b.to_pylist():
                df[r["lang"], r["term"]] += r["df"]
                out.update({(r["lang"], r["term"], s): c for s, c in zip(r["sources"], r["counts"])})
        for b in divergence._meetings(iter([terms])):
            for *key, n in zip(*(c.to_pylist() for c in b.columns)):
                met[tuple(key)] += n
        return out, df, met

    wanted = (
        {("en", b"x", "a"): 2, ("en", b"x", "b"): 6, ("en", b"y", "a"): 2, ("en", b"y", "b"): 3, ("de", b"x", "b"): 3},
        {("en", b"x"): 4, ("en", b"y"): 5, ("de", b"x"): 3},
        {("en", "a", "b", 1, 1): 1, ("en", "a", "c", 1, 2): 1, ("en", "b", "c", 1, 2): 1, ("de", "b", "a", 4, 5): 1},
    )
    assert summed() == wanted
    for name in ("HELD_TEXTS", "PAIRS_AT_ONCE"):
        monkeypatch.setattr(divergence, name, 1)
        assert summed() == wanted
