"""Collocations equal a brute-force reading of the rules, with nulls, repeated rows, ties and clashing columns."""

import random
import re
from collections import Counter

from counterpoise.llm import phrases


def brute(rows, top=phrases.TOP):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 5):
                    if i + k <= len(w):
                        f[lang, " ".join(w[i : i + k])] += 1
    cands = {(lang, p): a for (lang, p), a in f.items() if 2 <= len(p.split(" ")) <= 4 and a >= 30}
    out = {}
    for (lang, p), a in cands.items():
        w = p.split(" ")
        covered = any(
            lang2 == lang and len(q.split(" ")) > len(w) and 100 * b >= 80 * a
            and any(q.split(" ")[i : i + len(w)] == w for i in range(len(q.split(" ")) - len(w) + 1))
            for (lang2, q), b in cands.items()
        )
        if covered:
            continue
        best = min(((2000000 * a // (f[lang, " ".join(w[:k])] + f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))))
        k = best[1]
        out.setdefault(lang, []).append((best[0], a, p, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    result = set()
    for lang, items in out.items():
        items.sort(key=lambda t: (-t[0], -t[1], t[2].encode()))
        for rank, (score, a, p, l, r) in enumerate(items[:top], 1):
            result.add((lang, rank, p, a, l, r, n[lang], score))
    return result


def texts():
    rnd = random.Random(3)
    vocab = ["new", "york", "city", "the", "of", "Über", "hot", "dog", "ice", "cream", "a", "b"]
    rows = []
    for i in range(400):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))]
        text = " ".join(words)
        if i % 7 == 0:
            text += ". New York City, hot dog;\tICE cream"
        rows.append((text, rnd.choice(["en", "de", None])))
    rows += [(None, "en"), ("", None), ("new york " * 50, "en")] * 2
    return rows


def test_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(t, l, 1, 2) for t, l in rows], "text string, lang string, rank int, phrase int")
    got = {tuple(r) for r in phrases.mine(df).collect()}
    assert got == brute(rows)
    assert got


def test_top_limits_each_lang(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "text string, lang string")
    got = phrases.mine(df, top=3).collect()
    assert {tuple(r) for r in got} == brute(rows, top=3)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert phrases.mine(df).count() == 0


def test_numbered_and_joined_words_count_the_same_paths(spark):
    df = spark.createDataFrame(texts(), "text string, lang string")
    numbered, joined = (phrases.count_paths(df, most_words=n) for n in (phrases.BROADCAST_PATHS, 0))
    for one, other in zip(numbered, joined):
        rows = [tuple(r) for r in one.collect()]
        assert sorted(rows) == sorted(tuple(r) for r in other.collect())
        assert rows


def test_words_are_split_like_the_rules():
    assert phrases._tokens("New\x0bYork,É a.\x1cb\tC".encode()) == [b"new", b".", b"york", b".", "É".encode(), b"a", b".", b"\x1cb", b"c"]
    assert phrases._tokens(None) == []


def test_a_path_is_made_of_its_word_numbers():
    import numpy as np

    hi, lo, at = phrases._path_keys(np.array([5, 1, 2, 3, 0, 7, 8, 9, 2**21 - 1]), 4)
    assert list(at) == [0, 5]
    assert [(x >> 21, x & (2**21 - 1)) for x in [*hi, *lo]] == [(5, 1), (7, 8), (2, 3), (9, 2**21 - 1)]
    assert list(phrases._path_keys(np.array([2, 0, 3]), 2)[0]) == []


def test_paths_of_all_segments_are_whole(spark, monkeypatch):
    """Blocks of several scan tasks and segments give each path once, with its whole weight; rare ones are left out."""
    import numpy as np

    monkeypatch.setattr(phrases, "MIN_COUNT", 3)
    rng = np.random.default_rng(4)
    bodies = [[*rng.integers(0, 6, rng.integers(0, 40)).tolist(), 0] for _ in range(60)] + [[1, 2, 3, 4] * 400 + [0]]
    numbered = spark.createDataFrame([(bytearray(np.array(b, np.int32).tobytes()),) for b in bodies], "numbers binary").repartition(5)
    for k in (2, 4):
        want = Counter(tuple(b[i : i + k]) for b in bodies for i in range(len(b) - k + 1) if all(b[i : i + k]))
        before = spark.sparkContext.broadcast((np.full(1 << 13, 255, np.uint8), 16))
        for segments in (1, 7):
            rows = phrases._level(numbered, k, before, segments).collect()
            got = {tuple(x >> 21 * (n - 1 - i) & (1 << 21) - 1 for x, n in zip(r[:-1], [k] if k < 4 else [2, 2]) for i in range(n)): r["f"] for r in rows}
            assert len(got) == len(rows)
            assert got == {p: f for p, f in want.items() if f >= phrases.MIN_COUNT}
