import math
import re
from collections import Counter

import pytest

from counterpoise.llm import licenses

SCHEMA = "path string, text string"
MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."


def brute_own(files, min_cosine):
    """Best (cosine, licence) by path, from every line and whole licence file."""
    words = lambda t: [w.lower() for w in re.findall("[A-Za-z0-9]+", t or "")]
    df = Counter(w for _, t in files for w in set(words(t)))
    vocabulary = {w for _, body in licenses.TEMPLATES for w in words(body)}
    idf = lambda w: 1 + math.log((len(files) + 1) / ((df[w] if w in vocabulary else 0) + 1))
    vector = lambda t: {w: n * idf(w) for w, n in Counter(words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for path, text in files:
        if path is None:
            continue
        units = (text or "").split("\n") + ([text] if path.split("/")[-1] == "LICENSE" else [])
        for unit in units:
            v = vector(unit)
            for licence, body in licenses.TEMPLATES if v else ():
                t = vector(body)
                c = round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 9)
                if c >= min_cosine and (path not in out or (-c, licence) < out[path]):
                    out[path] = (-c, licence)
    return {p: (licence, -c) for p, (c, licence) in out.items()}


FILES = [
    ("LICENSE", "Some words first\n" + APACHE),
    ("a/x.txt", "nothing here"),
    ("a/b/LICENSE", MIT),
    ("a/b/c/d/y.txt", "deep file"),
    ("a/b/z.txt", f"own header\n{APACHE}\nmore"),
    ("ab/w.txt", "not below a"),
    ("a/b/e/LICENSE", "words that are no licence at all"),
    ("a/b/e/v.txt", None),
    ("a/b/e/u.txt", ""),
    ("a/half.txt", "the MIT License is under discussion in many other words of this line"),
]


def test_matches_are_brute_force(spark):
    files = FILES + [(f"more/{i}.txt", t) for i, t in enumerate(["All rights reserved", "rights", "MIT license mit LICENSE", "version 3 of the general public license, gnu", "CC BY-NC 4.0"])]
    df = spark.createDataFrame(files, SCHEMA)
    got = {r["path"]: (r["licence"], r["cosine"]) for r in licenses.matches(df, licenses.template_weights(df)).collect()}
    want = brute_own(files, licenses.MIN_COSINE)
    assert {p: x[0] for p, x in got.items()} == {p: x[0] for p, x in want.items()}
    assert all(got[p][1] == pytest.approx(want[p][1], abs=1e-8) for p in want)


def test_nearest_directory_above(spark):
    got = {r["path"]: (r["licence"], r["origin"], r["from_dir"]) for r in licenses.scan(spark.createDataFrame(FILES, SCHEMA)).collect()}
    assert got["a/b/z.txt"] == ("Apache-2.0", "own", None)
    assert got["a/b/c/d/y.txt"] == got["a/b/e/v.txt"] == got["a/b/e/u.txt"] == ("MIT", "inherited", "a/b")
    assert got["a/x.txt"] == got["ab/w.txt"] == ("Apache-2.0", "inherited", "")


def test_odd_rows(spark):
    files = spark.createDataFrame(
        [(None, MIT, 1), ("d/LICENSE", MIT, 2), ("d/LICENSE", MIT, 2), ("d/COPYING", APACHE, 3), ("d/long.txt", "word " * 200_000 + "\n" + APACHE, 4), ("e/x", None, 5)],
        "path string, text string, licence int",
    )
    got = licenses.scan(files)
    assert got.columns == ["path", "text", "licence", "licence_1", "cosine", "origin", "from_dir"]
    rows = [(r["path"], r["licence_1"], r["origin"]) for r in got.collect()]
    assert len(rows) == 6 and (None, None, "none") in rows and ("e/x", None, "none") in rows
    assert rows.count(("d/LICENSE", "MIT", "own")) == 2 and ("d/long.txt", "Apache-2.0", "own") in rows
    assert licenses.scan(files.limit(0)).count() == 0


def test_tie_goes_to_the_first_name(spark):
    both = (("B", "exactly these words"), ("A", "exactly these words"))
    files = spark.createDataFrame([("x", "exactly these words"), ("y", "other things")], SCHEMA)
    assert licenses.scan(files, templates=both).where("path = 'x'").first()["licence"] == "A"
