import random
import re

from pyspark.sql import functions as F

from counterpoise.llm import pii


def luhn(digits):
    return sum((lambda n: n - 9 if n > 9 else n)(int(c) * (2 if k % 2 else 1)) for k, c in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = lambda p: list(re.finditer(p, text))
    email = [m.span() for m in found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    ip = [m.span() for m in found(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(x) <= 255 for x in m[0].split("."))]
    card = [m.span() for m in found(r"[0-9]([\x20-]?[0-9])+") if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    phone = [m.span() for m in found(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(m[0])) <= 15]
    return [(k, a, b) for k, spans in zip(pii.KINDS, (email, ip, card, phone)) for a, b in spans]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    seen = 0
    for _ in range(8000):
        text = "".join(rng.choice(rng.choice(["ab@.-é ", "0123 .", "1.2+()-  0", "@.a", "4012 8888-1"])) for _ in range(rng.randrange(60)))
        want = brute(text)
        seen += len(want)
        assert pii.seeds(text) == want
    assert seen > 500


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000):
        pii.seeds(text)
        pii.candidates(text, [])


def corpus():
    """Mail addresses stand behind 'mail to'; some are written in a form that the base does not know."""
    rows = [(i, f"text {i} please mail to user{i}@host{i}.example.org for answers soon") for i in range(40)]
    rows += [(100 + i, f"text please mail to user{i}(at)host{i} for answers") for i in range(3)]
    rows += [(200 + i, f"word order{i}x stands anywhere else {i}") for i in range(30)]
    return rows


def test_context_finds_unseen_forms(spark):
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(corpus(), "doc_id int, text string")).collect()}
    assert all(len(got[i]["base"]) == 1 and not got[i]["added"] for i in range(40))
    for i in range(3):
        text = corpus()[40 + i][1]
        assert [text[s["a"] : s["b"]] for s in got[100 + i]["added"]] == [f"user{i}(at)host{i}"]
        assert [s["kind"] for s in got[100 + i]["added"]] == [0]
    assert not any(got[200 + i]["added"] for i in range(30))


def test_too_little_support_adds_nothing(spark):
    got = pii.find(spark.createDataFrame(corpus()[37:43], "doc_id int, text string"))
    assert got.where(F.size("added") > 0).count() == 0


def test_odd_rows(spark):
    long = "word " * 100_000 + "a.b@c.de"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, long, 3), (3, long, 3), (None, "10.0.0.1 and é +49 30 1234567", 4)], "doc_id int, text string, base int")
    got = pii.find(docs)
    assert got.columns == ["doc_id", "base", "base_1", "added"]
    rows = {r["base"]: r for r in got.withColumn("spans", pii.written("base_1")).collect()}
    assert got.count() == 5
    assert rows[1]["spans"] == rows[2]["spans"] == ""
    assert rows[3]["spans"] == "email:500000:500008"
    assert rows[4]["spans"] == "ip:0:8,phone:15:29"
    assert pii.find(docs.limit(0)).count() == 0
