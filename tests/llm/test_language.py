import random

import pytest

from counterpoise.llm import language

TEXTS = {
    "en": "the thing that they were thinking with is there and this other weather either thought through",
    "de": "schon zwischen schwer und nicht der schatz auch sich heiß gezogen werden durch schule eigentlich",
    "fr": "les oiseaux étaient beaux quand nous avions mangé leur gâteau près de la rivière où chantait",
}


@pytest.fixture
def docs(spark):
    rows = [(i, f"{TEXTS[lang]} {TEXTS[lang][i % 30 : i % 30 + 40]} {i}", lang) for i in range(60) for lang in TEXTS]
    return spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")


def test_smallest_encoding_wins(spark, docs):
    model = language.fit(docs)
    unseen = spark.createDataFrame(
        [(1, "this weather thought", "de"), (2, "der schatz und schule", "fr"), (3, "les beaux oiseaux avions", "en")], "doc_id int, text string, lang string"
    )
    got = {r["doc_id"]: r["lang_pred"] for r in language.classify(unseen, model).collect()}
    assert got == {1: "en", 2: "de", 3: "fr"}


def test_odd_rows(spark, docs):
    model = language.fit(docs.unionByName(spark.createDataFrame([(None, None, "en"), (1, "", "xx"), (2, "x", None)], docs.schema)))
    assert sorted(model.dictionaries) == ["de", "en", "fr"]
    odd = spark.createDataFrame(
        [(1, None), (2, ""), (3, "12 !? 9"), (4, "the thing " * 50_000), (4, "the thing " * 50_000), (None, "the thing that they")], "doc_id int, text string"
    ).selectExpr("doc_id", "text", "'kept' as score")
    got = language.classify(odd, model)
    assert got.columns == ["doc_id", "text", "score", "lang_pred", "score_1", "rejected"]
    rows = got.collect()
    assert [r["lang_pred"] for r in rows] == ["und"] * 3 + ["en"] * 3
    assert [r["rejected"] for r in rows[:3]] == [True] * 3 and not rows[3]["rejected"]
    assert [r["score_1"] for r in rows[:3]] == [0.0] * 3 and all(0 <= r["score_1"] <= 1 for r in rows)
    assert rows[3]["score_1"] == rows[4]["score_1"]


def test_empty_tables(spark, docs):
    nothing = language.fit(docs.limit(0))
    assert nothing.dictionaries == {}
    assert {r["lang_pred"] for r in language.classify(docs, nothing).collect()} == {"und"}
    assert language.classify(docs.limit(0), language.fit(docs)).count() == 0


def test_tie_goes_to_the_first_name(spark):
    same = spark.createDataFrame([(k, "ein text ohne unterschied", lang) for k, lang in enumerate(("b", "a"))], "doc_id long, text string, lang string")
    row = language.classify(same.limit(1), language.fit(same)).first()
    assert row["lang_pred"] == "a" and row["score"] == 0.5


def test_pieces_hold_the_whole_text():
    for text in ("", "a", "word " * 1000, "x" * 5000, "é" * 3000):
        assert b"".join(language.pieces(text, 512)).decode() == language.normal(text)


def invented(alphabet, n_texts, n_words, seed):
    """Texts of words that are made of the syllables of an alphabet."""
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(alphabet, k=rng.randint(1, 3))) for _ in range(n_words)) for _ in range(n_texts)]


@pytest.mark.parametrize("learned", [("aa", "bb"), ("aa", "bb", "cc", "dd")])
def test_unknown_languages_and_junk_are_rejected(spark, learned):
    """A left-out language and junk with letters go, held-out texts of learned languages stay."""
    alphabets = {
        "aa": ["the", "ing", "and", "oun", "ly", "tion"],
        "bb": ["sch", "ein", "ung", "keit", "ver", "zu"],
        "cc": ["eau", "oux", "ment", "les", "que", "ait"],
        "dd": ["ado", "cion", "mente", "los", "per", "ez"],
        "zz": ["kiv", "jyy", "sto", "lla", "paa", "hun"],
    }
    labelled = [(t, lang) for k, lang in enumerate(learned) for t in invented(alphabets[lang], 320, 150, k)]
    model = language.fit(spark.createDataFrame(labelled, "text string, lang string"))
    rng = random.Random(9)
    junk = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=900)) for _ in range(40)]
    odd = [("junk", t) for t in junk] + [("zz", t) for t in invented(alphabets["zz"], 40, 150, 77)]
    clean = [(lang, t) for k, lang in enumerate(learned) for t in invented(alphabets[lang], 60, 150, 100 + k)]
    got = language.classify(spark.createDataFrame(odd + clean, "kind string, text string"), model).collect()
    for kind in ("junk", "zz"):
        assert sum(r["rejected"] for r in got if r["kind"] == kind) >= 38
    stay = [r for r in got if r["kind"] in learned]
    assert all(r["lang_pred"] == r["kind"] for r in stay)
    assert sum(r["rejected"] for r in stay) <= 0.02 * len(stay)


def test_a_tie_is_rejected(spark):
    same = spark.createDataFrame([(k, "ein text ohne unterschied", lang) for k, lang in enumerate(("b", "a"))], "doc_id long, text string, lang string")
    assert language.classify(same.limit(1), language.fit(same)).first()["rejected"]
