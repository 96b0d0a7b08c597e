import corpus_pipeline
from counterpoise.llm import queries


def test_stages(spark, tmp_path):
    """Each stage keeps clean documents and does its work on planted ones."""
    clean = [(i, " ".join(f"word{i}x{k}" for k in range(60)) + f"\nother line {i}", "en", f"s{i % 3}", 0) for i in range(40)]
    passage = "\n".join(" ".join(f"rep{a}y{b}" for b in range(20)) for a in range(40))
    planted = [
        (100, clean[3][1], "en", "s0", 0),
        (101, clean[4][1].replace("word4x7", "changed"), "en", "s0", 0),
        (102, "12 34 ?!", "en", "s0", 0),
        (103, f"start one two three\n{passage}\nend", "en", "s1", 0),
        (104, f"begin four five six\n{passage}\nstop", "en", "s1", 0),
        (105, "before " + " ".join(f"test{k}" for k in range(12)) + " after " + " ".join(f"free{k}" for k in range(40)), "en", "s1", 0),
        (106, None, None, None, None),
        (None, "a document without an id but with words of its own", None, "s1", 0),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(clean + planted, schema)
    spark.createDataFrame([(1, " ".join(f"test{k}" for k in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = set(range(40))
    assert {102, 106}.isdisjoint(seen["language"]) and ids | {100, 101, 103, 104, 105, None} <= set(seen["language"])
    assert 100 not in seen["line_dedup"] and ids <= set(seen["line_dedup"])
    assert seen["line_dedup"][103] == planted[3][1] and len(seen["line_dedup"][104]) < len(planted[4][1]) / 2
    assert 101 not in seen["near_duplicates"] and ids <= set(seen["near_duplicates"])
    assert "test5" not in seen["decontamination"][105] and "free39" in seen["decontamination"][105]
    assert ids <= set(seen["decontamination"])
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and len(seen["mixing"]) >= 20


def test_queries_name_every_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5
