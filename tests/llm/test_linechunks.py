import random

from counterpoise.llm import linechunks
from counterpoise.llm.linechunks import cut


def brute(rows, **options):
    """Kept texts by (id, text), in order of id; first occurrence of every removable chunk stays."""
    seen, out = set(), {}
    for key in sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = key[1].encode().split(b"\n")
        gone = set()
        for a, b in cut(lines, **options):
            body = b"\n".join(lines[a:b])
            if body in seen:
                gone.update(range(a, b))
            seen.add(body)
        out[key] = b"\n".join(line for k, line in enumerate(lines) if k not in gone).decode()
    return out


def corpus(rng, n=40):
    passages = ["\n".join(" ".join(f"p{p}w{rng.randrange(99)}" for _ in range(6)) for _ in range(rng.randrange(2, 9))) for p in range(5)]
    solo = " ".join(f"s{k}" for k in range(60))
    rows = []
    for i in range(n):
        parts = [f"own line {i} {rng.randrange(10**6)}" for _ in range(rng.randrange(1, 6))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([*passages, solo]))
        rows.append((i, "\n".join(parts)))
    return rows


def test_brute_force(spark):
    rows = corpus(random.Random(3)) + [(500, None), (501, ""), (502, "\n\n\n"), (503, "x"), (3, "other text of id three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = linechunks.remove_repeats(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] == 500:
            assert r["text"] is None and r["n_lines"] == 0
    originals = {i: t for i, t in rows if i != 3}
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] in originals and originals[r["doc_id"]]} == {k[0]: v for k, v in want.items() if k[0] in originals}
    assert sum(r["n_removed"] for r in got) > 0


def test_clashing_hashes_are_told_apart(spark):
    rows = corpus(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = linechunks.remove_repeats(docs, hashed=lambda chunk: len(chunk) % 3)
    assert {r["doc_id"]: r["text"] for r in weak.collect()} == {k[0]: v for k, v in brute(rows).items()}


def test_inserted_line_moves_only_near_cuts():
    lines = [f"line {k} with some words".encode() for k in range(60)]
    ends = lambda ls: {ls[b - 1] for _, b in cut(ls)}
    assert len(ends(lines) ^ ends([b"new", *lines])) <= 2


def test_repeated_rows_and_clashing_columns(spark):
    body = "a b c d e f\ng h i j k l m n o\n" + " ".join(["solo"] * 55)
    docs = spark.createDataFrame([(1, body, 5), (1, body, 5), (2, body, 6), (None, body, 7)], "doc_id long, text string, n_lines int")
    got = linechunks.remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_lines_1", "n_removed"]
    by = {(r["doc_id"], r["n_lines"]): r for r in got.collect()}
    assert by[1, 5]["text"] == body and got.where("doc_id = 1").count() == 2
    assert "solo" not in by[2, 6]["text"] and "solo" not in by[None, 7]["text"]


def test_long_text_and_empty_table(spark):
    long = "\n".join(f"row {k} of a very long text" for k in range(50_000))
    docs = spark.createDataFrame([(1, long), (2, long + "\nlast line")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linechunks.remove_repeats(docs).collect()}
    assert got[1] == long and len(got[2]) < len(long) / 100
    assert linechunks.remove_repeats(docs.limit(0)).count() == 0
