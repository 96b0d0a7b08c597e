"""Registered queries of the package, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from counterpoise.llm import bloomlm, bpe, chosenpath, common, decontaminate, divergence, hnsw, language, licenses, linechunks, mixing, phrases, pii, quality


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every fiftieth one."""
    return hnsw.neighbours(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned outside the held-out quarter."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(common.learnable("doc_id", 4, 2)))
    return language.classify(docs.drop("lang"), model).select("doc_id", common.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of ten words of a benchmark item."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("stretches", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        common.sha256_of(F.array_join("items", ",")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
test AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS passage
  FROM test, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS passage
  FROM tokens, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
found AS (SELECT g.doc_id, g.n, g.i, v.item_id FROM grams g JOIN windows v ON g.n = v.n AND g.passage = v.passage),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tokens t LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and spans found through their contexts."""
    found = pii.find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    both = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, common.sha256_of(pii.written("base")).alias("base_sha256"), pii.written(both).alias("spans"))


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or that of the nearest directory above.

    Documents have no paths, so ids are dealt to a tree of directories of 4096, 256
    and 16 documents, whose first documents are their licence files.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    place = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = (
        F.when(F.col("doc_id") % 4096 == 0, F.concat_ws("/", F.lit("corpus"), place(4096), F.lit("LICENSE")))
        .when(F.col("doc_id") % 256 == 0, F.concat_ws("/", F.lit("corpus"), place(4096), place(256), F.lit("LICENSE")))
        .when(F.col("doc_id") % 16 == 0, F.concat_ws("/", F.lit("corpus"), place(4096), place(256), place(16), F.lit("LICENSE")))
        .when(F.col("doc_id").isNotNull(), F.concat_ws("/", F.lit("corpus"), place(4096), place(256), place(16), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    )
    found = licenses.scan(docs.withColumn("path", path))
    return found.select("doc_id", "path", "licence", F.round("cosine", 6).alias("cosine"), "origin", "from_dir")


def _op7_sql() -> str:
    values = ", ".join(f"({k}, '{licence}', '{body}')" for k, (licence, body) in enumerate(licenses.TEMPLATES))
    return f"""
WITH templates(template, licence, body) AS (VALUES {values}),
tf AS MATERIALIZED (
  SELECT template, licence, word, count(*) AS tf
  FROM (SELECT template, licence, unnest(list_transform(regexp_extract_all(body, '[A-Za-z0-9]+'), lambda w: lower(w))) AS word FROM templates)
  GROUP BY ALL),
files AS MATERIALIZED (
  SELECT doc_id, text, 'corpus/' || (doc_id // 4096) || CASE WHEN doc_id % 4096 = 0 THEN '/LICENSE' WHEN doc_id % 256 = 0
    THEN '/' || (doc_id // 256) || '/LICENSE' WHEN doc_id % 16 = 0 THEN '/' || (doc_id // 256) || '/' || (doc_id // 16) || '/LICENSE'
    ELSE '/' || (doc_id // 256) || '/' || (doc_id // 16) || '/' || doc_id || '.txt' END AS path,
    doc_id % 16 = 0 AS licence_file FROM documents),
n AS (SELECT count(*) AS n FROM files),
df AS MATERIALIZED (
  SELECT word, count(*) AS df FROM (
    SELECT DISTINCT path, doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda w: lower(w))) AS word FROM files)
  WHERE word IN (SELECT word FROM tf) GROUP BY word),
idf AS MATERIALIZED (SELECT DISTINCT t.word, 1 + ln((n + 1.0) / (coalesce(df, 0) + 1)) AS idf FROM tf t LEFT JOIN df USING (word), n),
weights AS MATERIALIZED (
  SELECT template, licence, word, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY template)) AS weight FROM tf JOIN idf USING (word)),
units AS (
  SELECT path, i AS line, ls[i] AS body FROM (SELECT path, string_split(coalesce(text, ''), chr(10)) AS ls FROM files), unnest(range(1, len(ls) + 1)) AS t(i)
  UNION ALL SELECT path, 0, text FROM files WHERE licence_file),
counted AS MATERIALIZED (
  SELECT path, line, word, count(*) AS tf
  FROM (SELECT path, line, unnest(list_transform(regexp_extract_all(body, '[A-Za-z0-9]+'), lambda w: lower(w))) AS word FROM units)
  GROUP BY ALL),
lengths AS (
  SELECT path, line, sqrt(sum((tf * coalesce(idf, 1 + ln(n + 1.0))) ** 2)) AS length FROM counted LEFT JOIN idf USING (word), n GROUP BY ALL),
dots AS (
  SELECT path, line, template, licence, sum(tf * idf * weight) AS dot
  FROM counted JOIN idf USING (word) JOIN weights USING (word) GROUP BY ALL),
own AS MATERIALIZED (
  SELECT path, licence, cosine FROM (
    SELECT path, licence, round(dot / length, 9) AS cosine, row_number() OVER (PARTITION BY path ORDER BY round(dot / length, 9) DESC, licence) AS r
    FROM dots JOIN lengths USING (path, line) WHERE round(dot / length, 9) >= {licenses.MIN_COSINE}) WHERE r = 1),
licensed AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, licence FROM own WHERE path LIKE '%/LICENSE'),
above AS (
  SELECT f.path, l.dir, l.licence, row_number() OVER (PARTITION BY f.path ORDER BY length(l.dir) DESC) AS r
  FROM files f JOIN licensed l ON f.path LIKE l.dir || '/%')
SELECT f.doc_id, f.path, coalesce(o.licence, a.licence) AS licence, round(o.cosine, 6) AS cosine,
  CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN a.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.licence IS NULL THEN a.dir END AS from_dir
FROM files f LEFT JOIN own o USING (path) LEFT JOIN above a ON a.path = f.path AND a.r = 1
"""


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated runs of lines."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return linechunks.remove_repeats(docs)


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, i, ls[i] AS line,
    len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS words,
    ('0x' || substr(md5(ls[i]), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''), unnest(range(1, len(ls) + 1)) AS t(i)),
hits AS (
  SELECT *, words >= 50 AS solo, ((coalesce(lag(h) OVER w, 0) * 31 + h) % 4294967296) % 2 = 0 AS hit, coalesce(lead(words) OVER w, 0) AS next_words,
    count(*) OVER (PARTITION BY doc_id) AS n_lines
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
rolled AS (
  SELECT *, solo OR next_words >= 50
    OR (hit AND NOT coalesce(lag(hit) OVER (PARTITION BY doc_id ORDER BY i), TRUE) AND i + 1 < n_lines) AS cut FROM hits),
numbered AS (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
  FROM rolled),
chunks AS (
  SELECT doc_id, chunk, min(i) AS start, count(*) AS n, bool_or(solo) OR (count(*) >= 2 AND sum(words) >= 10) AS removable,
    string_agg(line, chr(10) ORDER BY i) AS body
  FROM numbered GROUP BY doc_id, chunk),
ranked AS (
  SELECT *, removable AND row_number() OVER (PARTITION BY removable, body ORDER BY doc_id, start) > 1 AS gone FROM chunks),
kept AS (
  SELECT doc_id, sum(n) AS n_lines, coalesce(sum(n) FILTER (gone), 0) AS n_removed,
    coalesce(string_agg(body, chr(10) ORDER BY start) FILTER (NOT gone), '') AS text
  FROM ranked GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.text, d.text) AS text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word shingles, Jaccard 0.8."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return chosenpath.join(docs).select(F.col("id").alias("doc_id"), "class_id", "n_links")


OP9_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM tokens, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 10 * shared >= 8 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links
FROM documents d JOIN classes c ON c.a = d.doc_id LEFT JOIN counts n ON n.a = d.doc_id
"""

def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from positives and unlabelled text outside the held-out third."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(common.learnable("doc_id", 3, 1))
    positives = labels.groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1")
    model = quality.fit(docs.where(common.learnable("doc_id", 3, 1)), positives)
    return quality.score(docs, model).select("doc_id", common.held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and draw of every document for equal sources and topics and tempered languages."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "tokens", "topic", F.round("probability", 9).alias("probability"), "kept")


def _op2_sql() -> str:
    steps, table = [], "cells"
    for sweep in range(mixing.SWEEPS):
        for dim in ("source", "lang", "topic"):
            name = f"s{sweep}_{dim}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.weight * g.goal / sum(c.weight) OVER (PARTITION BY c.{dim}) AS weight "
                f"FROM {table} c JOIN goal_{dim} g ON g.{dim} = c.{dim})"
            )
            table = name
    for k in range(mixing.CALIBRATION_STEPS):
        steps.append(
            f"f{k + 1} AS MATERIALIZED (SELECT max(f) * {mixing.KEEP_SHARE} * sum(tokens) / sum(tokens * least(1.0, weight / tokens * f)) AS f FROM {table}, f{k})"
        )
    return (
        r"""
WITH found AS (
  SELECT doc_id, text, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grouped AS (
  SELECT doc_id, text, source, lang, CAST(len(w) AS BIGINT) AS tokens,
    list_transform(list_filter(w, lambda x: length(x) >= 5), lambda x: (ascii(x) + length(x)) % 4) AS g FROM found),
counted AS (
  SELECT *, [len(list_filter(g, lambda x: x = 0)), len(list_filter(g, lambda x: x = 1)), len(list_filter(g, lambda x: x = 2)),
    len(list_filter(g, lambda x: x = 3))] AS n FROM grouped),
rows_ AS MATERIALIZED (
  SELECT doc_id, text, source, lang, tokens,
    CASE WHEN len(g) = 0 THEN 'none' ELSE 'group' || (list_position(n, list_max(n)) - 1) END AS topic FROM counted),
cells AS MATERIALIZED (
  SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens, CAST(sum(tokens) AS DOUBLE) AS weight
  FROM rows_ GROUP BY ALL HAVING sum(tokens) > 0),
total AS (SELECT sum(tokens) AS t FROM cells),
goal_source AS MATERIALIZED (SELECT source, t / count(*) OVER () AS goal FROM (SELECT DISTINCT source FROM cells), total),
goal_topic AS MATERIALIZED (SELECT topic, t / count(*) OVER () AS goal FROM (SELECT DISTINCT topic FROM cells), total),
goal_lang AS MATERIALIZED (
  SELECT lang, s / sum(s) OVER () * t AS goal FROM (SELECT lang, sqrt(sum(tokens)) AS s FROM cells GROUP BY lang), total),
"""
        + f"f0 AS (SELECT {mixing.KEEP_SHARE} AS f),\n"
        + ",\n".join(steps)
        + f"""
SELECT r.doc_id, r.tokens, r.topic, round(coalesce(least(1.0, c.weight / c.tokens * f), 0), 9) AS probability,
  CAST(('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(r.doc_id AS VARCHAR), md5(r.text), '')), 1, 13)) AS BIGINT) / 4503599627370496.0
    < coalesce(least(1.0, c.weight / c.tokens * f), 0) AS kept
FROM rows_ r LEFT JOIN {table} c ON c.source = r.source AND c.lang = r.lang AND c.topic = r.topic AND r.tokens > 0, f{mixing.CALIBRATION_STEPS}
"""
    )


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; learned outside the held-out tenth."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model, rare_words = bloomlm.fit(docs.where(common.learnable("doc_id", 10, 0)))
    scored = bloomlm.score(docs, model, rare_words)
    return scored.select("doc_id", common.held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


BPE_RANKS = "byte_bpe_50k.tiktoken"


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document text by the byte-level rank file, and the bytes they decode to."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, "text", public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two to four words of every lang of the whole documents table."""
    return phrases.mine(common.table(spark, sf_dir, "documents").select("text", "lang"))


OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, p FROM documents,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS t(p)),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM words, unnest(range(1, len(w) + 1)) AS t(i), unnest(range(1, {phrases.MAX_WORDS + 1})) AS u(k) WHERE i + k - 1 <= len(w)),
counted AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {phrases.MIN_COUNT}),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k >= 2),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS outer_a
  FROM candidates, unnest(range(2, k)) AS t(m), unnest(range(1, k - m + 2)) AS u(i) WHERE k >= 3 GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_ i USING (lang, phrase)
  WHERE i.outer_a IS NULL OR {phrases.KEEP_DENOMINATOR} * i.outer_a < {phrases.KEEP_NUMERATOR} * c.a),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r,
    CAST(c.a AS HUGEINT) * {phrases.SCALE} // (l.f + r.f) AS score
  FROM kept c, unnest(range(1, c.k)) AS t(j)
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:c.k], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE o = 1)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {phrases.TOP}
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the other sources of its lang and from the lang, over the whole documents table."""
    return divergence.audit(common.table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
toks AS (
  SELECT lang, source, row_number() OVER () AS doc,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM d),
occ AS MATERIALIZED (SELECT lang, source, doc, unnest(w) AS term FROM toks),
kept AS MATERIALIZED (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT doc) >= {divergence.MIN_DOCS}),
v AS (SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY l.lang),
gc AS MATERIALIZED (SELECT o.lang, o.source, o.term, count(*) AS c FROM occ o JOIN kept k USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(gc.c), 0) AS n FROM groups g LEFT JOIN gc USING (lang, source) GROUP BY ALL),
lc AS (SELECT lang, term, sum(c) AS c FROM gc GROUP BY ALL),
lt AS (SELECT lang, sum(c) AS n FROM lc GROUP BY lang),
grid AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(gc.c, 0) AS c,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(gc.c, 0) + 1)) // (gn.n + v.v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN gn USING (lang, source) JOIN v USING (lang) LEFT JOIN gc USING (lang, source, term)),
lp AS (SELECT lc.lang, lc.term, 1 + (CAST(1000000000 AS HUGEINT) * (lc.c + 1)) // (lt.n + v.v) AS q FROM lc JOIN lt USING (lang) JOIN v USING (lang)),
terms AS (
  SELECT g.lang, g.source, 'term' AS part, g.term AS item, ((p - q) * (p - q)) // q AS value
  FROM grid g JOIN lp USING (lang, term) WHERE g.c > 0 AND p > q),
pv AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT ga.lang, ga.source, 'pair' AS part, gb.source AS item, coalesce(pv.value, 0) AS value
  FROM groups ga JOIN groups gb ON ga.lang = gb.lang AND ga.source <> gb.source
  LEFT JOIN pv ON pv.lang = ga.lang AND pv.source = ga.source AND pv.item = gb.source),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""


QUERIES = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_hnsw": op3_hnsw,
    "op4_language": op4_language,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_licenses": op7_licenses,
    "op8_line_chunks": op8_line_chunks,
    "op9_chosen_path_join": op9_chosen_path_join,
    "op10_bloom_lm": op10_bloom_lm,
    "op11_bpe": op11_bpe,
    "op12_phrases": op12_phrases,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL = {
    "op2_mixing": _op2_sql(),
    "op5_decontamination": OP5_SQL,
    "op7_licenses": _op7_sql(),
    "op8_line_chunks": OP8_SQL,
    "op9_chosen_path_join": OP9_SQL,
    "op12_phrases": OP12_SQL,
    "op13_divergence": OP13_SQL,
}
