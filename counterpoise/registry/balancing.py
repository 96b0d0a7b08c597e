"""Registered queries: ratio ladders and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterpoise.functions.draws import uniform
from counterpoise.operators import knn, resample
from counterpoise.operators.knn import vector_of
from counterpoise.plans import ladder
from counterpoise.registry import fixtures as X
from counterpoise.registry.fixtures import sql_draw, sql_uniform
from counterpoise.sources.tables import task

RATIOS = {"twice": 2.0, "even": 1.0}
RATIOS_SQL = "ratios(variant, r) AS (VALUES ('twice', 2.0::DOUBLE), ('even', 1.0::DOUBLE))"


def _counts_sql(source):
    return f"counts AS (SELECT sum(y)::BIGINT AS few, (count(*) - sum(y))::BIGINT AS many FROM {source})"


LADDER_SQL = """
steps AS (
  SELECT few, many, many::DOUBLE / few AS ratio, i,
         greatest(many::DOUBLE / few - i * ((many::DOUBLE / few - 1) / 5), 1.0::DOUBLE) AS r
  FROM counts, range(1, 6) t(i)
)"""


def ir_ladder(spark, sf):
    """Counts and achieved ratio of every undersampling step, the original last."""
    task = X.line_items(spark, sf)
    made = ladder.rebalance_ladder(task, [ladder.RANDOM_UNDER], n_per_method=5, seed=X.SEED)
    counted = made.rows.groupBy("variant").agg(
        F.sum("y").alias("n_minority"), F.sum(1 - F.col("y")).alias("n_majority")
    )
    return counted.join(made.variants, "variant").select(
        "method",
        F.round("ir", 6).alias("ir"),
        F.round("ir_frac_base", 6).alias("ir_frac_base"),
        F.round("ir_frac_range", 6).alias("ir_frac_range"),
        "n_minority",
        "n_majority",
        F.round(F.col("n_majority") / F.col("n_minority"), 6).alias("achieved_ir"),
    )


IR_LADDER = f"""
WITH {X.LINE_ITEMS}, {_counts_sql('items')}, {LADDER_SQL},
kept AS (SELECT *, floor(few / (1 / r))::BIGINT AS n FROM steps)
SELECT 'UNDERSAMPLING__Random' AS method, round(r, 6) AS ir, round(r / ratio, 6) AS ir_frac_base,
       round((r - 1) / (ratio - 1), 6) AS ir_frac_range, few AS n_minority, n AS n_majority,
       round(n::DOUBLE / few, 6) AS achieved_ir
FROM kept
UNION ALL
SELECT 'original', round(many::DOUBLE / few, 6), 1, 1, few, many, round(many::DOUBLE / few, 6) FROM counts
"""


def ladder_counts(spark, sf):
    """The basic family at every ratio, with rendered variant names."""
    made = ladder.rebalance_ladder(X.orders(spark, sf), ladder.BASIC, n_per_method=5, seed=X.SEED)
    counted = made.rows.groupBy("variant", "y").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(made.variants.select("variant", "method", "is_base"), "variant")


LADDER_COUNTS = f"""
WITH {X.ORDERS}, {_counts_sql('urgent')}, {LADDER_SQL},
m(method) AS (VALUES ('UNDERSAMPLING__Random'), ('OVERSAMPLING__Random'), ('OVERSAMPLING__SMOTE')),
v AS (
  SELECT 'orders_transformed_' || method || '_IR=' || round(r, 2) || '=' || round(r / ratio, 2) || 'BASE_IR='
         || round((r - 1) / (ratio - 1), 2) || 'IR_RANGE' AS variant, method, few, many, r
  FROM steps, m
),
n AS (
  SELECT variant, method, CASE WHEN method LIKE 'UNDER%' THEN floor(few / (1 / r))::BIGINT ELSE many END AS n0,
         CASE WHEN method LIKE 'UNDER%' THEN few ELSE floor(1 / r * many)::BIGINT END AS n1 FROM v
  UNION ALL SELECT 'orders', 'original', many, few FROM counts
)
SELECT variant, 0 AS y, n0 AS n, method, method = 'original' AS is_base FROM n
UNION ALL SELECT variant, 1, n1, method, method = 'original' FROM n
"""


def under_random(spark, sf):
    return resample.random_under(X.line_items(spark, sf), RATIOS, X.SEED).select("variant", "rid", "y", "origin")


UNDER_RANDOM = f"""
WITH {X.LINE_ITEMS}, {RATIOS_SQL}, {_counts_sql('items')},
ranked AS (SELECT rid, y, row_number() OVER (PARTITION BY y ORDER BY {sql_draw('under', 'rid')}, rid) AS rn FROM items)
SELECT variant, rid, y, 'original' AS origin FROM ranked, ratios, counts
WHERE y = 1 OR rn <= floor(few / (1 / r))
"""


def over_random(spark, sf):
    return resample.random_over(X.line_items(spark, sf), RATIOS, X.SEED)


_OVER_DRAWS = f"""
draws AS (
  SELECT variant, k FROM ratios, counts, range((SELECT greatest(max(floor(1 / r * many)::BIGINT - few), 0) FROM ratios, counts)) t(k)
  WHERE k < floor(1 / r * many)::BIGINT - few
)"""

OVER_RANDOM = f"""
WITH {X.LINE_ITEMS}, {RATIOS_SQL}, {_counts_sql('items')}, {_OVER_DRAWS},
numbered AS (SELECT *, row_number() OVER (ORDER BY {sql_draw('index', 'rid')}, rid) - 1 AS idx FROM items WHERE y = 1)
SELECT variant, rid, l_quantity, l_extendedprice, l_discount, l_tax, y, 'original' AS origin FROM items, ratios
UNION ALL
SELECT variant, 'new|' || k, l_quantity, l_extendedprice, l_discount, l_tax, y, 'copy'
FROM draws JOIN numbered ON idx = {sql_draw('copy', 'k')} % (SELECT few FROM counts)
"""


def _vectors(spark, sf):
    task = X.embeddings(spark, sf)
    return task.df.select("rid", "y", vector_of(task.df, task.features).alias("vec"))


def knn_join(spark, sf):
    points = _vectors(spark, sf).drop("y")
    return knn.nearest(points, points, 5).withColumn("dist", F.round("dist", 6))


KNN = f"""
WITH {X.EMBEDDINGS},
d AS (SELECT a.rid, b.rid AS neighbour, list_distance(a.vec, b.vec) AS dist FROM vectors a, vectors b WHERE a.rid <> b.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, neighbour) AS rank FROM d)
SELECT rid, neighbour, round(dist, 6) AS dist, rank FROM r WHERE rank <= 5
"""


def knn_items(spark, sf):
    """Nearest earlier-priced parts in one dimension: ties and copies everywhere."""
    rows = X.table(spark, sf, "part").select(
        F.col("p_partkey").alias("rid"),
        F.array(F.col("p_size").cast("double"), F.round("p_retailprice").cast("double")).alias("vec"),
    )
    return knn.nearest(rows, rows, 3)


KNN_ITEMS = """
WITH p AS (SELECT p_partkey AS rid, p_size::DOUBLE AS a, round(p_retailprice) AS b FROM part),
d AS (
  SELECT x.rid, y.rid AS neighbour, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS dist
  FROM p x, p y WHERE x.rid <> y.rid
),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, neighbour) AS rank FROM d)
SELECT rid, neighbour, dist, rank FROM r WHERE rank <= 3
"""


def tomek(spark, sf):
    return knn.tomek_links(_vectors(spark, sf), "y")


TOMEK = f"""
WITH {X.EMBEDDINGS},
d AS (SELECT a.rid, a.y, b.rid AS neighbour, b.y AS y2, list_distance(a.vec, b.vec) AS dist FROM vectors a, vectors b WHERE a.rid <> b.rid),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, neighbour) AS rn FROM d) WHERE rn = 1)
SELECT a.rid, a.neighbour FROM f a JOIN f b ON a.neighbour = b.rid AND b.neighbour = a.rid WHERE a.y <> a.y2
"""


def tomek_items(spark, sf):
    """Tomek links of the customer table on two numeric columns."""
    rows = X.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("rid"),
        F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("vec"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"),
    )
    return knn.tomek_links(rows, "y")


TOMEK_ITEMS = """
WITH p AS (
  SELECT c_custkey AS rid, c_acctbal AS a, c_nationkey::DOUBLE AS b, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y
  FROM customer
),
d AS (
  SELECT x.rid, x.y, z.rid AS neighbour, z.y AS y2, sqrt((x.a - z.a) * (x.a - z.a) + (x.b - z.b) * (x.b - z.b)) AS dist
  FROM p x, p z WHERE x.rid <> z.rid
),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, neighbour) AS rn FROM d) WHERE rn = 1)
SELECT a.rid, a.neighbour FROM f a JOIN f b ON a.neighbour = b.rid AND b.neighbour = a.rid WHERE a.y <> a.y2
"""


def near_miss(spark, sf):
    return resample.near_miss(X.embeddings(spark, sf), RATIOS, seed=X.SEED).select("variant", "rid", "y")


NEAR_MISS = f"""
WITH {X.EMBEDDINGS}, {RATIOS_SQL}, {_counts_sql('vectors')},
d AS (
  SELECT a.rid, b.rid AS neighbour, list_distance(a.vec, b.vec) AS dist FROM vectors a, vectors b WHERE a.y = 0 AND b.y = 1
),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, neighbour) AS rn FROM d),
m AS (SELECT rid, avg(dist) AS dist FROM r WHERE rn <= 3 GROUP BY rid),
o AS (SELECT rid, row_number() OVER (ORDER BY round(dist, 12), {sql_draw('near', 'rid')}, rid) AS rn FROM m)
SELECT variant, rid::VARCHAR AS rid, 0 AS y FROM o, ratios, counts WHERE rn <= floor(few / (1 / r))
UNION ALL SELECT variant, rid::VARCHAR, 1 FROM vectors, ratios WHERE y = 1
"""


def _priced_orders(spark, sf):
    """Orders in two dimensions; more of either class than one block of the neighbour join holds."""
    rows = X.table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("customer"), (F.col("o_orderpriority") < "3").cast("int").alias("y")
    )
    return task(rows, "y", ["o_totalprice", "customer"], "o_orderkey", "priced")


_PRICED = """
priced AS (
  SELECT o_orderkey AS rid, o_totalprice AS a, o_custkey::DOUBLE AS b, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END AS y FROM orders
)"""


def knn_blocks(spark, sf):
    """Neighbours of the minority among all orders, through blocks of points."""
    base = _priced_orders(spark, sf)
    points = base.df.select("rid", "y", vector_of(base.df, base.features).alias("vec"))
    found = knn.nearest(points.where("y = 1").drop("y"), points.drop("y"), 5)
    return found.withColumn("dist", F.round("dist", 6))


KNN_BLOCKS = f"""
WITH {_PRICED},
d AS (
  SELECT x.rid, unnest(min_by({{'dist': sqrt((x.a - z.a) * (x.a - z.a) + (x.b - z.b) * (x.b - z.b)), 'neighbour': z.rid}},
    {{'dist': sqrt((x.a - z.a) * (x.a - z.a) + (x.b - z.b) * (x.b - z.b)), 'neighbour': z.rid}}, 5)) AS n
  FROM priced x, priced z WHERE x.y = 1 AND x.rid <> z.rid GROUP BY x.rid
)
SELECT rid, n.neighbour AS neighbour, round(n.dist, 6) AS dist, row_number() OVER (PARTITION BY rid ORDER BY n.dist, n.neighbour) AS rank FROM d
"""


def near_miss_blocks(spark, sf):
    """Undersampling by nearness where the minority fills several blocks."""
    return resample.near_miss(_priced_orders(spark, sf), {"even": 1.0, "near": 1.2}, seed=X.SEED).select("variant", "rid", "y")


NEAR_MISS_BLOCKS = f"""
WITH {_PRICED}, ratios(variant, r) AS (VALUES ('even', 1.0::DOUBLE), ('near', 1.2::DOUBLE)), {_counts_sql('priced')},
m AS (
  SELECT rid, list_avg(d) AS dist FROM (
    SELECT x.rid, min(sqrt((x.a - z.a) * (x.a - z.a) + (x.b - z.b) * (x.b - z.b)), 3) AS d
    FROM priced x, priced z WHERE x.y = 0 AND z.y = 1 GROUP BY x.rid)
),
o AS (SELECT rid, row_number() OVER (ORDER BY round(dist, 12), {sql_draw('near', 'rid')}, rid) AS rn FROM m)
SELECT variant, rid::VARCHAR AS rid, 0 AS y FROM o, ratios, counts WHERE rn <= floor(few / (1 / r))
UNION ALL SELECT variant, rid::VARCHAR, 1 FROM priced, ratios WHERE y = 1
"""


def ladder_automatic(spark, sf):
    """All six methods at two ratios of the customers' balances: rows and classes of every variant."""
    base = _account_points(spark, sf)
    made = ladder.rebalance_ladder(base, ladder.AUTOMATIC, n_per_method=2, seed=X.SEED).stored()
    counted = made.rows.where(~F.col("variant").contains("Tomek") & ~F.col("variant").contains("Borderline")).groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_minority")
    )
    return counted.join(made.variants, "variant").select("method", F.round("ir", 6).alias("ir"), "n", "n_minority")


LADDER_AUTOMATIC = """
WITH c AS (SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS few, count(*) FILTER (c_mktsegment <> 'BUILDING') AS many FROM customer),
s AS (SELECT few, many, many::DOUBLE / few AS ratio, greatest(many::DOUBLE / few - i * ((many::DOUBLE / few - 1) / 2), 1.0::DOUBLE) AS r FROM c, range(1, 3) t(i))
SELECT m AS method, round(r, 6) AS ir, floor(few / (1 / r))::BIGINT + few AS n, few AS n_minority
FROM s, (VALUES ('UNDERSAMPLING__Random'), ('UNDERSAMPLING__Near_Miss')) t(m)
UNION ALL SELECT m, round(r, 6), many + floor(1 / r * many)::BIGINT, floor(1 / r * many)::BIGINT
FROM s, (VALUES ('OVERSAMPLING__Random'), ('OVERSAMPLING__SMOTE')) t(m)
UNION ALL SELECT 'original', round(many::DOUBLE / few, 6), many + few, few FROM c
"""


def _summed(out):
    """Vectors as two checksums: sum and position-weighted sum."""
    wide = out.withColumn("_v", F.col("embedding").cast("array<double>"))
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(
        F.transform("_v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return wide.select(
        "variant", "rid", "y", "origin", F.round(total, 5).alias("v_sum"), F.round(weighted, 4).alias("v_weighted")
    )


_SUMS = """
round(list_sum(v), 5) AS v_sum, round(list_sum([v[i] * i FOR i IN range(1, len(v) + 1)]), 4) AS v_weighted"""

_MINORITY_NEIGHBOURS = """
mino AS (SELECT rid, vec FROM vectors WHERE y = 1),
nd AS (SELECT a.rid, b.rid AS neighbour, b.vec AS other, list_distance(a.vec, b.vec) AS dist FROM mino a, mino b WHERE a.rid <> b.rid),
nn AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, neighbour) AS rank FROM nd)"""


def _made_sql(bases):
    return f"""
numbered AS (SELECT rid, vec, row_number() OVER (ORDER BY {sql_draw('index', 'rid')}, rid) - 1 AS idx FROM {bases}),
placed AS (
  SELECT variant, k, {sql_draw('base', 'k')} % (SELECT count(*) FROM numbered) AS idx,
         1 + {sql_draw('neighbour', 'k')} % 5 AS rank, {sql_uniform('weight', 'k')} AS u FROM draws
),
made AS (
  SELECT variant, 'new|' || k AS rid,
         [(vec[i] + (other[i] - vec[i]) * u)::FLOAT::DOUBLE FOR i IN range(1, len(vec) + 1)] AS v
  FROM placed JOIN numbered USING (idx) JOIN nn ON nn.rid = numbered.rid AND nn.rank = placed.rank
)"""


def smote(spark, sf):
    return _summed(resample.smote(X.embeddings(spark, sf), RATIOS, seed=X.SEED))


SMOTE = f"""
WITH {X.EMBEDDINGS}, {RATIOS_SQL}, {_counts_sql('vectors')}, {_OVER_DRAWS}, {_MINORITY_NEIGHBOURS}, {_made_sql('mino')}
SELECT variant, rid::VARCHAR AS rid, y, 'original' AS origin, {_SUMS} FROM (SELECT *, vec AS v FROM vectors), ratios
UNION ALL SELECT variant, rid, 1, 'synthetic', {_SUMS} FROM made
"""


def borderline_smote(spark, sf):
    return _summed(resample.borderline_smote(X.embeddings(spark, sf), RATIOS, seed=X.SEED))


BORDERLINE_SMOTE = f"""
WITH {X.EMBEDDINGS}, {RATIOS_SQL}, {_counts_sql('vectors')}, {_OVER_DRAWS}, {_MINORITY_NEIGHBOURS},
md AS (SELECT a.rid, b.rid AS neighbour, b.y, list_distance(a.vec, b.vec) AS dist FROM mino a, vectors b WHERE a.rid <> b.rid),
mn AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, neighbour) AS rn FROM md),
danger AS (SELECT rid FROM mn WHERE rn <= 10 GROUP BY rid HAVING sum(1 - y) * 2 >= 10 AND sum(1 - y) < 10),
bases AS (SELECT mino.* FROM mino JOIN danger USING (rid)), {_made_sql('bases')}
SELECT variant, rid::VARCHAR AS rid, y, 'original' AS origin, {_SUMS} FROM (SELECT *, vec AS v FROM vectors), ratios
UNION ALL SELECT variant, rid, 1, 'synthetic', {_SUMS} FROM made
"""


def smote_tomek(spark, sf):
    return _summed(resample.smote_tomek(X.embeddings(spark, sf), RATIOS, seed=X.SEED))


SMOTE_TOMEK = f"""
WITH {X.EMBEDDINGS}, {RATIOS_SQL}, {_counts_sql('vectors')}, {_OVER_DRAWS}, {_MINORITY_NEIGHBOURS}, {_made_sql('mino')},
grown AS (
  SELECT variant, rid::VARCHAR AS rid, y, 'original' AS origin, vec AS v FROM vectors, ratios
  UNION ALL SELECT variant, rid, 1, 'synthetic', v FROM made
),
gd AS (
  SELECT a.variant, a.rid, a.y, b.rid AS neighbour, b.y AS y2,
         row_number() OVER (PARTITION BY a.variant, a.rid ORDER BY list_distance(a.v, b.v), b.rid) AS rn
  FROM grown a JOIN grown b ON a.variant = b.variant AND a.rid <> b.rid
),
gf AS (SELECT * FROM gd WHERE rn = 1),
links AS (
  SELECT a.variant, a.rid FROM gf a JOIN gf b ON a.variant = b.variant AND a.neighbour = b.rid AND b.neighbour = a.rid
  WHERE a.y <> a.y2
)
SELECT g.variant, g.rid, y, origin, {_SUMS} FROM grown g ANTI JOIN links l ON g.variant = l.variant AND g.rid = l.rid
"""


def _account_points(spark, sf):
    rows = X.table(spark, sf, "customer").select(
        "c_custkey",
        "c_acctbal",
        F.col("c_nationkey").cast("double").alias("nation"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"),
    )
    return task(rows, "y", ["c_acctbal", "nation"], "c_custkey", "accounts")


def smote_tomek_items(spark, sf):
    """Two numeric columns without class structure, where many links are removed."""
    out = resample.smote_tomek(_account_points(spark, sf), {"twice": 2.0}, seed=X.SEED)
    return out.withColumns({c: F.round(c, 6) for c in ("c_acctbal", "nation")})


SMOTE_TOMEK_ITEMS = f"""
WITH vectors AS (
  SELECT c_custkey AS rid, [c_acctbal, c_nationkey::DOUBLE] AS vec, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y
  FROM customer
),
ratios(variant, r) AS (VALUES ('twice', 2.0::DOUBLE)), {_counts_sql('vectors')}, {_OVER_DRAWS},
{_MINORITY_NEIGHBOURS}, {_made_sql('mino').replace('::FLOAT::DOUBLE', '')},
grown AS (
  SELECT variant, rid::VARCHAR AS rid, y, 'original' AS origin, vec AS v FROM vectors, ratios
  UNION ALL SELECT variant, rid, 1, 'synthetic', v FROM made
),
gd AS (
  SELECT a.rid, a.y, b.rid AS neighbour, b.y AS y2,
         row_number() OVER (PARTITION BY a.rid ORDER BY list_distance(a.v, b.v), b.rid) AS rn
  FROM grown a JOIN grown b ON a.rid <> b.rid
),
gf AS (SELECT * FROM gd WHERE rn = 1),
links AS (SELECT a.rid FROM gf a JOIN gf b ON a.neighbour = b.rid AND b.neighbour = a.rid WHERE a.y <> a.y2)
SELECT g.variant, g.rid, round(v[1], 6) AS c_acctbal, round(v[2], 6) AS nation, y, origin
FROM grown g ANTI JOIN links l ON g.rid = l.rid
"""


def smote_nc(spark, sf):
    out = resample.smote(X.parts(spark, sf), RATIOS, seed=X.SEED)
    return out.withColumn("p_retailprice", F.round("p_retailprice", 6))


SMOTE_NC = f"""
WITH {X.PARTS}, {RATIOS_SQL}, {_counts_sql('small_parts')}, {_OVER_DRAWS},
mino AS (SELECT * FROM small_parts WHERE y = 1),
pen AS (SELECT 0.5 * stddev_pop(p_retailprice) * stddev_pop(p_retailprice) AS p FROM mino),
d AS (
  SELECT a.rid, b.rid AS neighbour, b.p_retailprice AS other, b.p_brand, b.p_type,
         round(sqrt((a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice)
              + CASE WHEN a.p_brand <> b.p_brand THEN p ELSE 0 END + CASE WHEN a.p_type <> b.p_type THEN p ELSE 0 END), 9) AS dist
  FROM mino a, mino b, pen WHERE a.rid <> b.rid
),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, neighbour) AS rank FROM d) WHERE rank <= 5),
brand AS (SELECT rid, first(p_brand ORDER BY c DESC, p_brand) AS p_brand FROM (SELECT rid, p_brand, count(*) AS c FROM nn GROUP BY ALL) GROUP BY rid),
kind AS (SELECT rid, first(p_type ORDER BY c DESC, p_type) AS p_type FROM (SELECT rid, p_type, count(*) AS c FROM nn GROUP BY ALL) GROUP BY rid),
numbered AS (SELECT rid, p_retailprice, row_number() OVER (ORDER BY {sql_draw('index', 'rid')}, rid) - 1 AS idx FROM mino),
placed AS (
  SELECT variant, k, {sql_draw('base', 'k')} % (SELECT count(*) FROM numbered) AS idx,
         1 + {sql_draw('neighbour', 'k')} % 5 AS rank, {sql_uniform('weight', 'k')} AS u FROM draws
)
SELECT variant, 'new|' || k AS rid, round(n.p_retailprice + (nn.other - n.p_retailprice) * u, 6) AS p_retailprice,
       brand.p_brand, kind.p_type, 1 AS y, 'synthetic' AS origin
FROM placed JOIN numbered n USING (idx) JOIN nn ON nn.rid = n.rid AND nn.rank = placed.rank
JOIN brand ON brand.rid = n.rid JOIN kind ON kind.rid = n.rid
UNION ALL
SELECT variant, rid::VARCHAR, round(p_retailprice, 6), p_brand, p_type, y, 'original' FROM small_parts, ratios
"""


def smote_n(spark, sf):
    return resample.smote(X.customers(spark, sf), RATIOS, seed=X.SEED)


SMOTE_N = f"""
WITH {X.CUSTOMERS}, {RATIOS_SQL}, {_counts_sql('debtors')}, {_OVER_DRAWS},
va AS (SELECT c_mktsegment, round(2 * avg(y), 9) AS a FROM debtors GROUP BY 1),
vb AS (SELECT c_nationkey, round(2 * avg(y), 9) AS b FROM debtors GROUP BY 1),
mino AS (SELECT rid, c_mktsegment, c_nationkey, a, b FROM debtors JOIN va USING (c_mktsegment) JOIN vb USING (c_nationkey) WHERE y = 1),
d AS (
  SELECT x.rid, z.rid AS neighbour, z.c_mktsegment, z.c_nationkey,
         round(sqrt((x.a - z.a) * (x.a - z.a) + (x.b - z.b) * (x.b - z.b)), 9) AS dist
  FROM mino x, mino z WHERE x.rid <> z.rid
),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, neighbour) AS rank FROM d) WHERE rank <= 5),
seg AS (SELECT rid, first(c_mktsegment ORDER BY c DESC, c_mktsegment) AS c_mktsegment FROM (SELECT rid, c_mktsegment, count(*) AS c FROM nn GROUP BY ALL) GROUP BY rid),
nat AS (SELECT rid, first(c_nationkey ORDER BY c DESC, c_nationkey) AS c_nationkey FROM (SELECT rid, c_nationkey, count(*) AS c FROM nn GROUP BY ALL) GROUP BY rid),
numbered AS (SELECT rid, row_number() OVER (ORDER BY {sql_draw('index', 'rid')}, rid) - 1 AS idx FROM mino)
SELECT variant, 'new|' || k AS rid, c_mktsegment, c_nationkey, 1 AS y, 'synthetic' AS origin
FROM draws JOIN numbered ON idx = {sql_draw('base', 'k')} % (SELECT count(*) FROM numbered) JOIN seg USING (rid) JOIN nat USING (rid)
UNION ALL
SELECT variant, rid::VARCHAR, c_mktsegment, c_nationkey, y, 'original' FROM debtors, ratios
"""


def _coin_resampler(rows, label, ratio, seed):
    """A user resampler: keeps majority rows whose uniform draw is below ratio / 10."""
    return rows.where((F.col(label) == 1) | (uniform(seed, "coin", F.col("rid")) < ratio / 10))


def custom_resampler(spark, sf):
    out = resample.custom(X.events(spark, sf), _coin_resampler, RATIOS, X.SEED)
    return out.groupBy("variant", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


CUSTOM_RESAMPLER = f"""
WITH {X.EVENTS}, {RATIOS_SQL}
SELECT variant, y, count(*) AS n, round(sum(value), 4) AS total FROM failed, ratios
WHERE y = 1 OR {sql_uniform('coin', 'rid')} < r / 10 GROUP BY ALL
"""


def parameter_sweep(spark, sf):
    """One operator, four parameter sets; the impossible one ends in the failures table."""
    params = [{"ratio": 1.0, "seed": X.SEED}, {"alpha": 0.5, "seed": X.SEED}, {"ratio": 3.0, "seed": 1}, {"ratio": 50.0}]
    made = ladder.sweep(X.orders(spark, sf), resample.random_under, params)
    counted = made.rows.groupBy("variant", "y").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("rid").cast("bigint")).alias("rids")
    )
    failed = made.failures.select(
        "variant", F.lit(-1).alias("y"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("rids")
    )
    return counted.unionByName(failed)


PARAMETER_SWEEP = f"""
WITH {X.ORDERS}, {_counts_sql('urgent')},
r1 AS (SELECT rid, y, row_number() OVER (PARTITION BY y ORDER BY {sql_draw('under', 'rid')}, rid) AS rn FROM urgent),
r2 AS (SELECT rid, y, row_number() OVER (PARTITION BY y ORDER BY {sql_draw('under', 'rid', seed=1)}, rid) AS rn FROM urgent),
p AS (
  SELECT 'orders_transformed_0' AS variant, rid, y FROM r1, counts WHERE y = 1 OR rn <= floor(few / (1 / 1.0::DOUBLE))
  UNION ALL SELECT 'orders_transformed_1', rid, y FROM r1, counts WHERE y = 1 OR rn <= floor(few / (1 / 2.0::DOUBLE))
  UNION ALL SELECT 'orders_transformed_2', rid, y FROM r2, counts WHERE y = 1 OR rn <= floor(few / (1 / 3.0::DOUBLE))
)
SELECT variant, y, count(*) AS n, sum(rid)::BIGINT AS rids FROM p GROUP BY ALL
UNION ALL SELECT 'orders_transformed_3', -1, 0, 0
"""

# Fixed value of the fixture: the ratio that the user's audit refuses while rows are made.
REFUSED_RATIO = 1.5


def _audited_under(task, ratios, seed=0):
    """Random undersampling followed by a user audit that runs on every row inside the tasks.

    The audit (a vectorised Python function) raises for the refused ratio, so the
    plan is fine and only its execution fails, the way user code fails on a cluster.
    """
    import pandas as pd

    def audit(ratio):
        if (ratio == REFUSED_RATIO).any():
            raise ValueError(f"audit refuses ratio {REFUSED_RATIO}")
        return ratio > 0

    audit.__annotations__ = {"ratio": pd.Series, "return": pd.Series}  # this module postpones annotations
    (ratio,) = ratios.values()
    rows = resample.random_under(task, ratios, seed)
    return rows.where(F.pandas_udf(audit, "boolean")(F.lit(float(ratio))))


def sweep_failures(spark, sf):
    """Four parameter sets stored branch by branch; the one whose tasks raise is in the ledger, the others stay."""
    params = [{"ratio": 1.0, "seed": X.SEED}, {"ratio": REFUSED_RATIO, "seed": X.SEED}, {"ratio": 2.0, "seed": X.SEED}, {"ratio": 3.0, "seed": 1}]
    made = ladder.sweep(X.orders(spark, sf), _audited_under, params).stored()
    counted = made.rows.groupBy("variant", "y").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("rid").cast("bigint")).alias("rids")
    )
    failed = made.failures.select(
        "variant", F.lit(-1).alias("y"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("rids")
    )
    return counted.unionByName(failed)


SWEEP_FAILURES = f"""
WITH {X.ORDERS}, {_counts_sql('urgent')},
r1 AS (SELECT rid, y, row_number() OVER (PARTITION BY y ORDER BY {sql_draw('under', 'rid')}, rid) AS rn FROM urgent),
r2 AS (SELECT rid, y, row_number() OVER (PARTITION BY y ORDER BY {sql_draw('under', 'rid', seed=1)}, rid) AS rn FROM urgent),
p AS (
  SELECT 'orders_transformed_0' AS variant, rid, y FROM r1, counts WHERE y = 1 OR rn <= floor(few / (1 / 1.0::DOUBLE))
  UNION ALL SELECT 'orders_transformed_2', rid, y FROM r1, counts WHERE y = 1 OR rn <= floor(few / (1 / 2.0::DOUBLE))
  UNION ALL SELECT 'orders_transformed_3', rid, y FROM r2, counts WHERE y = 1 OR rn <= floor(few / (1 / 3.0::DOUBLE))
)
SELECT variant, y, count(*) AS n, sum(rid)::BIGINT AS rids FROM p GROUP BY ALL
UNION ALL SELECT 'orders_transformed_1', -1, 0, 0
"""

QUERIES = {
    "ir_ladder": (ir_ladder, IR_LADDER),
    "ladder_counts": (ladder_counts, LADDER_COUNTS),
    "under_random": (under_random, UNDER_RANDOM),
    "over_random": (over_random, OVER_RANDOM),
    "knn": (knn_join, KNN),
    "knn_blocks": (knn_blocks, KNN_BLOCKS),
    "near_miss_blocks": (near_miss_blocks, NEAR_MISS_BLOCKS),
    "ladder_automatic": (ladder_automatic, LADDER_AUTOMATIC),
    "knn_items": (knn_items, KNN_ITEMS),
    "tomek": (tomek, TOMEK),
    "tomek_items": (tomek_items, TOMEK_ITEMS),
    "near_miss": (near_miss, NEAR_MISS),
    "smote": (smote, SMOTE),
    "borderline_smote": (borderline_smote, BORDERLINE_SMOTE),
    "smote_tomek": (smote_tomek, SMOTE_TOMEK),
    "smote_tomek_items": (smote_tomek_items, SMOTE_TOMEK_ITEMS),
    "smote_nc": (smote_nc, SMOTE_NC),
    "smote_n": (smote_n, SMOTE_N),
    "custom_resampler": (custom_resampler, CUSTOM_RESAMPLER),
    "parameter_sweep": (parameter_sweep, PARAMETER_SWEEP),
    "sweep_failures": (sweep_failures, SWEEP_FAILURES),
}
