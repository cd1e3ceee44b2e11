"""Catalogue: agreement and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import agreement as ag
from strideframe.plans.common import E_SQL, V_SQL, L_SQL, events, lines, vectors
from strideframe.session import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def _ratings(spark, d):
    """Two raters over labelled documents, a third by a rule on the length, missing for every seventh."""
    l = table(spark, d, "labels")
    third = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 3).cast("int"))
    return l.select(F.col("doc_id").alias("subject_id"), F.explode(F.array(
        F.struct(F.lit("quality").alias("r"), F.col("quality").alias("v")), F.struct(F.lit("third").alias("r"), third.alias("v")), F.struct(F.lit("toxic").alias("r"), F.col("toxic").alias("v")),
    )).alias("x")).select("subject_id", F.col("x.r").alias("rater_id"), F.col("x.v").alias("rating"))


_RATINGS = """r AS (SELECT doc_id AS s, 'quality' AS k, quality AS v FROM labels UNION ALL SELECT doc_id, 'third', CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 3 AS INTEGER) END FROM labels
  UNION ALL SELECT doc_id, 'toxic', toxic FROM labels), v AS (SELECT * FROM r WHERE v IS NOT NULL)"""


def _kappa_sql(weight: str) -> str:
    return f"""WITH {_RATINGS}, sp AS (SELECT greatest(max(v), 0) - min(v) AS c FROM v),
c AS (SELECT a.k AS p, b.k AS q, a.v AS x, b.v AS y, count(*) AS n FROM v a JOIN v b ON a.s = b.s AND a.k < b.k GROUP BY ALL),
o AS (SELECT p, q, sum(n) AS t, sum(n * {weight}) / sum(n) AS o FROM c, sp GROUP BY p, q),
mx AS (SELECT p, q, x, sum(n) AS nx FROM c GROUP BY ALL), my AS (SELECT p, q, y, sum(n) AS ny FROM c GROUP BY ALL),
e AS (SELECT p, q, sum(nx * ny * {weight}) AS e FROM mx JOIN my USING (p, q), sp GROUP BY p, q)
SELECT round(sum(o - e / (t * t)) / nullif(sum(1 - e / (t * t)), 0), 6) AS kappa FROM o JOIN e USING (p, q)"""


@query(_kappa_sql("CAST(x = y AS INTEGER)::DOUBLE"))
def kappa_nominal(spark, d):
    return ag.kappa(_ratings(spark, d)).select(F.round("kappa", 6).alias("kappa"))


@query(_kappa_sql("(1 - abs(x - y)::DOUBLE / (c - 1))"))
def kappa_cicchetti_abs(spark, d):
    r = _ratings(spark, d)
    return ag.kappa(r, ag.cicchetti(ag.span_of(r))).select(F.round("kappa", 6).alias("kappa"))


@query(_kappa_sql("(1 - (x - y)::DOUBLE * (x - y) / ((c - 1) * (c - 1)))"))
def kappa_cicchetti_sq(spark, d):
    r = _ratings(spark, d)
    return ag.kappa(r, ag.cicchetti(ag.span_of(r), squared=True)).select(F.round("kappa", 6).alias("kappa"))


def _alpha_sql(distance: str) -> str:
    return f"""WITH {_RATINGS}, k AS (SELECT v, row_number() OVER (ORDER BY v) AS c FROM (SELECT DISTINCT v.v FROM v JOIN (SELECT s FROM v GROUP BY s HAVING count(*) > 1) USING (s))),
w AS (SELECT s, k, c, count(*) OVER (PARTITION BY s) AS m FROM v JOIN k USING (v)),
g AS (SELECT * FROM w WHERE m > 1),
o AS (SELECT sum({distance}::DOUBLE / (m - 1)) AS o FROM (SELECT x.c AS a, y.c AS b, x.m FROM g x JOIN g y ON x.s = y.s AND x.c < y.c)),
n AS (SELECT c, count(*) AS n FROM g GROUP BY c),
e AS (SELECT sum(na * nb * {distance}::DOUBLE) AS e FROM (SELECT x.c AS a, y.c AS b, x.n AS na, y.n AS nb FROM n x JOIN n y ON x.c < y.c))
SELECT round(1 - ((SELECT sum(n) FROM n) - 1) * o / e, 6) AS alpha FROM o, e"""


@query(_alpha_sql("1"))
def alpha_nominal(spark, d):
    return ag.alpha(_ratings(spark, d)).select(F.round("alpha", 6).alias("alpha"))


@query(_alpha_sql("((a - b) * (a - b))"))
def alpha_interval(spark, d):
    return ag.alpha(_ratings(spark, d), ag.interval_distance).select(F.round("alpha", 6).alias("alpha"))


@query(_alpha_sql("((a - b) * (a - b)::DOUBLE / ((a + b) * (a + b)))"))
def alpha_ratio(spark, d):
    return ag.alpha(_ratings(spark, d), ag.ratio_distance).select(F.round("alpha", 6).alias("alpha"))


@query("""WITH r AS (SELECT l_returnflag AS c, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT c, count(*) AS n, round(min(v), 4) AS lo, round(max(v), 4) AS hi, round(max(v) FILTER (k = n // 2 + 1), 4) AS median, round(avg(v), 3) AS mean, round(stddev_pop(v), 3) AS sd FROM r GROUP BY c""")
def basic_stats(spark, d):
    s = ag.basic_stats(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("c"), F.col("l_extendedprice").alias("v")), "v", "c")
    return s.select("c", "n", *[F.round(x, 4).alias(x) for x in ("lo", "hi", "median")], *[F.round(x, 3).alias(x) for x in ("mean", "sd")])


@query("""WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS k, count(*) OVER () AS n FROM orders)
SELECT count(*) AS n, round(min(v), 4) AS lo, round(max(v), 4) AS hi, round(max(v) FILTER (k = n // 2 + 1), 4) AS median, round(avg(v), 3) AS mean, round(stddev_pop(v), 3) AS sd FROM r""")
def basic_stats_overall(spark, d):
    s = ag.basic_stats(table(spark, d, "orders").select(F.col("o_totalprice").alias("v")), "v")
    return s.select("n", *[F.round(x, 4).alias(x) for x in ("lo", "hi", "median")], *[F.round(x, 3).alias(x) for x in ("mean", "sd")])


@query("SELECT trunc(value / 2.5::DOUBLE) * 2.5::DOUBLE AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram(spark, d):
    return ag.histogram(table(spark, d, "events"), "value", 2.5)


@query("SELECT l_quantity AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_distinct(spark, d):
    return ag.histogram(table(spark, d, "lineitem"), "l_quantity")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem")
def pearson(spark, d):
    return ag.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("pearson", 6).alias("pearson"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS b FROM lineitem)
SELECT round(1 - 6 * sum((a - b) * (a - b)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 6) AS spearman FROM r""")
def spearman(spark, d):
    return ag.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount").select(F.round("spearman", 6).alias("spearman"))


@query("SELECT event_id, CASE WHEN value > 40 THEN 1 WHEN value > 20 THEN 2 WHEN value > 5 THEN 3 ELSE 0 END::DOUBLE AS category FROM events")
def categorize(spark, d):
    return table(spark, d, "events").select("event_id", ag.categorize(F.col("value"), [5.0, 20.0, 40.0]).alias("category"))


@query("""WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 5 AS st FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice > lo + st * 4 THEN 1 WHEN o_totalprice > lo + st * 3 THEN 2 WHEN o_totalprice > lo + st * 2 THEN 3 WHEN o_totalprice > lo + st * 1 THEN 4 ELSE 0 END::DOUBLE AS category FROM orders, s""")
def equidistant(spark, d):
    return ag.equidistant(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 4).select("o_orderkey", "category")


@query(f"""WITH {E_SQL}, t AS (SELECT utt_id, frame_idx AS pk, v AS peak FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY v DESC, frame_idx) AS k FROM e) WHERE k = 1),
f AS (SELECT e.utt_id, regr_slope(v, frame_idx) AS k, regr_intercept(v, frame_idx) AS b FROM e JOIN t ON t.utt_id = e.utt_id AND e.frame_idx <> t.pk GROUP BY e.utt_id)
SELECT utt_id, pk AS peak_at, round(peak - (k * pk + b), 5) AS prominence FROM t JOIN f USING (utt_id)""")
def peak_prominence(spark, d):
    rows = events(spark, d).select("utt_id", "frame_idx", F.col("x")[0].alias("v"))
    return ag.peak_prominence(rows, "utt_id", "frame_idx", "v").withColumn("prominence", F.round("prominence", 5))


@query("""WITH b AS (SELECT CAST(quality AS VARCHAR) AS c, CAST(1 - toxic AS VARCHAR) AS y FROM labels),
r AS (SELECT c AS class, count(*) AS n, count(*) FILTER (c = y) AS hit FROM b GROUP BY c), k AS (SELECT y AS class, count(*) AS g FROM b GROUP BY y),
x AS (SELECT r.class, n, hit / n AS recall, coalesce(hit / nullif(g, 0), 0) AS precision FROM r LEFT JOIN k ON k.class = r.class),
f AS (SELECT *, coalesce(2 * recall * precision / nullif(recall + precision, 0), 0) AS f FROM x)
SELECT class, n, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f, 6) AS f FROM f
UNION ALL SELECT 'average', CAST(sum(n) AS BIGINT), round(avg(recall), 6), round(avg(precision), 6), round(avg(f), 6) FROM f""")
def confusion_report(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").alias("c"), (1 - F.col("toxic")).alias("y"))
    return ag.confusion(rows, "c", "y").select("class", "n", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f")])


@query(f"""WITH {V_SQL}, o AS (SELECT utt_id, frame_idx, dim, v FROM vl)
SELECT CAST(a.dim AS INTEGER) AS dim, round(avg(a.v), 6) + 0.0 AS mean_a, round(avg(b.v), 6) + 0.0 AS mean_b, round(avg(abs(a.v - b.v)), 6) AS mean_abs
FROM o a JOIN o b ON b.utt_id = (a.utt_id + 1) % 10 AND a.frame_idx = b.frame_idx AND a.dim = b.dim GROUP BY a.dim""")
def distance_files(spark, d):
    v = vectors(spark, d)
    other = v.select(((F.col("utt_id") + 9) % 10).alias("utt_id"), "frame_idx", "x")
    s = ag.compare_streams(v, other)
    return s.select("dim", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean_a", "mean_b", "mean_abs")])


@query("""SELECT source, CAST(sum(n_chars) AS BIGINT) AS n_samples, printf('%02d:%02d:%02d', sum(n_chars) // 100 // 3600, sum(n_chars) // 100 % 3600 // 60, sum(n_chars) // 100 % 60) AS length FROM documents GROUP BY ROLLUP (source)""")
def duration_rollup(spark, d):
    return ag.durations(table(spark, d, "documents"), "source", "n_chars", 100)


@query(f"WITH {L_SQL} SELECT c, CAST(dim AS INTEGER) AS dim, count(*) AS n, round(avg(v), 4) AS mean FROM ll GROUP BY c, dim")
def class_means(spark, d):
    long = lines(spark, d).select("c", F.posexplode("x").alias("dim", "v"))
    return long.groupBy("c", "dim").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


@query(f"WITH {V_SQL}, m AS (SELECT dim, avg(v) AS m FROM vl GROUP BY dim) SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(v - m, 6) + 0.0 AS v FROM vl JOIN m USING (dim)")
def sample_mean_subtract(spark, d):
    from strideframe.operators import context as cx, frames as fr

    centred = cx.mvn(vectors(spark, d).withColumn("utt_id", F.col("vec_id")), per_utterance=False, variances=False)
    return fr.long_form(centred, "vec_id").select("vec_id", "dim", "v")
