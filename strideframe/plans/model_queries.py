"""Catalogue: Gaussians, mixtures, clustering, transforms, hidden Markov models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strideframe.operators import acoustic as ac, frames as fr, gaussians as gm, hmm, transforms as tr
from strideframe.plans.common import E_SQL, L_SQL, V_SQL, events, lines, vectors

Q, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


# Fixed parameters of the queries that SQL can follow: three components over all 64 dimensions, by rule.
D = 64
MODEL = gm.Mixture([0.5, 0.3, 0.2], [[0.02 * ((i + k) % 3 - 1) for i in range(D)] for k in range(3)], [[0.01 + 0.005 * ((i + 2 * k) % 3) for i in range(D)] for k in range(3)], "ubm")
OTHER = gm.Mixture([0.4, 0.4, 0.2], [[0.01 * ((2 * i + k) % 5 - 2) for i in range(D)] for k in range(3)], [[0.016] * D] * 3, "spk")
# Two components of half a vector each, as a mean supervector has them.
HALVES = gm.Mixture([0.6, 0.4], np.zeros((2, D // 2)), [[0.01 + 0.002 * ((i + k) % 4) for i in range(D // 2)] for k in range(2)])


def _values(name: str, m: gm.Mixture) -> str:
    rows = ", ".join(f"({k}, {i}, {float(m.weights[k])!r}::DOUBLE, {float(m.means[k][i])!r}::DOUBLE, {float(m.covs[k][i])!r}::DOUBLE)" for k in range(len(m.weights)) for i in range(m.means.shape[1]))
    return f"{name}(k, dim, w, mu, var) AS (VALUES {rows})"


def _parts(name: str, m: gm.Mixture) -> str:
    return f"""{_values("p" + name, m)}, {name} AS (SELECT vec_id, utt_id, c, k, any_value(w) AS w, ln(any_value(w)) - 0.5::DOUBLE * (sum(ln(var)) + {D} * ln(2 * pi()) + sum((v - mu) * (v - mu) / var)) AS lp
  FROM vl JOIN p{name} USING (dim) GROUP BY vec_id, utt_id, c, k)"""


_A = _parts("a", MODEL)
_POST = "g AS (SELECT *, exp(lp - mx) / sum(exp(lp - mx)) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, max(lp) OVER (PARTITION BY vec_id) AS mx FROM a))"


@query(f"WITH {V_SQL}, {_A} SELECT vec_id, round(lp - ln(w), 6) + 0.0 AS lp FROM a WHERE k = 0")
def gauss_logdensity(spark, d):
    return vectors(spark, d).select("vec_id", (F.round(gm.log_density(F.col("x"), MODEL.means[0], MODEL.covs[0]), 6) + F.lit(0.0)).alias("lp"))


@query(f"WITH {V_SQL}, {_A} SELECT vec_id, round(max(lp) + ln(sum(exp(lp - mx))), 6) + 0.0 AS score FROM (SELECT *, max(lp) OVER (PARTITION BY vec_id) AS mx FROM a) GROUP BY vec_id")
def gmm_score_fixed(spark, d):
    return vectors(spark, d).select("vec_id", (F.round(gm.log_score(F.col("x"), MODEL), 6) + F.lit(0.0)).alias("score"))


@query(f"WITH {V_SQL}, {_A}, {_POST} SELECT vec_id, k, round(p, 6) AS p FROM g")
def gmm_posteriors_fixed(spark, d):
    return vectors(spark, d).select("vec_id", F.posexplode(gm.posteriors(F.col("x"), MODEL)).alias("k", "p")).withColumn("p", F.round("p", 6))


@query(f"WITH {V_SQL}, {_A} SELECT vec_id, arg_max(k, lp) AS with_priors, arg_max(k, lp - ln(w)) AS without FROM a GROUP BY vec_id")
def gmm_classify(spark, d):
    x = F.col("x")
    return vectors(spark, d).select("vec_id", gm.classify(x, MODEL).alias("with_priors"), gm.classify(x, MODEL, priors=False).alias("without"))


def _model_rows(spark, m: gm.Mixture):
    rows = [(k, i, round(float(m.weights[k]), 6), round(float(m.means[k][i]), 6) + 0.0, round(float(m.covs[k][i]), 6)) for k in range(len(m.weights)) for i in range(m.means.shape[1])]
    return spark.createDataFrame(rows, "k int, dim int, w double, mu double, var double")


_ACC = f"""{_A}, {_POST}, s AS (SELECT g.k, vl.dim, sum(p) AS occ, sum(p * v) AS s1, sum(p * v * v) AS s2, sum(sum(p)) OVER (PARTITION BY vl.dim) AS n
  FROM g JOIN vl USING (vec_id) GROUP BY g.k, vl.dim)"""


@query(f"WITH {V_SQL}, {_ACC} SELECT k, CAST(dim AS INTEGER) AS dim, round(occ / n, 6) AS w, round(s1 / occ, 6) + 0.0 AS mu, round(greatest(s2 / occ - (s1 / occ) * (s1 / occ), 0.001::DOUBLE), 6) AS var FROM s")
def em_step_fixed(spark, d):
    return _model_rows(spark, gm.mle_update(MODEL, gm.accumulate(vectors(spark, d), MODEL)))


@query(f"""WITH {V_SQL}, {_ACC}, t AS (SELECT s.k, s.dim, occ / (16 + occ) AS al, occ, n, s1, s2, w, mu, var FROM s JOIN pa ON pa.k = s.k AND pa.dim = s.dim),
u AS (SELECT *, al * s1 / occ + (1 - al) * mu AS m, al * occ / n + (1 - al) * w AS ww FROM t)
SELECT k, CAST(dim AS INTEGER) AS dim, round(ww / sum(ww) OVER (PARTITION BY dim), 6) AS w, round(m, 6) + 0.0 AS mu, round(al * s2 / occ + (1 - al) * (var + mu * mu) - m * m, 6) AS var FROM u""")
def map_step_fixed(spark, d):
    return _model_rows(spark, gm.map_update(MODEL, gm.accumulate(vectors(spark, d), MODEL)))


@query(f"""WITH {V_SQL}, {_values("pa", HALVES)}, x AS (SELECT vec_id, utt_id, frame_idx, dim // {D // 2} AS k, dim % {D // 2} AS dim, v FROM vl)
SELECT a.vec_id, round(sum(w * (a.v - b.v) * (a.v - b.v) / var), 5) AS akl, round(sum(w * a.v * b.v / var), 5) + 0.0 AS kernel
FROM x a JOIN x b ON a.utt_id = b.utt_id AND a.frame_idx = b.frame_idx + 1 AND a.k = b.k AND a.dim = b.dim JOIN pa ON pa.k = a.k AND pa.dim = a.dim GROUP BY a.vec_id""")
def akl(spark, d):
    v = vectors(spark, d)
    both = v.join(v.select("utt_id", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("x").alias("y")), ["utt_id", "frame_idx"])
    a, b = F.col("x"), F.col("y")
    return both.select("vec_id", F.round(gm.akl(a, b, HALVES), 5).alias("akl"), (F.round(gm.akl(a, b, HALVES, kernel=True), 5) + F.lit(0.0)).alias("kernel"))


@query(f"""WITH {V_SQL}, m AS (SELECT c, dim, avg(v) AS mu, greatest(var_pop(v), 1e-10) AS var FROM vl GROUP BY c, dim)
SELECT c, 0 AS i, 1.0::DOUBLE AS v FROM m GROUP BY c UNION ALL SELECT c, CAST(1 + dim AS INTEGER), round(mu, 6) + 0.0 FROM m UNION ALL SELECT c, CAST({D + 1} + dim AS INTEGER), round(var, 6) FROM m""")
def supervector(spark, d):
    """Weights, means and variances of each label's Gaussian, as an expression over stored models."""
    from strideframe.sources import models as md

    stored = md.mixtures_frame(spark, {str(k[0]): gm._from_groups([g]) for k, g in gm.second_order(vectors(spark, d), "c").items()})
    rows = md.supervectors(stored, True, True, True).select(F.col("model_id").cast("int").alias("c"), F.posexplode("x").alias("i", "v"))
    return rows.withColumn("v", F.round("v", 6) + F.lit(0.0))


@query(f"""WITH {V_SQL}, {_values("pa", MODEL)}, a AS (SELECT vec_id, k, ln(any_value(w)) - 0.5::DOUBLE * (sum(ln(var)) + {D - 1} * ln(2 * pi()) + sum((v - mu) * (v - mu) / var)) AS lp
  FROM vl JOIN pa USING (dim) WHERE dim <> 1 GROUP BY vec_id, k)
SELECT vec_id, round(max(lp) + ln(sum(exp(lp - mx))), 6) + 0.0 AS score FROM (SELECT *, max(lp) OVER (PARTITION BY vec_id) AS mx FROM a) GROUP BY vec_id""")
def marginalise(spark, d):
    kept = [i for i in range(D) if i != 1]
    x = F.concat(F.slice("x", 1, 1), F.slice("x", 3, D))
    return vectors(spark, d).select("vec_id", (F.round(gm.log_score(x, MODEL.marginalize(kept)), 6) + F.lit(0.0)).alias("score"))


_SCORES = f"""{_A}, {_parts("b", OTHER)}, s AS (
  SELECT utt_id, 'ubm' AS model_id, max(lp) + ln(sum(exp(lp - mx))) AS score FROM (SELECT *, max(lp) OVER (PARTITION BY vec_id) AS mx FROM a) GROUP BY vec_id, utt_id
  UNION ALL SELECT utt_id, 'spk', max(lp) + ln(sum(exp(lp - mx))) FROM (SELECT *, max(lp) OVER (PARTITION BY vec_id) AS mx FROM b) GROUP BY vec_id, utt_id)"""


def _scored(spark, d):
    return gm.score_frames(vectors(spark, d), {"ubm": MODEL, "spk": OTHER})


@query(f"""WITH {V_SQL}, {_SCORES} SELECT 'spk' AS model_id, utt_id, round((sum(score) FILTER (model_id = 'spk') - sum(score) FILTER (model_id = 'ubm')) / (count(*) / 2), 6) + 0.0 AS llr FROM s GROUP BY utt_id""")
def llr_trials(spark, d):
    trials = vectors(spark, d).select("utt_id").distinct().withColumn("model_id", F.lit("spk"))
    return gm.llr_trials(trials, _scored(spark, d)).withColumn("llr", F.round("llr", 6) + F.lit(0.0))


@query(f"""WITH {V_SQL}, {_A}, {_parts("b", OTHER)}, t AS (SELECT a.vec_id, a.utt_id, a.lp AS u, b.lp AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY a.lp DESC, a.k) AS r FROM a JOIN b USING (vec_id, k))
SELECT 'spk' AS model_id, utt_id, round(avg(d), 6) + 0.0 AS llr FROM (SELECT vec_id, utt_id, ln(sum(exp(s))) - ln(sum(exp(u))) AS d FROM t WHERE r <= 2 GROUP BY vec_id, utt_id) GROUP BY utt_id""")
def llr_trials_fast(spark, d):
    trials = vectors(spark, d).select("utt_id").distinct().withColumn("model_id", F.lit("spk"))
    return gm.fast_llr(trials, vectors(spark, d), {"spk": OTHER}, MODEL, 2).withColumn("llr", F.round("llr", 6) + F.lit(0.0))


@query(f"""WITH {V_SQL}, {_SCORES}, m AS (SELECT utt_id, model_id, avg(score) AS mean FROM s GROUP BY utt_id, model_id)
SELECT utt_id, model_id, round(mean, 6) + 0.0 AS mean, round(exp(mean - max(mean) OVER w) / sum(exp(mean)) OVER w * exp(max(mean) OVER w), 6) AS p, first_value(model_id) OVER (PARTITION BY utt_id ORDER BY mean DESC, model_id) AS best FROM m WINDOW w AS (PARTITION BY utt_id)""")
def segment_posteriors(spark, d):
    return gm.segment_posteriors(_scored(spark, d)).withColumn("mean", F.round("mean", 6) + F.lit(0.0)).withColumn("p", F.round("p", 6))


@query(f"WITH {V_SQL} SELECT c, CAST(dim AS INTEGER) AS dim, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(var_pop(v), 6) AS var FROM vl GROUP BY c, dim")
def ml_gaussian_diag(spark, d):
    m = gm.moments(vectors(spark, d), "c")
    return m.select("c", "dim", "n", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), F.round("var", 6).alias("var"))


@query(f"""WITH {L_SQL} SELECT c, i, j, round(covar_pop(x[i + 1], x[j + 1]), 3) + 0.0 AS cov FROM l, LATERAL unnest(generate_series(0, 3)) AS t(i), LATERAL unnest(generate_series(0, i)) AS u(j) GROUP BY c, i, j""".replace("SELECT c, i, j,", "SELECT c, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,"))
def ml_gaussian_full(spark, d):
    return gm.covariances(lines(spark, d), 4, "c").withColumn("cov", F.round("cov", 3) + F.lit(0.0))


@query(f"""WITH {V_SQL}, k AS (SELECT a.c, a.dim AS i, b.dim AS j, count(*) AS n, covar_pop(a.v, b.v) AS w, avg(a.v) AS mp, avg(b.v) AS mr FROM vl a JOIN vl b USING (vec_id) GROUP BY a.c, a.dim, b.dim),
g AS (SELECT dim, avg(v) AS m, count(*) AS nn FROM vl GROUP BY dim)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(n * w) / any_value(p.nn), 6) + 0.0 AS within, round(sum(n * (mp - p.m) * (mr - q.m)) / any_value(p.nn), 6) + 0.0 AS between
FROM k JOIN g p ON p.dim = i JOIN g q ON q.dim = j GROUP BY i, j""")
def scatter_within_between(spark, d):
    _, within, between, _ = tr.scatter(vectors(spark, d))
    return spark.createDataFrame([(i, j, round(float(within[i, j]), 6) + 0.0, round(float(between[i, j]), 6) + 0.0) for i in range(D) for j in range(D)], "i int, j int, within double, between double")


@query(f"""WITH {V_SQL}, y AS (SELECT vec_id, sum(v - 0.01::DOUBLE) AS a, sum((v - 0.01::DOUBLE) * (dim % 2 * 2 - 1)) AS b FROM vl GROUP BY vec_id)
SELECT vec_id, CAST(k AS INTEGER) AS dim, round(CASE WHEN k = 0 THEN a ELSE b END, 6) + 0.0 AS v FROM y, LATERAL unnest(generate_series(0, 1)) AS t(k)""")
def projection(spark, d):
    p = tr.Projection(np.full(D, 0.01), np.array([[1.0] * D, [i % 2 * 2.0 - 1 for i in range(D)]]))
    return fr.long_form(p.apply(vectors(spark, d)), "vec_id").select("vec_id", "dim", "v")


_MEANS = [[0.1 * ((i + k) % 3 - 1) for i in range(D)] for k in range(3)]


@query(f"""WITH {V_SQL}, m(k, dim, mu) AS (VALUES {", ".join(f"({k}, {i}, {v!r}::DOUBLE)" for k, m in enumerate(_MEANS) for i, v in enumerate(m))}),
s AS (SELECT vec_id, k, sum((v - mu) * (v - mu)) AS s FROM vl JOIN m USING (dim) GROUP BY vec_id, k) SELECT vec_id, arg_min(k, s) AS k FROM s GROUP BY vec_id""")
def kmeans_assign_fixed(spark, d):
    return vectors(spark, d).select("vec_id", gm.nearest(F.col("x"), _MEANS).alias("k"))


@query(f"""WITH {V_SQL} SELECT vec_id, CAST(dim AS INTEGER) AS dim, CAST(row_number() OVER (PARTITION BY dim ORDER BY v, vec_id) AS INTEGER) AS i, round((v - avg(v) OVER (PARTITION BY dim)) / stddev_pop(v) OVER (PARTITION BY dim), 6) + 0.0 AS z FROM vl""")
def anderson_darling_order(spark, d):
    rows = vectors(spark, d).select("vec_id", F.posexplode("x").alias("dim", "v"))
    w = hmm.Window.partitionBy("dim")
    z = (F.col("v") - F.avg("v").over(w)) / F.stddev_pop("v").over(w)
    return rows.select("vec_id", "dim", F.row_number().over(w.orderBy("v", "vec_id")).alias("i"), (F.round(z, 6) + F.lit(0.0)).alias("z"))


@query(f"""WITH {V_SQL}, z AS (SELECT dim, v, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z, count(*) OVER w AS n, row_number() OVER (PARTITION BY dim ORDER BY v) AS i FROM vl WINDOW w AS (PARTITION BY dim)),
t AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM z),
q AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS tail FROM t),
f AS (SELECT *, greatest(least(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END, 1 - 1e-15), 1e-15) AS p FROM q)
SELECT CAST(dim AS INTEGER) AS dim, n, round((-n - sum((2 * i - 1) * ln(p) + (2 * (n - i) + 1) * ln(1 - p)) / n) * (1 + 4 / n::DOUBLE - 25 / (n::DOUBLE * n)), 4) AS a2 FROM f GROUP BY dim, n""")
def anderson_darling(spark, d):
    long = vectors(spark, d).select(F.posexplode("x").alias("dim", "v"))
    return gm.anderson_darling(long, "v", "dim").withColumn("a2", F.round("a2", 4))


# A start that deals vectors round to three components, then steps over all 64 dimensions.
_START = f"""{V_SQL}, nu AS (SELECT vec_id, (row_number() OVER (ORDER BY utt_id, frame_idx) - 1) % 3 AS k FROM vv),
g0 AS MATERIALIZED (SELECT k, dim, count(*) / sum(count(*)) OVER (PARTITION BY dim) AS w, avg(v) AS mu, greatest(avg(v * v) - avg(v) * avg(v), 1e-10) AS var FROM vl JOIN nu USING (vec_id) GROUP BY k, dim)"""


def _em_sql(steps: int) -> str:
    out = _START
    for i in range(steps):
        out += f""", l{i} AS (SELECT vec_id, k, ln(any_value(w)) + greatest(-0.5::DOUBLE * (sum(ln(var)) + 64 * ln(2 * pi()) + sum((v - mu) * (v - mu) / var)), ln(1e-256)) AS lp FROM vl JOIN g{i} USING (dim) GROUP BY vec_id, k),
r{i} AS MATERIALIZED (SELECT vec_id, k, exp(lp - mx) / sum(exp(lp - mx)) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, max(lp) OVER (PARTITION BY vec_id) AS mx FROM l{i})),
g{i + 1} AS MATERIALIZED (SELECT k, dim, sum(p) / sum(sum(p)) OVER (PARTITION BY dim) AS w, sum(p * v) / sum(p) AS mu, greatest(sum(p * v * v) / sum(p) - power(sum(p * v) / sum(p), 2), 0.001::DOUBLE) AS var FROM vl JOIN r{i} USING (vec_id) GROUP BY k, dim)"""
    return out


def _kmeans_sql(steps: int) -> str:
    out = _START
    for i in range(steps):
        out += f""", c{i} AS MATERIALIZED (SELECT vec_id, arg_min(k, s) AS k FROM (SELECT vec_id, k, sum((v - mu) * (v - mu)) AS s FROM vl JOIN g{i} USING (dim) GROUP BY vec_id, k) GROUP BY vec_id),
g{i + 1} AS MATERIALIZED (SELECT k, dim, count(*) / sum(count(*)) OVER (PARTITION BY dim) AS w, avg(v) AS mu, greatest(avg(v * v) - avg(v) * avg(v), 1e-10) AS var FROM vl JOIN c{i} USING (vec_id) GROUP BY k, dim)"""
    return out


_ROWS = "SELECT CAST(k AS INTEGER) AS k, CAST(dim AS INTEGER) AS dim, round(w, 6) AS w, round(mu, 6) + 0.0 AS mu, round(var, 6) AS var FROM g"


@query(f"WITH {_em_sql(3)} {_ROWS}3")
def em(spark, d):
    x = vectors(spark, d).persist()
    model, _ = gm.em(x, gm.partitioned_init(x, 3, "uniform"), 3)
    x.unpersist()
    return _model_rows(spark, model)


@query()
def em_full(spark, d):
    x = vectors(spark, d).persist()
    start = gm.partitioned_init(x, 3, "uniform")
    model, _ = gm.em(x, gm.Mixture(start.weights, start.means, np.array([np.diag(c) for c in start.covs])), 2)
    x.unpersist()
    k, n = model.means.shape
    return spark.createDataFrame([(c, i, j, round(float(model.covs[c, i, j]), 6)) for c in range(k) for i in range(n) for j in range(n)], "k int, i int, j int, cov double")


@query(f"WITH {_kmeans_sql(10)} {_ROWS}10")
def kmeans(spark, d):
    x = vectors(spark, d).persist()
    model = gm.kmeans(x, gm.partitioned_init(x, 3, "uniform"), 10)
    x.unpersist()
    return _model_rows(spark, model)


def _lbg_sql(size: int, steps: int = 20, eps: float = 0.05, conv: float = 1e-3) -> str:
    """The heaviest cell gives way to m (1 + eps) and m (1 - eps) behind the others; then k-means until the means move no further than ``conv``."""
    stats = "count(*) / sum(count(*)) OVER (PARTITION BY dim) AS w, avg(v) AS mu, greatest(avg(v * v) - avg(v) * avg(v), 1e-10) AS var"
    out = f"{V_SQL}, r1 AS MATERIALIZED (SELECT 0 AS k, dim, {stats} FROM vl GROUP BY dim)"
    for n in range(1, size):
        out += f""", h{n} AS (SELECT first(k ORDER BY w DESC, k) AS h FROM r{n} WHERE dim = 0),
z{n}x0 AS MATERIALIZED (SELECT CASE WHEN k > h THEN k - 1 ELSE k END AS k, dim, w, mu, var FROM r{n}, h{n} WHERE k <> h UNION ALL SELECT {n - 1}, dim, w, mu * (1 + {eps}::DOUBLE), var FROM r{n}, h{n} WHERE k = h
  UNION ALL SELECT {n}, dim, w, mu * (1 - {eps}::DOUBLE), var FROM r{n}, h{n} WHERE k = h), d{n}x0 AS (SELECT false AS done)"""
        for i in range(steps):
            g, new = f"z{n}x{i}", f"z{n}x{i + 1}"
            out += f""", c{n}x{i} AS MATERIALIZED (SELECT vec_id, arg_min(k, s) AS k FROM (SELECT vec_id, k, sum((v - mu) * (v - mu)) AS s FROM vl JOIN {g} USING (dim) GROUP BY vec_id, k) GROUP BY vec_id),
n{n}x{i} AS MATERIALIZED (SELECT k, dim, {stats} FROM vl JOIN c{n}x{i} USING (vec_id) GROUP BY k, dim),
{new} AS MATERIALIZED (SELECT a.k, a.dim, CASE WHEN done THEN b.w ELSE a.w END AS w, CASE WHEN done THEN b.mu ELSE a.mu END AS mu, CASE WHEN done THEN b.var ELSE a.var END AS var FROM n{n}x{i} a JOIN {g} b USING (k, dim), d{n}x{i}),
d{n}x{i + 1} AS MATERIALIZED (SELECT any_value(done) OR sum(s) <= {conv} AS done FROM d{n}x{i}, (SELECT sqrt(sum((a.mu - b.mu) * (a.mu - b.mu))) AS s FROM {new} a JOIN {g} b USING (k, dim) GROUP BY k))"""
        out += f", r{n + 1} AS MATERIALIZED (SELECT * FROM z{n}x{steps})"
    return out


@query(f"WITH {_lbg_sql(4)} {_ROWS.replace('FROM g', 'FROM r4')}")
def lbg(spark, d):
    x = vectors(spark, d).persist()
    model = gm.lbg(x, 4)
    x.unpersist()
    return _model_rows(spark, model)


@query()
def hier_clustering(spark, d):
    x = vectors(spark, d).persist()
    model = gm.hierarchical(x, 4)
    x.unpersist()
    return _model_rows(spark, model)


@query()
def gmeans(spark, d):
    x = vectors(spark, d).select("x").repartition(spark.sparkContext.defaultParallelism).persist()
    model = gm.gmeans(x, 0.05, 3)
    x.unpersist()
    return _model_rows(spark, model)


# The numerator of a model sums its own segments, the denominator all of them by the softmax of twice their mean scores.
_MMIE = f"""{V_SQL}, {_A}, {_parts("b", OTHER)}, m AS (SELECT 'ubm' AS id, * FROM a UNION ALL SELECT 'spk', * FROM b),
pm AS (SELECT 'ubm' AS id, * FROM pa UNION ALL SELECT 'spk', * FROM pb),
q AS MATERIALIZED (SELECT id, vec_id, utt_id, k, exp(lp - mx) / sum(exp(lp - mx)) OVER w AS p, CASE WHEN k = 0 THEN mx + ln(sum(exp(lp - mx)) OVER w) END AS score
  FROM (SELECT *, max(lp) OVER (PARTITION BY id, vec_id) AS mx FROM m) WINDOW w AS (PARTITION BY id, vec_id)),
sc AS (SELECT id, utt_id, 2 * avg(score) AS s FROM q GROUP BY id, utt_id),
po AS (SELECT id, utt_id, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY utt_id) AS z FROM (SELECT *, max(s) OVER (PARTITION BY utt_id) AS mx FROM sc)),
st AS (SELECT id, k, dim, sum(CASE WHEN id = CASE WHEN utt_id % 2 = 0 THEN 'ubm' ELSE 'spk' END THEN p ELSE 0 END) AS n, sum(z * p) AS d,
  sum((CASE WHEN id = CASE WHEN utt_id % 2 = 0 THEN 'ubm' ELSE 'spk' END THEN p ELSE 0 END - z * p) * v) AS s1, sum((CASE WHEN id = CASE WHEN utt_id % 2 = 0 THEN 'ubm' ELSE 'spk' END THEN p ELSE 0 END - z * p) * v * v) AS s2
  FROM q JOIN po USING (id, utt_id) JOIN (SELECT vec_id, dim, v FROM vl) x USING (vec_id) GROUP BY id, k, dim)"""


@query(f"""WITH {_MMIE},
tr AS (SELECT st.*, w, mu, var, i, greatest(d, 1e-6) * power(1.1::DOUBLE, i) AS big FROM st JOIN pm USING (id, k, dim), (SELECT unnest(generate_series(0, 99)) AS i)),
ok AS (SELECT id, k, min(i) AS i FROM (SELECT id, k, i FROM tr GROUP BY id, k, i HAVING bool_and(n - d + big > 0 AND (s2 + big * (var + mu * mu)) / (n - d + big) - power((s1 + big * mu) / (n - d + big), 2) > 0)) GROUP BY id, k)
SELECT id AS model_id, CAST(k AS INTEGER) AS k, CAST(dim AS INTEGER) AS dim, round(w, 6) AS w, round((s1 + 2 * big * mu) / (n - d + 2 * big), 6) + 0.0 AS mu,
  round((s2 + 2 * big * (var + mu * mu)) / (n - d + 2 * big) - power((s1 + 2 * big * mu) / (n - d + 2 * big), 2), 6) AS var FROM tr JOIN ok USING (id, k, i)""")
def mmie_step(spark, d):
    """One update of both models by all segments; segments of even labels belong to the first, of odd ones to the other."""
    models = {"ubm": MODEL, "spk": OTHER}
    x = vectors(spark, d).withColumn("c", F.when(F.col("utt_id") % 2 == 0, "ubm").otherwise("spk"))
    stats = gm.mmie_accumulate(x, models)
    rows = [_model_rows(spark, gm.extended_update(m, *stats[name])).select(F.lit(name).alias("model_id"), "*") for name, m in models.items()]
    return rows[0].union(rows[1])


# The axes and values multiply out to the covariance, and the axes are orthonormal.
@query(f"""WITH {V_SQL}, q AS (SELECT a.dim AS i, b.dim AS j, covar_pop(a.v, b.v) AS v FROM vl a JOIN vl b USING (vec_id) GROUP BY a.dim, b.dim)
SELECT 'covariance' AS part, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v, 6) + 0.0 AS v FROM q UNION ALL SELECT 'axes', CAST(i AS INTEGER), CAST(j AS INTEGER), CASE WHEN i = j THEN 1.0 ELSE 0.0 END FROM q""")
def pca(spark, d):
    p = tr.pca(vectors(spark, d))
    whole, gram = (p.axes.T * p.values) @ p.axes, p.axes @ p.axes.T
    n = len(gram)
    rows = [(part, i, j, round(float(m[i, j]), 6) + 0.0) for part, m in (("covariance", whole), ("axes", gram)) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "part string, i int, j int, v double")


@query()
def lda(spark, d):
    p = tr.lda(vectors(spark, d), 3)
    return tr.axes_frame(spark, p).withColumn("v", F.round("v", 4) + F.lit(0.0))


@query()
def sparse_pca(spark, d):
    p = tr.sparse_pca(vectors(spark, d), 5)
    return tr.axes_frame(spark, p).withColumn("v", F.round("v", 4) + F.lit(0.0))


@query()
def nap(spark, d):
    v = vectors(spark, d).select("utt_id", "frame_idx", "x", "c")
    return fr.long_form(tr.nap(v, 4).apply(v), digits=4)


@query()
def mnap(spark, d):
    v = vectors(spark, d).select("utt_id", "frame_idx", "x", "c")
    return fr.long_form(tr.apply_mnap(v, tr.mnap(v, 2, 16), 16), digits=4)


@query(f"""WITH {E_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY utt_id) AS n FROM e)
SELECT utt_id, frame_idx, CAST(CASE WHEN frame_idx >= floor(3 * n / 4 + 0.5::DOUBLE) THEN 3 WHEN frame_idx >= floor(2 * n / 4 + 0.5::DOUBLE) THEN 2 WHEN frame_idx >= floor(n / 4 + 0.5::DOUBLE) THEN 1 ELSE 0 END AS INTEGER) AS state FROM n WHERE n >= 4""")
def linear_alignment(spark, d):
    return hmm.linear_align(events(spark, d), 4)


_COUNTS = f"{E_SQL}, c AS (SELECT event_type AS i, lead(event_type) OVER (PARTITION BY utt_id ORDER BY frame_idx) AS j FROM e), k AS (SELECT i, j, count(*) AS n FROM c WHERE j IS NOT NULL GROUP BY i, j)"


@query(f"WITH {_COUNTS} SELECT i, j, n FROM k")
def viterbi_counts(spark, d):
    return hmm.transition_counts(events(spark, d, "event_type"), "event_type")


@query(f"WITH {_COUNTS} SELECT i, j, round(n / sum(n) OVER (PARTITION BY i), 6) AS p FROM k")
def transition_normalise(spark, d):
    return hmm.normalise(hmm.transition_counts(events(spark, d, "event_type"), "event_type")).withColumn("p", F.round("p", 6))


@query(f"WITH {_COUNTS} SELECT i, j, round(0.3::DOUBLE * n / sum(n) OVER (PARTITION BY i) + 0.7::DOUBLE / 5, 6) AS p FROM k")
def interp_params(spark, d):
    return hmm.normalise(hmm.transition_counts(events(spark, d, "event_type"), "event_type")).withColumn("p", F.round(0.3 * F.col("p") + F.lit(0.7) / 5, 6))


@query(f"WITH {E_SQL} SELECT event_type AS i, count(*) AS n FROM e WHERE frame_idx = 0 GROUP BY event_type")
def start_counts(spark, d):
    return hmm.start_counts(events(spark, d, "event_type"), "event_type")


_SYMBOLS = ("click", "error", "login", "purchase", "view")


def _discrete(spark, d):
    code = F.coalesce(*[F.when(F.col("event_type") == s, float(i)) for i, s in enumerate(_SYMBOLS)], F.lit(0.0))
    return events(spark, d, "event_type").select("utt_id", "frame_idx", F.array(code).alias("x"))


def _hmm():
    b = np.array([[0.5, 0.2, 0.1, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3], [0.2, 0.2, 0.2, 0.2, 0.2]])
    return hmm.Hmm(np.array([0.8, 0.1, 0.1]), np.array([[0.6, 0.3, 0.1], [0.2, 0.6, 0.2], [0.1, 0.2, 0.7]]), symbols=b)


_D_SQL = f"{E_SQL}, x AS (SELECT utt_id, frame_idx AS t, CASE event_type WHEN 'error' THEN 1 WHEN 'login' THEN 2 WHEN 'purchase' THEN 3 WHEN 'view' THEN 4 ELSE 0 END AS o, count(*) OVER (PARTITION BY utt_id) AS n FROM e)"


def _model_sql(pi, a, b) -> str:
    """Tables of logarithms, without what is impossible: hp (state, start), ha (from, to), hb (state, symbol)."""
    number = lambda v: f"ln({float(v)!r}::DOUBLE)"
    start = ", ".join(f"({j}, {number(v)})" for j, v in enumerate(pi) if v > 0)
    moves = ", ".join(f"({i}, {j}, {number(v)})" for i, row in enumerate(a) for j, v in enumerate(row) if v > 0)
    emit = ", ".join(f"({j}, {o}, {number(v)})" for j, row in enumerate(b) for o, v in enumerate(row))
    return f"hp(j, lp) AS (VALUES {start}), ha(i, j, la) AS (VALUES {moves}), hb(j, o, lb) AS (VALUES {emit})"


# Best scores forwards with the state before (the lowest of equals), then the path backwards from its end.
_FORWARD = """vf(utt_id, t, j, s, back) AS (SELECT utt_id, t, j, lp + lb, -1 FROM x JOIN hb USING (o) JOIN hp USING (j) WHERE t = 0
  UNION ALL SELECT x.utt_id, x.t, hb.j, m.s + hb.lb, m.back FROM (SELECT utt_id, t + 1 AS t, ha.j, max(s + la) AS s, first(vf.j ORDER BY s + la DESC, vf.j) AS back FROM vf JOIN ha ON ha.i = vf.j GROUP BY utt_id, t, ha.j) m
  JOIN x ON x.utt_id = m.utt_id AND x.t = m.t JOIN hb ON hb.j = m.j AND hb.o = x.o)"""


def _path_sql(end: str) -> str:
    return f"""ve AS (SELECT vf.utt_id, vf.t, first(j ORDER BY s DESC, j) AS j, max(s) AS score FROM vf JOIN x USING (utt_id, t) WHERE t = n - 1 {end} GROUP BY vf.utt_id, vf.t),
vb(utt_id, t, j, score) AS (SELECT * FROM ve UNION ALL SELECT vb.utt_id, vb.t - 1, vf.back, vb.score FROM vb JOIN vf USING (utt_id, t, j) WHERE vb.t > 0)"""


_ALIGNED = "SELECT utt_id, t AS frame_idx, CAST(j AS INTEGER) AS state, round(score, 4) AS score FROM vb"


@query(f"WITH RECURSIVE {_D_SQL}, {_model_sql(_hmm().pi, _hmm().a, _hmm().symbols)}, {_FORWARD}, {_path_sql('')} {_ALIGNED}")
def viterbi_decode(spark, d):
    return hmm.align(_discrete(spark, d), _hmm()).withColumn("score", F.round("score", 4))


@query(f"WITH RECURSIVE {_D_SQL}, {_model_sql([1, 0, 0], hmm.topology(3, 'LINEAR'), _hmm().symbols)}, {_FORWARD}, {_path_sql('AND j = 2 AND n >= 3')} {_ALIGNED}")
def viterbi_forced(spark, d):
    m = _hmm()
    return hmm.align(_discrete(spark, d), hmm.Hmm(np.array([1.0, 0, 0]), hmm.topology(3, "LINEAR"), symbols=m.symbols), forced=True).withColumn("score", F.round("score", 4))


def _baum_welch_sql(m, steps: int) -> str:
    """Scaled forward sums; the states' probabilities backwards from them; their sums over their rows' sums."""
    start = ", ".join(f"({j}, {float(v)!r}::DOUBLE)" for j, v in enumerate(m.pi))
    moves = ", ".join(f"({i}, {j}, {float(v)!r}::DOUBLE)" for i, row in enumerate(m.a) for j, v in enumerate(row))
    emit = ", ".join(f"({j}, {o}, {float(v)!r}::DOUBLE)" for j, row in enumerate(m.symbols) for o, v in enumerate(row))
    out = f"WITH RECURSIVE {_D_SQL}, p0(j, p) AS (VALUES {start}), a0(i, j, a) AS (VALUES {moves}), b0(j, o, b) AS (VALUES {emit})"
    for k in range(steps):
        out += f""", f{k}(utt_id, t, j, al) AS (SELECT utt_id, t, j, p * b / sum(p * b) OVER (PARTITION BY utt_id) FROM x JOIN b{k} USING (o) JOIN p{k} USING (j) WHERE t = 0
  UNION ALL SELECT utt_id, t, j, v / sum(v) OVER (PARTITION BY utt_id) FROM (SELECT x.utt_id, x.t, a{k}.j, sum(al * a) * any_value(b) AS v FROM f{k} JOIN a{k} ON a{k}.i = f{k}.j JOIN x ON x.utt_id = f{k}.utt_id AND x.t = f{k}.t + 1 JOIN b{k} ON b{k}.j = a{k}.j AND b{k}.o = x.o GROUP BY x.utt_id, x.t, a{k}.j)),
m{k} AS MATERIALIZED (SELECT utt_id, t, i, a{k}.j, al * a / sum(al * a) OVER (PARTITION BY utt_id, t, a{k}.j) AS q FROM f{k} JOIN a{k} ON a{k}.i = f{k}.j),
g{k}(utt_id, t, j, g) AS (SELECT utt_id, t, j, al FROM f{k} JOIN x USING (utt_id, t) WHERE t = n - 1
  UNION ALL SELECT m.utt_id, m.t, m.i, sum(g * q) FROM g{k} JOIN m{k} m ON m.utt_id = g{k}.utt_id AND m.t = g{k}.t - 1 AND m.j = g{k}.j GROUP BY m.utt_id, m.t, m.i),
w{k} AS MATERIALIZED (SELECT * FROM g{k}),
a{k + 1} AS MATERIALIZED (SELECT i, j, sum(v) / sum(sum(v)) OVER (PARTITION BY i) AS a FROM (SELECT m.i, m.j, w.g * q AS v FROM w{k} w JOIN m{k} m ON m.utt_id = w.utt_id AND m.t = w.t - 1 AND m.j = w.j) GROUP BY i, j),
p{k + 1} AS MATERIALIZED (SELECT j, sum(g) / sum(sum(g)) OVER () AS p FROM w{k} WHERE t = 0 GROUP BY j),
b{k + 1} AS MATERIALIZED (SELECT j, o, sum(g) / sum(sum(g)) OVER (PARTITION BY j) AS b FROM w{k} JOIN x USING (utt_id, t) GROUP BY j, o)"""
    return out + f" SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(a, 6) AS p FROM a{steps}"


@query(_baum_welch_sql(_hmm(), 2))
def baum_welch(spark, d):
    x = _discrete(spark, d).persist()
    model, _ = hmm.baum_welch(x, _hmm(), 2)
    x.unpersist()
    return spark.createDataFrame([(i, j, round(float(model.a[i, j]), 6)) for i in range(3) for j in range(3)], "i int, j int, p double")


def _words_sql() -> str:
    """The forward pass once for all words: states are (word, state)."""
    names = hmm.TOPOLOGIES
    b = _hmm().symbols
    a = np.zeros((12, 12))
    for k, name in enumerate(names):
        a[3 * k : 3 * k + 3, 3 * k : 3 * k + 3] = hmm.topology(3, name)
    words = ", ".join(f"({3 * k + 2}, '{name}')" for k, name in enumerate(names))
    return f"""WITH RECURSIVE {_D_SQL}, {_model_sql([1, 0, 0] * 4, a, np.vstack([b] * 4))}, {_FORWARD}, vw(j, word) AS (VALUES {words}),
r AS (SELECT utt_id, word, s, row_number() OVER (PARTITION BY utt_id ORDER BY s DESC, word) AS rank FROM vf JOIN x USING (utt_id, t) JOIN vw USING (j) WHERE t = n - 1 AND n >= 3)
SELECT utt_id, CAST(rank AS INTEGER) AS rank, word, round(s, 4) AS score FROM r WHERE rank <= 2"""


def _between_silence_sql() -> str:
    """Each word's three states between two of silence; a model's last state stays or goes on with 0.5."""
    names, b = hmm.TOPOLOGIES, _hmm().symbols
    a, emit, pi = np.zeros((20, 20)), [], []
    for k, name in enumerate(names):
        o = 5 * k
        a[o + 1 : o + 4, o + 1 : o + 4] = hmm.topology(3, name)
        a[o + 3] = 0
        for s in (o, o + 3):
            a[s, s] = a[s, s + 1] = 0.5
        a[o + 4, o + 4] = 1.0
        emit += [[0.2] * 5, *b, [0.2] * 5]
        pi += [1, 0, 0, 0, 0]
    words = ", ".join(f"({5 * k + 4}, '{name}')" for k, name in enumerate(names))
    return f"""WITH RECURSIVE {_D_SQL}, {_model_sql(pi, a, emit)}, {_FORWARD}, vw(j, word) AS (VALUES {words}),
r AS (SELECT utt_id, word, s, row_number() OVER (PARTITION BY utt_id ORDER BY s DESC, word) AS rank FROM vf JOIN x USING (utt_id, t) JOIN vw USING (j) WHERE t = n - 1 AND n >= 5)
SELECT utt_id, CAST(rank AS INTEGER) AS rank, word, round(s, 4) AS score FROM r WHERE rank <= 2"""


@query(_between_silence_sql())
def isolated_word_silence(spark, d):
    m = _hmm()
    silence = hmm.Hmm(np.array([1.0]), np.array([[1.0]]), symbols=np.full((1, 5), 0.2))
    words = {k: [silence, hmm.Hmm(np.array([1.0, 0, 0]), hmm.topology(3, k), symbols=m.symbols), silence] for k in hmm.TOPOLOGIES}
    return hmm.isolated_words(_discrete(spark, d), words, 2).withColumn("score", F.round("score", 4))


@query(_words_sql())
def isolated_word(spark, d):
    m = _hmm()
    words = {k: hmm.Hmm(np.array([1.0, 0, 0]), hmm.topology(3, k), symbols=m.symbols) for k in hmm.TOPOLOGIES}
    return hmm.isolated_words(_discrete(spark, d), words, 2).withColumn("score", F.round("score", 4))


def _token_models():
    m = _hmm()
    return {t: hmm.Hmm(np.array([1.0, 0, 0]), hmm.topology(3, k), symbols=np.roll(m.symbols, i, axis=1)) for i, (t, k) in enumerate((("a", "LINEAR"), ("b", "BAKIS"), ("c", "LEFT_TO_RIGHT")))}


def _chain_sql() -> str:
    """Five tokens of three states in a row; the last state of each but the last stays or goes on with 0.5."""
    tokens, models = "abcab", _token_models()
    a = np.zeros((15, 15))
    for k, t in enumerate(tokens):
        a[3 * k : 3 * k + 3, 3 * k : 3 * k + 3] = models[t].a
        if k < 4:
            a[3 * k + 2] = 0
            a[3 * k + 2, 3 * k + 2 : 3 * k + 4] = 0.5
    b = np.vstack([models[t].symbols for t in tokens])
    return f"""WITH RECURSIVE {_D_SQL}, {_model_sql([1] + [0] * 14, a, b)}, {_FORWARD}, {_path_sql("AND j = 14 AND n >= 15")}
SELECT utt_id, CAST(j // 3 AS INTEGER) AS seg_idx, substr('{tokens}', CAST(j // 3 AS INTEGER) + 1, 1) AS token, min(t) AS start_frame, CAST(count(*) AS INTEGER) AS n_frames,
  string_agg(CAST(j % 3 AS VARCHAR), ',' ORDER BY t) AS q FROM vb GROUP BY utt_id, j // 3"""


@query(_chain_sql())
def meta_alignment(spark, d):
    models = _token_models()
    frames = _discrete(spark, d)
    turns = frames.select("utt_id").distinct().withColumn("words", F.array(F.lit("ab"), F.lit("cab")))
    return hmm.meta_align(frames, turns, {"ab": ["a", "b"], "cab": ["c", "a", "b"]}, models).withColumn("q", F.array_join("q", ","))


# Token models of two states with one Gaussian each; labels say "ab" or "ba" in turn, frames are dealt evenly.
@query(f"""WITH {V_SQL}, n AS (SELECT vl.*, count(*) OVER (PARTITION BY utt_id, dim) AS n FROM vl),
s AS (SELECT *, CASE WHEN frame_idx >= floor(3 * n / 4 + 0.5::DOUBLE) THEN 3 WHEN frame_idx >= floor(2 * n / 4 + 0.5::DOUBLE) THEN 2 WHEN frame_idx >= floor(n / 4 + 0.5::DOUBLE) THEN 1 ELSE 0 END AS q FROM n),
p AS (SELECT *, CASE WHEN (q >= 2) <> (utt_id % 2 = 1) THEN 'b' ELSE 'a' END AS token, q % 2 AS state FROM s)
SELECT token, CAST(state AS INTEGER) AS state, 0 AS k, CAST(dim AS INTEGER) AS dim, 1.0::DOUBLE AS w, round(avg(v), 6) + 0.0 AS mu, round(greatest(var_pop(v), 0.001::DOUBLE), 6) AS var FROM p GROUP BY token, state, dim""")
def token_training(spark, d):
    x = vectors(spark, d).persist()
    words = F.array(F.when(F.col("utt_id") % 2 == 1, "ba").otherwise("ab"))
    turns = x.select("utt_id").distinct().withColumn("words", words)
    book, _ = ac.train(x, turns, {"ab": ["a", "b"], "ba": ["b", "a"]}, ac.continuous({"a": 2, "b": 2}, gm.gaussian(x)), "linear")
    x.unpersist()
    return ac.parameters(spark, book).withColumns({"mu": F.round("mu", 6) + F.lit(0.0), "var": F.round("var", 6)})


# The same alignment over a shared mixture: weights of a state are the means of its frames' posteriors.
@query(f"""WITH {V_SQL}, {_A}, {_POST}, n AS (SELECT vv.vec_id, vv.utt_id, vv.frame_idx, count(*) OVER (PARTITION BY vv.utt_id) AS n FROM vv),
s AS (SELECT *, CASE WHEN frame_idx >= floor(3 * n / 4 + 0.5::DOUBLE) THEN 3 WHEN frame_idx >= floor(2 * n / 4 + 0.5::DOUBLE) THEN 2 WHEN frame_idx >= floor(n / 4 + 0.5::DOUBLE) THEN 1 ELSE 0 END AS q FROM n),
t AS (SELECT vec_id, CASE WHEN (q >= 2) <> (utt_id % 2 = 1) THEN 'b' ELSE 'a' END AS token, q % 2 AS state FROM s),
sh AS (SELECT k, dim, sum(p * v) / sum(p) AS mu, greatest(sum(p * v * v) / sum(p) - power(sum(p * v) / sum(p), 2), 0.001::DOUBLE) AS var FROM g JOIN (SELECT vec_id, dim, v FROM vl) x USING (vec_id) GROUP BY k, dim),
w AS (SELECT token, state, k, sum(p) / sum(sum(p)) OVER (PARTITION BY token, state) AS w FROM g JOIN t USING (vec_id) GROUP BY token, state, k)
SELECT token, CAST(state AS INTEGER) AS state, w.k, CAST(dim AS INTEGER) AS dim, round(w, 6) AS w, round(mu, 6) + 0.0 AS mu, round(var, 6) AS var FROM w JOIN sh USING (k)""")
def shared_training(spark, d):
    x = vectors(spark, d).persist()
    words = F.array(F.when(F.col("utt_id") % 2 == 1, "ba").otherwise("ab"))
    turns = x.select("utt_id").distinct().withColumn("words", words)
    book, _ = ac.train(x, turns, {"ab": ["a", "b"], "ba": ["b", "a"]}, ac.semicontinuous({"a": 2, "b": 2}, MODEL), "linear")
    x.unpersist()
    return ac.parameters(spark, book).withColumns({"w": F.round("w", 6), "mu": F.round("mu", 6) + F.lit(0.0), "var": F.round("var", 6)})


@query(f"""WITH RECURSIVE {_MMIE}, ms AS (SELECT id, k, any_value(n) AS n, any_value(d) AS d FROM st GROUP BY id, k), w0 AS (SELECT id, k, any_value(w) AS w FROM pm GROUP BY id, k),
r AS (SELECT id, k, n, w, max(d / w) OVER (PARTITION BY id) - d / w AS f FROM ms JOIN w0 USING (id, k)), it(id, k, n, f, w, i) AS (SELECT id, k, n, f, w, 0 FROM r UNION ALL SELECT id, k, n, f, n + f * w, i + 1 FROM it WHERE i < 50)
SELECT id AS model_id, CAST(k AS INTEGER) AS k, round(greatest(w / sum(w) OVER (PARTITION BY id), 1e-6), 6) AS w FROM it WHERE i = 50""")
def mmie_weights(spark, d):
    models = {"ubm": MODEL, "spk": OTHER}
    x = vectors(spark, d).withColumn("c", F.when(F.col("utt_id") % 2 == 0, "ubm").otherwise("spk"))
    new = {name: gm.extended_weights(models[name], *pair) for name, pair in gm.mmie_accumulate(x, models).items()}
    return spark.createDataFrame([(name, k, round(float(w), 6)) for name, m in new.items() for k, w in enumerate(m.weights)], "model_id string, k int, w double")


@query(f"WITH {E_SQL} SELECT CAST(frame_idx % 3 AS INTEGER) AS state, event_type AS symbol, count(*)::DOUBLE AS n FROM e GROUP BY frame_idx % 3, event_type")
def emission_counts(spark, d):
    paths = events(spark, d, "event_type").withColumn("state", (F.col("frame_idx") % 3).cast("int"))
    return hmm.emission_counts(paths, "event_type")


# All dimensions and their sum: the covariance has no inverse, but a pseudo-inverse, between two of itself it is itself.
@query(f"""WITH {V_SQL}, x5 AS (SELECT vec_id, dim AS i, v FROM vl UNION ALL SELECT vec_id, {D}, sum(v) FROM vl GROUP BY vec_id)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_pop(a.v, b.v), 6) + 0.0 AS v FROM x5 a JOIN x5 b USING (vec_id) GROUP BY a.i, b.i""")
def pseudo_inverse(spark, d):
    x = vectors(spark, d).withColumn("x", F.concat("x", F.array(F.aggregate("x", F.lit(0.0), lambda a, v: a + v))))
    s = gm.second_order(x)
    m = s["s1"] / s["n"]
    c = s["s2"] / s["n"] - np.outer(m, m)
    back = c @ tr.pinv(c) @ c
    return spark.createDataFrame([(i, j, round(float(back[i, j]), 6) + 0.0) for i in range(D + 1) for j in range(D + 1)], "i int, j int, v double")
