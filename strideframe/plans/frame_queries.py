"""Catalogue: scans, selection, merging, filters, framing and context operators over derived frames."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from strideframe.functions import vectors as V, weights as W
from strideframe.operators import context as cx, features as ft, frames as fr, gaussians as gm, levels as lv
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


def _r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


@query(f"WITH {E_SQL} SELECT utt_id, frame_idx, 0 AS dim, round(v, 6) + 0.0 AS v FROM e")
def frame_scan(spark, d):
    return fr.long_form(events(spark, d))


@query(f"WITH {L_SQL} SELECT utt_id, frame_idx, c, CAST(dim AS INTEGER) AS dim, round(v, 6) + 0.0 AS v FROM ll")
def sample_scan(spark, d):
    return fr.long_form(lines(spark, d), "c")


@query(f"WITH {E_SQL} SELECT utt_id, frame_idx, event_type AS label, round(v, 6) + 0.0 AS v FROM e WHERE event_type NOT IN ('error', 'view')")
def label_filter(spark, d):
    all_ = events(spark, d, "event_type")
    labels = all_.select("utt_id", "frame_idx", F.col("event_type").alias("label"))
    return fr.label_filter(all_.drop("event_type"), labels, ["error", "view"]).select("utt_id", "frame_idx", "label", _r(F.col("x")[0]).alias("v"))


@query(f"WITH {L_SQL} SELECT utt_id, frame_idx, round(x[1], 6) + 0.0 AS v FROM l WHERE c = 'R'")
def reduce_class(spark, d):
    return fr.keep_class(lines(spark, d), "R").select("utt_id", "frame_idx", _r(F.col("x")[0]).alias("v"))


@query(f"WITH {L_SQL} SELECT utt_id, frame_idx, c, round(x[1], 6) + 0.0 AS v FROM l WHERE c <> 'N'")
def remove_class(spark, d):
    return fr.drop_class(lines(spark, d), "N").select("utt_id", "frame_idx", "c", _r(F.col("x")[0]).alias("v"))


@query(f"WITH {V_SQL} SELECT utt_id, frame_idx, CAST(k - 1 AS INTEGER) AS dim, round(x[[1,4,5,6,7,8,9,2][k] ], 6) + 0.0 AS v FROM vv, LATERAL unnest(generate_series(1, 8)) AS t(k)")
def select_dims(spark, d):
    return fr.long_form(fr.select_dims(vectors(spark, d), "0,3-8,1"))


@query(f"WITH {V_SQL} SELECT utt_id, frame_idx, CAST(k - 1 AS INTEGER) AS dim, round(CASE WHEN k = 2 THEN ln(list_sum(list_transform(x, lambda q: abs(q))) + 0.000001::DOUBLE) ELSE x[[64,0,3,3][k]] END, 6) + 0.0 AS v FROM vv, LATERAL unnest(generate_series(1, 4)) AS t(k)")
def select_reorder(spark, d):
    wide = vectors(spark, d).withColumn("energy", fr.energy(F.col("x")))
    return fr.long_form(fr.select_dims(wide, "63,0,2,2", energy_at=0))


@query(f"""WITH {E_SQL}, {L_SQL} SELECT l.utt_id, l.frame_idx, CAST(k - 1 AS INTEGER) AS dim, round(CASE WHEN k <= 4 THEN x[k] ELSE e.v END, 6) + 0.0 AS v
FROM l JOIN e ON l.utt_id = e.utt_id AND l.frame_idx = e.frame_idx, LATERAL unnest(generate_series(1, 5)) AS t(k)""")
def merge_streams(spark, d):
    return fr.long_form(fr.merge(lines(spark, d), events(spark, d)))


@query(f"""WITH {E_SQL} SELECT 'all' AS utt_id, row_number() OVER (ORDER BY utt_id, frame_idx) - 1 AS frame_idx, 0 AS dim, round(v, 6) + 0.0 AS v FROM e""")
def concat_files(spark, d):
    return fr.long_form(fr.concat(events(spark, d)))


@query(f"""WITH {E_SQL}, r(out, a, b) AS (VALUES ('head', 0, 5), ('body', 5, 25), ('tail', 25, 40))
SELECT utt_id, out, frame_idx - a AS frame_idx, round(v, 6) + 0.0 AS v FROM e JOIN r ON frame_idx >= a AND frame_idx < b""")
def split_runs(spark, d):
    runs = spark.createDataFrame([(0, "head", 5), (1, "body", 20), (2, "tail", 15)], "ord int, out string, n_frames long")
    return fr.split_runs(events(spark, d), runs).select("utt_id", "out", "frame_idx", _r(F.col("x")[0]).alias("v"))


@query(f"WITH {E_SQL} SELECT utt_id, frame_idx, round(v, 6) + 0.0 AS v FROM e WHERE frame_idx < 7")
def first_n_per_file(spark, d):
    return fr.first_n(events(spark, d), 7).select("utt_id", "frame_idx", _r(F.col("x")[0]).alias("v"))


@query(f"""WITH {E_SQL}, k AS (SELECT utt_id, frame_idx, v, CASE WHEN frame_idx < 20 THEN CASE WHEN event_type = 'click' THEN 1 ELSE 0 END END AS keep FROM e),
h AS (SELECT *, last_value(keep IGNORE NULLS) OVER (PARTITION BY utt_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS held FROM k)
SELECT utt_id, frame_idx, round(v, 6) + 0.0 AS v FROM h WHERE held = 1""")
def vad_filter(spark, d):
    all_ = events(spark, d, "event_type")
    decided = all_.filter("frame_idx < 20").select("utt_id", "frame_idx", (F.col("event_type") == "click").cast("int").alias("keep"))
    return fr.vad_filter(all_, decided).select("utt_id", "frame_idx", _r(F.col("x")[0]).alias("v"))


@query(f"WITH {V_SQL} SELECT vec_id, round(sum(abs(v)), 6) AS energy FROM vl GROUP BY vec_id")
def frame_energy(spark, d):
    return vectors(spark, d).select("vec_id", F.round(fr.energy(F.col("x")), 6).alias("energy"))


@query(f"WITH {V_SQL}, n AS (SELECT vec_id, utt_id, frame_idx, sum(abs(v)) AS en FROM vl GROUP BY ALL) SELECT vec_id, utt_id, frame_idx FROM n WHERE en > (SELECT avg(en) FROM n)")
def energy_vad_mean(spark, d):
    return fr.mean_threshold(vectors(spark, d)).select("vec_id", "utt_id", "frame_idx")


@query(f"WITH {V_SQL} SELECT vec_id, utt_id, frame_idx FROM vl GROUP BY ALL HAVING sum(abs(v)) > 6.25::DOUBLE")
def energy_vad(spark, d):
    return fr.energy_filter(vectors(spark, d), 6.25).select("vec_id", "utt_id", "frame_idx")


@query(f"WITH {V_SQL}, s AS (SELECT vec_id, avg(v) AS m FROM vl GROUP BY vec_id) SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(v - m, 6) + 0.0 AS v FROM vl JOIN s USING (vec_id)")
def mean_subtract(spark, d):
    rows = vectors(spark, d).select("vec_id", F.posexplode(fr.remove_mean(F.col("x"))).alias("dim", "v"))
    return rows.withColumn("v", _r(F.col("v")))


@query(f"WITH {E_SQL} SELECT utt_id, frame_idx, round(v - avg(v) OVER (PARTITION BY utt_id, frame_idx // 16), 6) + 0.0 AS v FROM e")
def dc_remove(spark, d):
    blocks = fr.sequences(events(spark, d)).select("utt_id", F.posexplode(F.expr("transform(sequence(0, int((size(samples) - 1) / 16)), k -> slice(samples, k * 16 + 1, 16))")).alias("k", "x"))
    rows = blocks.select("utt_id", "k", F.posexplode(fr.remove_mean(F.col("x"))).alias("i", "v"))
    return rows.select("utt_id", (F.col("k") * 16 + F.col("i")).cast("long").alias("frame_idx"), _r(F.col("v")).alias("v"))


@query(f"WITH {E_SQL} SELECT utt_id, frame_idx, round(v - 0.95::DOUBLE * coalesce(lag(v) OVER (PARTITION BY utt_id ORDER BY frame_idx), 0), 6) + 0.0 AS v FROM e")
def preemphasis(spark, d):
    rows = fr.sequences(events(spark, d)).select("utt_id", F.posexplode(fr.preemphasis(F.col("samples"))).alias("frame_idx", "v"))
    return rows.select("utt_id", F.col("frame_idx").cast("long").alias("frame_idx"), _r(F.col("v")).alias("v"))


@query(f"WITH {V_SQL} SELECT vec_id, round(10 * log10(sum(v * v)) - 10 * log10(64) + 300 * log10(2), 6) AS db FROM vl GROUP BY vec_id")
def frame_power_db(spark, d):
    return vectors(spark, d).select("vec_id", F.round(fr.power_db(F.col("x")), 6).alias("db"))


def _framing_sql(weight: str, length: int = 16, step: int = 10) -> str:
    # Samples from ``length`` on lose the mean of their hop; frames are slices, the last ones padded with zeros.
    return f"""WITH {E_SQL}, n AS (SELECT utt_id, count(*) AS n FROM e GROUP BY utt_id),
s AS (SELECT utt_id, frame_idx, CASE WHEN frame_idx < {length} THEN v ELSE v - avg(v) OVER (PARTITION BY utt_id, CASE WHEN frame_idx < {length} THEN -1 ELSE (frame_idx - {length}) // {step} END) END AS v FROM e),
f AS (SELECT utt_id, k, i, k * {step} + i AS at FROM n, LATERAL unnest(generate_series(0, CASE WHEN n >= {length} THEN (n - {length}) // {step} + 1 ELSE 0 END)) AS t(k), LATERAL unnest(generate_series(0, {length - 1})) AS u(i))
SELECT f.utt_id, f.k AS frame_idx, CAST(f.i AS INTEGER) AS dim, round(coalesce(s.v, 0) * ({weight}), 6) + 0.0 AS v FROM f LEFT JOIN s ON s.utt_id = f.utt_id AND s.frame_idx = f.at"""


def _framed(spark, d, weights):
    return fr.long_form(fr.framing(fr.sequences(events(spark, d)), 16, 10, weights(16)))


@query(_framing_sql("0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / 15)"))
def framing_hamming(spark, d):
    return _framed(spark, d, W.hamming)


@query(_framing_sql("0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 15)"))
def framing_hann(spark, d):
    return _framed(spark, d, W.hann)


@query(_framing_sql("1"))
def framing_rect(spark, d):
    return _framed(spark, d, W.rectangular)


@query(_framing_sql("CASE WHEN i < 8 THEN 2 * i / 16 + 2 / 16 ELSE 2 * (7 - (i - 8)) / 16 END"))
def framing_triangular(spark, d):
    return _framed(spark, d, W.triangular)


_SPAN = "(PARTITION BY utt_id, dim ORDER BY frame_idx)"


def _near(k: int) -> str:
    edge = "last_value(v) OVER (PARTITION BY utt_id, dim ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" if k > 0 else "first_value(v) OVER (PARTITION BY utt_id, dim ORDER BY frame_idx)"
    return "v" if k == 0 else f"coalesce(lead(v, {k}) OVER {_SPAN}, {edge})" if k > 0 else f"coalesce(lag(v, {-k}) OVER {_SPAN}, {edge})"


def _slope_sql(context: int, order: int, least: int, source: str = L_SQL, rows: str = "ll", width: int = 4) -> str:
    half = context // 2
    w = W.regression(context, order)
    body = " + ".join(f"({v!r}::DOUBLE) * {_near(k)}" for v, k in zip(w, range(-half, half + 1), strict=True) if v)
    return f"""WITH {source}, s AS (SELECT utt_id, frame_idx, dim, v, {body} AS dv, count(*) OVER (PARTITION BY utt_id, dim) AS n FROM {rows})
SELECT utt_id, frame_idx, CAST(dim AS INTEGER) AS dim, round(v, 5) + 0.0 AS v FROM s WHERE n >= {least}
UNION ALL SELECT utt_id, frame_idx, CAST(dim + {width} AS INTEGER), round(dv, 5) + 0.0 FROM s WHERE n >= {least}"""


@query(_slope_sql(3, 1, 2))
def slope_order1(spark, d):
    return fr.long_form(cx.slopes(lines(spark, d), cx.parse_slopes("3:1")[1]), digits=5)


@query(_slope_sql(5, 2, 3))
def slope_order2(spark, d):
    return fr.long_form(cx.slopes(lines(spark, d), cx.parse_slopes("5:2")[1]), digits=5)


@query(_slope_sql(7, 3, 4, V_SQL, "vl", 64))
def slope_order3(spark, d):
    return fr.long_form(cx.slopes(vectors(spark, d), cx.parse_slopes("7:3")[1]), digits=5)


@query(f"""WITH {E_SQL}, s AS (SELECT utt_id, frame_idx, 0 AS dim, v FROM e)
SELECT utt_id, frame_idx, round(0.25::DOUBLE * {_near(-1)} + 0.5::DOUBLE * v + 0.25::DOUBLE * {_near(1)}, 6) + 0.0 AS v FROM s""")
def tirol_smoothing(spark, d):
    return cx.slopes(events(spark, d), [], tirol=True).select("utt_id", "frame_idx", _r(F.col("x")[0]).alias("v"))


@query(f"""WITH {E_SQL}, s AS (SELECT utt_id, frame_idx, v, {", ".join(f"lead(v, {k}) OVER (PARTITION BY utt_id ORDER BY frame_idx) AS l{k}" for k in (2, 3, 5, 6, 8))} FROM e)
SELECT utt_id, frame_idx, CAST(i AS INTEGER) AS dim, round(CASE i WHEN 0 THEN l2 - v WHEN 1 THEN l5 - l3 ELSE l8 - l6 END, 6) + 0.0 AS v FROM s, LATERAL unnest(generate_series(0, 2)) AS t(i) WHERE l8 IS NOT NULL""")
def sdc(spark, d):
    return fr.long_form(cx.shifted_deltas(events(spark, d), 1, 3, 3))


@query(f"""WITH {L_SQL}, n AS (SELECT utt_id, count(*) AS n FROM l GROUP BY utt_id)
SELECT a.utt_id, a.frame_idx, CAST(b.dim * 3 + k AS INTEGER) AS dim, round(b.v, 6) + 0.0 AS v
FROM l a JOIN n ON n.utt_id = a.utt_id, LATERAL unnest(generate_series(0, 2)) AS t(k) JOIN ll b ON b.utt_id = a.utt_id AND b.frame_idx = a.frame_idx + k WHERE a.frame_idx + 2 < n.n""")
def traps_raw(spark, d):
    return fr.long_form(cx.traps(lines(spark, d), 3))


@query(f"""WITH {E_SQL}, s AS (SELECT utt_id, frame_idx, 0 AS dim, v FROM e), m AS (SELECT utt_id, frame_idx, list_sort([{", ".join(_near(k) for k in range(-2, 3))}]) AS w FROM s)
SELECT utt_id, frame_idx, round(w[3], 6) + 0.0 AS v FROM m""")
def median_nonrecursive(spark, d):
    return cx.median(events(spark, d), 5).select("utt_id", "frame_idx", _r(F.col("x")[0]).alias("v"))


@query(f"""WITH {V_SQL}, s AS (SELECT vec_id, dim, v, v * lead(v) OVER (PARTITION BY vec_id ORDER BY dim) AS p FROM vl)
SELECT vec_id, count(*) FILTER (p < 0) * 8000 / 64 < 4200 AND sum(v * v) / 64 > 0.015::DOUBLE AND max(v) > 0.28::DOUBLE AS voiced FROM s GROUP BY vec_id""")
def vuv_detect(spark, d):
    return vectors(spark, d).select("vec_id", fr.voiced(F.col("x"), 8000, 4200.0, 0.015, 0.28).alias("voiced"))


def _run(k: int) -> str:
    f = f"lead(b, {k})" if k > 0 else f"lag(b, {-k})"
    return f"CASE WHEN {f} OVER w = b THEN 1 ELSE 0 END"


@query(f"""WITH {E_SQL}, s AS (SELECT utt_id, frame_idx, CASE WHEN v > 20 THEN 1 ELSE 0 END AS b FROM e),
r AS (SELECT *, 1 + {_run(-1)} + {_run(-1)} * {_run(-2)} + {_run(1)} + {_run(1)} * {_run(2)} AS run FROM s WINDOW w AS (PARTITION BY utt_id ORDER BY frame_idx))
SELECT utt_id, frame_idx, CASE WHEN b = 1 AND run < 3 THEN 0 WHEN b = 0 AND run < 2 THEN 1 ELSE b END AS voiced FROM r""")
def vuv_smoothing(spark, d):
    rows = events(spark, d).select("utt_id", "frame_idx", (F.col("x")[0] > 20).cast("int").alias("voiced"))
    return cx.smooth_decisions(rows)


def _morph(f: str, c: str, source: str, name: str) -> str:
    return f"{name} AS (SELECT utt_id, frame_idx, {f}({c}) OVER (PARTITION BY utt_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS b FROM {source})"


@query(f"""WITH {E_SQL}, s AS (SELECT utt_id, frame_idx, CASE WHEN v > 20 THEN 1 ELSE 0 END AS b FROM e), {_morph("max", "b", "s", "m1")}, {_morph("min", "b", "m1", "m2")}, {_morph("min", "b", "m2", "m3")}, {_morph("max", "b", "m3", "m4")}
SELECT utt_id, frame_idx, b AS speech FROM m4""")
def segment_morphology(spark, d):
    rows = events(spark, d).select("utt_id", "frame_idx", (F.col("x")[0] > 20).cast("int").alias("speech"))
    return cx.morphology(rows, 2)


@query(f"""WITH {V_SQL}, a AS (SELECT utt_id, frame_idx, any_value(x) AS x, sum(v) AS s FROM vl JOIN vv USING (vec_id, utt_id, c, frame_idx) GROUP BY utt_id, frame_idx),
m AS (SELECT utt_id, frame_idx, x, sum(s) OVER w / (64 * count(*) OVER w) AS m FROM a WINDOW w AS (PARTITION BY utt_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)),
g AS (SELECT utt_id, frame_idx, list_sum(list_transform(x, lambda q: (q - m) * (q - m))) / 64 AS energy FROM m),
s AS (SELECT utt_id, frame_idx, energy, CASE WHEN energy >= exp(avg(ln(energy + 0.000001::DOUBLE)) OVER (PARTITION BY utt_id)) THEN 1 ELSE 0 END AS b FROM g),
{_morph("max", "b", "s", "m1")}, {_morph("min", "b", "m1", "m2")}, {_morph("min", "b", "m2", "m3")}, {_morph("max", "b", "m3", "m4")}
SELECT utt_id, frame_idx, round(energy, 6) AS energy, m4.b AS speech FROM m4 JOIN s USING (utt_id, frame_idx)""")
def segmenter(spark, d):
    return cx.segment_speech(vectors(spark, d), 2).withColumn("energy", F.round("energy", 6))


@query(f"""WITH {L_SQL}, m AS (SELECT *, avg(v) OVER w AS mu, stddev_pop(v) OVER w AS sd FROM ll WINDOW w AS (PARTITION BY utt_id, dim))
SELECT utt_id, frame_idx, CAST(dim AS INTEGER) AS dim, round((v - mu) / nullif(sd, 0), 5) + 0.0 AS v FROM m""")
def mvn_turnwise(spark, d):
    return fr.long_form(cx.mvn(lines(spark, d)), digits=5)


@query(f"""WITH {L_SQL}, m AS (SELECT *, avg(v) OVER w AS mu, stddev_pop(v) OVER w AS sd FROM ll WINDOW w AS (PARTITION BY dim))
SELECT utt_id, frame_idx, CAST(dim AS INTEGER) AS dim, round((v - mu) / sd, 5) + 0.0 AS v FROM m""")
def mvn_cumulative(spark, d):
    return fr.long_form(cx.mvn(lines(spark, d), per_utterance=False), digits=5)


@query(f"WITH {E_SQL} SELECT utt_id, frame_idx, 0 AS dim, round(v - avg(v) OVER (PARTITION BY utt_id), 6) + 0.0 AS v FROM e")
def mvn_mean_only(spark, d):
    return fr.long_form(cx.mvn(events(spark, d), variances=False))


@query(f"WITH {L_SQL} SELECT CAST(dim AS INTEGER) AS i, count(*) AS n, round(avg(v), 4) AS mean, round(var_pop(v), 3) AS var FROM ll GROUP BY dim")
def mvn_merge_stats(spark, d):
    parts = cx.dim_stats(lines(spark, d), "utt_id").select("n", F.posexplode(F.arrays_zip("mean", "sd")).alias("i", "p"))
    parts = parts.select("i", "n", F.col("p.mean").alias("mean"), (F.col("p.sd") * F.col("p.sd")).alias("var"))
    return cx.merge_stats(parts).select("i", "n", F.round("mean", 4).alias("mean"), F.round("var", 3).alias("var"))


@query(f"""WITH {L_SQL} SELECT utt_id, frame_idx, CAST(dim AS INTEGER) AS dim,
least(row_number() OVER (PARTITION BY utt_id, dim ORDER BY v, frame_idx), count(*) OVER (PARTITION BY utt_id, dim) - 1) / count(*) OVER (PARTITION BY utt_id, dim) AS q FROM ll""")
def gaussianize_rank(spark, d):
    return cx.gaussianize_ranks(lines(spark, d))


@query(f"""WITH {V_SQL} SELECT vec_id, round(sum(abs(v)), 6) AS l1, round(sqrt(sum(v * v)), 6) AS l2, round(max(v), 6) + 0.0 AS hi, round(min(v), 6) + 0.0 AS lo,
CAST(arg_max(dim, v) AS INTEGER) AS at_hi, CAST(arg_min(dim, v) AS INTEGER) AS at_lo FROM vl GROUP BY vec_id""")
def vector_norms(spark, d):
    x = F.col("x")
    return vectors(spark, d).select("vec_id", F.round(V.norm1(x), 6).alias("l1"), F.round(V.norm2(x), 6).alias("l2"), _r(F.array_max(x)).alias("hi"), _r(F.array_min(x)).alias("lo"), V.argmax(x).alias("at_hi"), V.argmin(x).alias("at_lo"))


@query(f"""WITH {V_SQL} SELECT a.vec_id AS vec_id, round(list_dot_product(a.x, b.x), 6) + 0.0 AS dot, round(list_distance(a.x, b.x), 6) AS euclid,
round(list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2]))), 6) AS manhattan FROM vv a JOIN vv b ON a.utt_id = b.utt_id AND a.frame_idx = b.frame_idx + 1""")
def vector_distances(spark, d):
    v = vectors(spark, d)
    other = v.select("utt_id", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    return v.join(other, ["utt_id", "frame_idx"]).select("vec_id", _r(V.dot(x, y)).alias("dot"), F.round(V.euclidean(x, y), 6).alias("euclid"), F.round(V.manhattan(x, y), 6).alias("manhattan"))


@query(f"""WITH {V_SQL}, r AS (SELECT vec_id, dim, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, dim) AS k FROM vl)
SELECT vec_id, CAST(k - 1 AS INTEGER) AS k, round(v, 6) + 0.0 AS v, CAST(dim AS INTEGER) AS at FROM r WHERE k <= 5""")
def topn_values(spark, d):
    both = F.arrays_zip(V.top_values(F.col("x"), 5).alias("v"), V.top_positions(F.col("x"), 5).alias("p"))
    return vectors(spark, d).select("vec_id", F.posexplode(both).alias("k", "s")).select("vec_id", "k", _r(F.col("s.v")).alias("v"), F.col("s.p").alias("at"))


@query(f"WITH {V_SQL} SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(abs(v) / sum(abs(v)) OVER (PARTITION BY vec_id), 6) AS v FROM vl")
def normalise_sum1(spark, d):
    rows = vectors(spark, d).select("vec_id", F.posexplode(V.sum_to_one(F.transform("x", lambda v: F.abs(v)))).alias("dim", "v"))
    return rows.withColumn("v", F.round("v", 6))


@query(f"""WITH {V_SQL} SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(0.3::DOUBLE * v + 0.7::DOUBLE * avg(v) OVER (PARTITION BY utt_id, dim), 6) + 0.0 AS v FROM vl""")
def interpolate_means(spark, d):
    v = vectors(spark, d)
    means = cx.dim_stats(v, "utt_id").select("utt_id", "mean")
    rows = v.join(means, "utt_id").select("vec_id", F.posexplode(V.interpolate(F.col("x"), F.col("mean"), 0.3)).alias("dim", "v"))
    return rows.withColumn("v", _r(F.col("v")))


@query("""WITH t AS (SELECT row_number() OVER () AS r, conv_id, turn, regexp_split_to_array(lower(text), '\\s+') AS w FROM conversations),
p AS (SELECT r, i - 1 AS start, j - i + 1 AS length FROM t, LATERAL unnest(generate_series(1, len(w))) AS a(i), LATERAL unnest(generate_series(i + 2, len(w))) AS b(j) WHERE w[i] = w[j] AND list_slice(w, i, j) = list_reverse(list_slice(w, i, j))),
m AS (SELECT r, first(start ORDER BY length DESC, start) AS start, max(length) AS length FROM p GROUP BY r)
SELECT conv_id, turn, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length FROM t LEFT JOIN m USING (r)""")
def palindromes(spark, d):
    from strideframe.session import table

    words = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.lower("text"), r"\s+").alias("w"))
    found = words.select("conv_id", "turn", F.get(V.palindromes(F.col("w"), 3), F.lit(0)).alias("p"))
    return found.select("conv_id", "turn", "p.start", "p.length")


_PEAKS = f"""p AS (SELECT utt_id, frame_idx, list_max(list_transform(x, lambda q: abs(q))) * 3 AS peak FROM vv), s AS (SELECT utt_id, frame_idx, CASE WHEN x[1] > 0.05 THEN 1 ELSE 0 END AS speech, x[1] * x[1] AS e FROM vv),
l AS (SELECT utt_id, 10 * log10(avg(e) FILTER (speech = 1)) - 10 * log10(exp(avg(ln(e + 0.000001::DOUBLE)) FILTER (speech = 0))) AS snr FROM s GROUP BY utt_id),
g AS (SELECT utt_id, count(*) * 0.25::DOUBLE AS duration, max(frame_idx) AS last, min(frame_idx) FILTER (speech = 1 AND frame_idx >= 4) AS a, max(frame_idx) FILTER (speech = 1 AND frame_idx >= 4) AS b, max(frame_idx) FILTER (peak > 0.999 AND frame_idx >= 4) AS z
  FROM s JOIN p USING (utt_id, frame_idx) GROUP BY utt_id), h AS (SELECT g.*, coalesce(snr, 0) AS snr, a IS NOT NULL AND coalesce(snr, 0) >= 3 AS has FROM g LEFT JOIN l USING (utt_id))"""


@query(f"""WITH {V_SQL}, {_PEAKS} SELECT utt_id, duration, round(snr, 5) + 0.0 AS snr, has AS has_speech, CASE WHEN has THEN (least(a, last) - 4) * 0.25::DOUBLE ELSE duration END AS initial_silence,
CASE WHEN has THEN (last - b) * 0.25::DOUBLE ELSE duration END AS terminal_silence, z IS NOT NULL AS saturated, coalesce(z * 0.25::DOUBLE, -1) AS last_saturation FROM h""")
def speech_report(spark, d):
    v = vectors(spark, d)
    first = F.col("x")[0]
    segments = v.select("utt_id", "frame_idx", (first > 0.05).cast("int").alias("speech"), (first * first).alias("energy"))
    rows = segments.join(lv.peaks(v.withColumn("x", F.transform("x", lambda q: q * 3))), ["utt_id", "frame_idx"])
    report = lv.speech_report(rows, cx.speech_levels(segments), 0.25, 3.0, 1.0)
    return report.withColumn("snr", _r(F.col("snr"), 5))


@query(f"WITH {E_SQL} SELECT utt_id, frame_idx, round(v - avg(v) OVER (PARTITION BY utt_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS v FROM e")
def running_dc(spark, d):
    return lv.running_mean_removed(events(spark, d)).select("utt_id", "frame_idx", _r(F.col("x")[0], 9).alias("v"))


def _threshold_sql(steps: int) -> str:
    """Two Gaussians on either side of the mean, so many EM steps, then the first of 10000 points that the second one wins."""
    out = f"WITH {E_SQL}, g0 AS (SELECT CASE WHEN v <= (SELECT avg(v) FROM e) THEN 0 ELSE 1 END AS k, count(*) / (SELECT count(*) FROM e) AS w, avg(v) AS mu, greatest(avg(v * v) - avg(v) * avg(v), 1e-10) AS var FROM e GROUP BY 1)"
    lp = "ln(w) + greatest(-0.5::DOUBLE * (ln(var) + ln(2 * pi()) + ({x} - mu) * ({x} - mu) / var), ln(1e-256))"
    for i in range(steps):
        out += f""", p{i} AS (SELECT i, v, k, exp(lp - mx) / sum(exp(lp - mx)) OVER (PARTITION BY i) AS p FROM (SELECT *, max(lp) OVER (PARTITION BY i) AS mx FROM (SELECT i, v, k, {lp.format(x="v")} AS lp FROM (SELECT row_number() OVER () AS i, v FROM e) a, g{i}))),
g{i + 1} AS MATERIALIZED (SELECT k, sum(p) / sum(sum(p)) OVER () AS w, sum(p * v) / sum(p) AS mu, greatest(sum(p * v * v) / sum(p) - power(sum(p * v) / sum(p), 2), 0.001::DOUBLE) AS var FROM p{i} GROUP BY k)"""
    return out + f""", b AS (SELECT (SELECT mu FROM g{steps} WHERE k = 0) AS a, (SELECT mu FROM g{steps} WHERE k = 1) AS z), x AS (SELECT i, a + i * ((z - a) / 10000) AS x FROM b, (SELECT unnest(generate_series(0, 9999)) AS i)),
o AS (SELECT i, x, max({lp.format(x="x")}) FILTER (k = 1) > max({lp.format(x="x")}) FILTER (k = 0) AS over FROM x, g{steps} GROUP BY i, x)
SELECT 'EM{steps}' AS strategy, round(coalesce((SELECT x FROM o WHERE over ORDER BY i LIMIT 1), (SELECT z FROM b)), 4) AS threshold"""


_MEAN_SQL = "SELECT 'MEAN' AS strategy, round(avg(value), 4) AS threshold FROM events"
_CLUSTER_SQL = _threshold_sql(0).replace("'EM0'", "'CLUSTER'")


def _threshold(strategy: str, sql: str):
    def run(spark, d):
        rows = events(spark, d).persist()
        found = lv.energy_threshold(rows, strategy)
        rows.unpersist()
        return spark.createDataFrame([(strategy, round(found, 4))], "strategy string, threshold double")
    run.__name__ = f"energy_threshold_{strategy.lower()}"
    query(sql)(run)


_threshold("MEAN", _MEAN_SQL)
_threshold("CLUSTER", _CLUSTER_SQL)
_threshold("EM1", _threshold_sql(1))
_threshold("EM5", _threshold_sql(5))


@query(f"""WITH {E_SQL}, r AS (SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY v, frame_idx) AS r, count(*) OVER (PARTITION BY utt_id) AS n, frame_idx FROM e)
SELECT utt_id, frame_idx, CAST(0 AS INTEGER) AS dim, least(r, n - 1) AS place FROM r WHERE n > 1""")
def gaussianize_values(spark, d):
    """The normal values' places in the normal distribution are the ranks they come from."""
    rows = ft.gaussianize(events(spark, d))
    n = F.count("*").over(Window.partitionBy("utt_id"))
    return rows.withColumn("n", n).filter("n > 1").select("utt_id", "frame_idx", "dim", F.round(gm.normal_cdf(F.col("v")) * F.col("n")).cast("long").alias("place"))
