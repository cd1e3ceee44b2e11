"""Catalogue: spectral kernels, filters, generators and pitch edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import weights as W
from strideframe.operators import dsp, features as ft, frames as fr, spectral as sp
from strideframe.plans.common import E_SQL, V_SQL, events, vectors
from strideframe.plans.frame_queries import _framing_sql

Q, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def _vec(frames, digits: int = 5):
    return fr.long_form(frames, "vec_id", digits=digits).select("vec_id", "dim", "v")


def _v(spark, d):
    return vectors(spark, d).select("utt_id", "frame_idx", "x", "vec_id")


def _transform_sql(term: str, n: int = 64) -> str:
    return f"""WITH {V_SQL}, k AS (SELECT unnest(generate_series(0, {n - 1})) AS k)
SELECT vec_id, CAST(k AS INTEGER) AS dim, round(sum(v * ({term})), 5) + 0.0 AS v FROM vl, k GROUP BY vec_id, k"""


@query(_transform_sql("cos(pi() * (dim + 0.5::DOUBLE) * k / 64) * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / 64)"))
def dct(spark, d):
    return _vec(sp.Chain(sp.dct(64)).apply(_v(spark, d)))


@query(_transform_sql("cos(2 * pi() * dim * k / 64) + sin(2 * pi() * dim * k / 64)"))
def dht(spark, d):
    return _vec(sp.Chain(sp.dht(64)).apply(_v(spark, d)))


@query(f"""WITH {V_SQL}, k AS (SELECT unnest(generate_series(0, 63)) AS k)
SELECT a.vec_id, CAST(k AS INTEGER) AS dim, round(sum(a.v * b.v), 5) + 0.0 AS v FROM vl a, k, vl b WHERE b.vec_id = a.vec_id AND b.dim = (a.dim + k) % 64 GROUP BY a.vec_id, k""")
def autocorr_circular(spark, d):
    return _vec(sp.Chain(sp.circular_acf).apply(_v(spark, d)))


@query(f"""WITH {V_SQL}, k AS (SELECT unnest(generate_series(0, 63)) AS k), r AS (
SELECT a.vec_id, k, sum(a.v * b.v) AS r FROM vl a, k, vl b WHERE b.vec_id = a.vec_id AND b.dim = a.dim + k GROUP BY a.vec_id, k)
SELECT vec_id, CAST(k AS INTEGER) AS dim, round(r / max(r) FILTER (k = 0) OVER (PARTITION BY vec_id), 5) + 0.0 AS v FROM r""")
def autocorr_linear(spark, d):
    return _vec(sp.Chain(sp.linear_acf()).apply(_v(spark, d)))


@query(f"""WITH {V_SQL}, k AS (SELECT unnest(generate_series(0, 256)) AS k), s AS (SELECT vec_id, k, sum(v * cos(2 * pi() * dim * k / 512)) AS re, sum(v * sin(2 * pi() * dim * k / 512)) AS im FROM vl, k GROUP BY vec_id, k)
SELECT vec_id, CAST(k AS INTEGER) AS dim, round(CASE WHEN k = 0 THEN abs(re) ELSE re * re + im * im END, 5) + 0.0 AS v FROM s""")
def fft_power(spark, d):
    return _vec(sp.Chain(sp.power_spectrum()).apply(_v(spark, d)))


_SPECTRUM = f"""{V_SQL}, kk AS (SELECT unnest(generate_series(0, 256)) AS k),
ft AS (SELECT vec_id, k, sum(v * cos(2 * pi() * dim * k / 512)) AS re, sum(v * sin(2 * pi() * dim * k / 512)) AS im FROM vl, kk GROUP BY vec_id, k),
pw AS (SELECT vec_id, k, CASE WHEN k = 0 THEN abs(re) ELSE re * re + im * im END AS p, sqrt(re * re + im * im) AS m FROM ft)"""


@query(f"WITH {_SPECTRUM} SELECT vec_id, CAST(k AS INTEGER) AS dim, round(20 * log10(greatest(m / sum(m) OVER (PARTITION BY vec_id), 1e-300)), 3) + 0.0 AS v FROM pw")
def display_spectrum(spark, d):
    return _vec(sp.Chain(sp.magnitude_spectrum(log=True)).apply(_v(spark, d)), 3)


def _bank_sql(edges: str) -> str:
    """Triangles over 257 bins of 31.25 Hz between the edges (i, a, b) in Hz."""
    return f"""{edges}, bn AS (SELECT i, greatest(0, least(256, round(a / 31.25::DOUBLE))) AS l, greatest(0, least(256, round(b / 31.25::DOUBLE))) AS r FROM ed),
wt AS (SELECT i, k, greatest(0, CASE WHEN k <= (l + r) / 2 THEN (k - l + 1) / ((l + r) / 2 - l + 1) ELSE (r + 1 - k) / (r + 1 - (l + r) / 2) END) AS w FROM bn, kk WHERE k BETWEEN l AND r),
bk AS (SELECT i, k, w / sum(w) OVER (PARTITION BY i) AS w FROM wt)"""


def _mel_sql(warp: str = "f") -> str:
    return _bank_sql(f"""ml AS (SELECT 1127 * ln(1 + 188 / 700::DOUBLE) AS lo, 1127 * ln(1 + 6071 / 700::DOUBLE) AS hi, 226.8::DOUBLE AS w),
mn AS (SELECT *, CAST(ceil((hi - lo - w) / (w / 2) + 1) AS INTEGER) AS n FROM ml),
mh AS (SELECT i, 700 * (exp((lo + (hi - lo - w) / (n - 1) * i) / 1127) - 1) AS f, 700 * (exp((lo + (hi - lo - w) / (n - 1) * i + w) / 1127) - 1) AS g FROM mn, LATERAL unnest(generate_series(0, n - 1)) AS t(i)),
ed AS (SELECT i, {warp} AS a, {warp.replace("f", "g")} AS b FROM mh)""")


_LOG_BANK = "SELECT vec_id, CAST(i AS INTEGER) AS dim, round(ln(sum(p * w) + 0.000001::DOUBLE), 5) + 0.0 AS v FROM pw JOIN bk USING (k) GROUP BY vec_id, i"
# alpha 1.1 between 300 * 1.1 and 5000 Hz, linear to 0 and 8000 Hz outside.
_WARP = "CASE WHEN f <= 0 OR f >= 8000 THEN f WHEN f < 330 THEN f * 300 / 330 WHEN f > 5000 THEN 5000 / 1.1::DOUBLE + (f - 5000) * (8000 - 5000 / 1.1::DOUBLE) / 3000 ELSE f / 1.1::DOUBLE END"


@query(f"WITH {_SPECTRUM}, {_mel_sql()} {_LOG_BANK}")
def mel_bank(spark, d):
    bank = sp.mel_bank(257, 16000 / 512)
    return _vec(sp.Chain(sp.power_spectrum(), sp.filter_bank(bank)).apply(_v(spark, d)))


_EDGES = "ed AS (SELECT * FROM (VALUES (0, 200, 1200), (2, 3000, 7000)) AS t(i, a, b))"


@query(f"""WITH {_SPECTRUM}, {_bank_sql(_EDGES)}, whole AS (SELECT * FROM bk UNION ALL SELECT 1, k, 1 / 65::DOUBLE FROM kk WHERE k BETWEEN 32 AND 96)
SELECT vec_id, CAST(i AS INTEGER) AS dim, round(sum(p * w), 5) + 0.0 AS v FROM pw JOIN whole USING (k) GROUP BY vec_id, i""")
def manual_bank(spark, d):
    bank = sp.parse_bank("t,200,1200:r,1000,3000:t,3000,7000", 257, 16000 / 512)
    return _vec(sp.Chain(sp.power_spectrum(), sp.filter_bank(bank, log=False)).apply(_v(spark, d)))


@query(f"WITH {_SPECTRUM}, {_mel_sql(_WARP)} {_LOG_BANK}")
def mel_bank_vtln(spark, d):
    bank = sp.mel_bank(257, 16000 / 512, warp=sp.vtln(1.1, 300.0, 5000.0))
    return _vec(sp.Chain(sp.power_spectrum(), sp.filter_bank(bank)).apply(_v(spark, d)))


@query(f"""WITH {_SPECTRUM}, {_mel_sql()}, lb AS (SELECT vec_id, i, ln(sum(p * w) + 0.000001::DOUBLE) AS y FROM pw JOIN bk USING (k) GROUP BY vec_id, i)
SELECT vec_id, CAST(c AS INTEGER) AS dim, round(sum(y * cos(pi() * (i + 0.5::DOUBLE) * c / n)) * sqrt(CASE WHEN c = 0 THEN 1 ELSE 2 END / any_value(n)::DOUBLE), 5) + 0.0 AS v
FROM lb, mn, (SELECT unnest(generate_series(0, 11)) AS c) GROUP BY vec_id, c""")
def mfcc(spark, d):
    return _vec(sp.mfcc(64, 16000).apply(_v(spark, d)))


_ACF = f"""{V_SQL}, k0 AS (SELECT unnest(generate_series(0, 63)) AS k),
rr AS (SELECT a.vec_id, k, sum(a.v * b.v) AS r FROM vl a, k0, vl b WHERE b.vec_id = a.vec_id AND b.dim = a.dim + k GROUP BY a.vec_id, k),
ac AS (SELECT vec_id, k, r / max(r) FILTER (k = 0) OVER (PARTITION BY vec_id) AS r FROM rr)"""


@query(f"""WITH {_ACF}, nb AS (SELECT *, lag(r) OVER w AS a, lead(r) OVER w AS b FROM ac WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
pk AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, k DESC) AS n FROM nb WHERE k BETWEEN 4 AND 53 AND r > a AND r >= b),
ids AS (SELECT DISTINCT vec_id FROM vl)
SELECT ids.vec_id, CAST(dim AS INTEGER) AS dim, round(coalesce(16000 / k::DOUBLE, 0), 3) + 0.0 AS v FROM ids CROSS JOIN (VALUES (0), (1)) AS t(dim) LEFT JOIN pk ON pk.vec_id = ids.vec_id AND pk.n = 2 - dim""")
def f0(spark, d):
    return _vec(sp.Chain(sp.linear_acf(), sp.f0_candidates(16000, 2, 300.0, 4000.0)).apply(_v(spark, d)), 3)


# Levinson's recursion, one order a step; lists are numbered from 1.
_LPC = f"""{_ACF}, rl AS (SELECT vec_id, list(r ORDER BY k) AS r FROM ac GROUP BY vec_id),
lv(vec_id, m, a, e) AS (SELECT vec_id, 0, [1.0::DOUBLE], r[1] FROM rl
  UNION ALL SELECT vec_id, m + 1, list_transform(generate_series(1, m + 2), lambda j: coalesce(a[j], 0) + k * coalesce(a[m + 3 - j], 0)), e * (1 - k * k)
  FROM (SELECT lv.*, -list_sum(list_transform(generate_series(1, m + 1), lambda j: a[j] * r[m + 3 - j])) / CASE WHEN e = 0 THEN 1 ELSE e END AS k FROM lv JOIN rl USING (vec_id) WHERE m < 10)),
sp AS (SELECT vec_id, k, any_value(e) / greatest(power(sum(x * cos(2 * pi() * j * k / 512)), 2) + power(sum(x * sin(2 * pi() * j * k / 512)), 2), 1e-300) AS s
  FROM (SELECT vec_id, e, unnest(a) AS x, unnest(generate_series(0, 10)) AS j FROM lv WHERE m = 10), (SELECT unnest(generate_series(0, 256)) AS k) GROUP BY vec_id, k)"""


@query(f"WITH RECURSIVE {_LPC} SELECT vec_id, CAST(k AS INTEGER) AS dim, round(s, 4) + 0.0 AS v FROM sp")
def lpc(spark, d):
    return _vec(sp.Chain(sp.linear_acf(), sp.lpc_spectrum(10)).apply(_v(spark, d)), 4)


@query(f"""WITH RECURSIVE {_LPC}, nb AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b FROM sp WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
pk AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY k) AS n FROM nb WHERE s > a AND s > b),
ids AS (SELECT DISTINCT vec_id FROM vl)
SELECT ids.vec_id, CAST(dim AS INTEGER) AS dim, round(coalesce(k * 31.25::DOUBLE, 0), 3) + 0.0 AS v FROM ids CROSS JOIN (VALUES (0), (1), (2)) AS t(dim) LEFT JOIN pk ON pk.vec_id = ids.vec_id AND pk.n = dim + 1""")
def formants(spark, d):
    return _vec(sp.Chain(sp.linear_acf(), sp.lpc_spectrum(10), sp.formants(16000)).apply(_v(spark, d)), 3)


@query("SELECT 'key' || lpad(CAST(i AS VARCHAR), 2, '0') AS utt_id, CAST(0 AS BIGINT) AS frame_idx, substr('123A456B789C*0#D', CAST(i AS INTEGER) + 1, 1) AS key FROM (SELECT unnest(generate_series(0, 15)) AS i)")
def dtmf(spark, d):
    tones = None
    for i, (_, lo, hi) in enumerate(sp.dtmf_tones(sp.DTMF_KEYS)):
        own = dsp.sine(spark, 256, 8000, lo, hi, utt_id=f"key{i:02d}")
        tones = own if tones is None else tones.union(own)
    packed = tones.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("s"))
    return sp.dtmf(packed.select("utt_id", F.lit(0).cast("long").alias("frame_idx"), F.transform("s", lambda s: s["v"]).alias("x")), 8000)


@query("SELECT 'sine' AS utt_id, n, round(0.3::DOUBLE * (sin(2 * pi() * 440 / 8000 * n) + sin(2 * pi() * 1000 / 8000 * n)), 6) + 0.0 AS v FROM (SELECT unnest(generate_series(0, 7999)) AS n)")
def sine_generator(spark, d):
    return dsp.sine(spark, 8000, 8000, 440.0, 1000.0).withColumn("v", F.round("v", 6) + F.lit(0.0))


@query("SELECT 'constant' AS utt_id, n, 0.25::DOUBLE AS v FROM (SELECT unnest(generate_series(0, 999)) AS n)")
def constant_generator(spark, d):
    return dsp.constant(spark, 1000, 0.25)


def _samples(spark, d):
    return fr.sequences(events(spark, d))


def _flat(audio, digits: int = 5):
    rows = audio.select("utt_id", F.posexplode("samples").alias("frame_idx", "v"))
    return rows.select("utt_id", F.col("frame_idx").cast("long").alias("frame_idx"), (F.round("v", digits) + F.lit(0.0)).alias("v"))


@query(f"WITH {E_SQL} SELECT utt_id, frame_idx, round(v * cos(2 * pi() * 50 / 1000 * (frame_idx + 1)), 5) + 0.0 AS v FROM e")
def ring_modulation(spark, d):
    return _flat(dsp.ring_modulation(_samples(spark, d), 50.0, 1000))


@query(f"""WITH {E_SQL}, s AS (SELECT utt_id, frame_idx, v, coalesce(lag(v) OVER w, 0) AS a, coalesce(lag(v, 2) OVER w, 0) AS b FROM e WINDOW w AS (PARTITION BY utt_id ORDER BY frame_idx))
SELECT utt_id, frame_idx, round((0.5::DOUBLE * v + 0.3::DOUBLE * a - 0.2::DOUBLE * b) / 1, 5) + 0.0 AS v FROM s""")
def fir_filter(spark, d):
    return _flat(dsp.map_samples(_samples(spark, d), dsp.fir([0.5, 0.3, -0.2])))


def _recursion_sql(stages: list[tuple[str, str, str, str, str, str]]) -> str:
    """Second-order stages (input, b0, b1, b2, a1, a2), each fed by the expression of its input over the current row's v, i and the stages before it.

    Stage k keeps its last two inputs and outputs in the list s.
    """
    body, start = "", []
    for k, (source, b0, b1, b2, a1, a2) in enumerate(stages):
        o = 4 * k
        body += f", x{k} AS (SELECT *, {source} AS in{k} FROM {'j' if k == 0 else f'y{k - 1}'}), y{k} AS (SELECT *, {b0} * in{k} + {b1} * s[{o + 1}] + {b2} * s[{o + 2}] - {a1} * s[{o + 3}] - {a2} * s[{o + 4}] AS out{k} FROM x{k})"
        start += ["0.0::DOUBLE"] * 4
    state = ", ".join(f"in{k}, s[{4 * k + 1}], out{k}, s[{4 * k + 3}]" for k in range(len(stages)))
    return f"""f(utt_id, i, s) AS (SELECT DISTINCT utt_id, CAST(-1 AS BIGINT), [{", ".join(start)}] FROM e
  UNION ALL SELECT * FROM (WITH j AS (SELECT f.utt_id, e.frame_idx AS i, e.v, f.s FROM f JOIN e ON e.utt_id = f.utt_id AND e.frame_idx = f.i + 1){body}
  SELECT utt_id, i, [{state}] FROM y{len(stages) - 1}))"""


def _filtered_sql(stages: list, value: str) -> str:
    return f"WITH RECURSIVE {E_SQL}, {_recursion_sql(stages)} SELECT utt_id, i AS frame_idx, round({value}, 5) + 0.0 AS v FROM f WHERE i >= 0"


def _butterworth_stages(cut: float, source: str, first: int, high: bool = False) -> list:
    """Fourth order as two second-order sections of quality 1 / (2 cos(pi / 8)) and 1 / (2 cos(3 pi / 8)); cut over half the rate."""
    out = []
    for k, angle in enumerate(("pi() / 8", "3 * pi() / 8")):
        t, q = f"tan(pi() * {cut}::DOUBLE / 2)", f"(2 * cos({angle}))"
        norm = f"(1 + {t} * {q} + {t} * {t})"
        b = (f"1 / {norm}", f"-2 / {norm}", f"1 / {norm}") if high else (f"{t} * {t} / {norm}", f"2 * {t} * {t} / {norm}", f"{t} * {t} / {norm}")
        out.append((source if k == 0 else f"out{first}", *b, f"2 * ({t} * {t} - 1) / {norm}", f"(1 - {t} * {q} + {t} * {t}) / {norm}"))
    return out


@query(_filtered_sql([("v", "0.2::DOUBLE", "0.2::DOUBLE", "0", "-0.6::DOUBLE", "0")], "s[3]"))
def iir_filter(spark, d):
    return _flat(dsp.map_samples(_samples(spark, d), dsp.iir([0.2, 0.2], [1.0, -0.6])))


@query(_filtered_sql(_butterworth_stages(0.25, "v", 0), "s[7]"))
def butterworth(spark, d):
    return _flat(dsp.map_samples(_samples(spark, d), dsp.iir(*dsp.butterworth(4, 0.25, "low"))))


def _band_sql() -> str:
    """Second-order prototype over (s^2 + w) / (b s), multiplied out after the bilinear transform: four inputs and outputs back."""
    lo, hi = "tan(pi() * 0.2::DOUBLE / 2)", "tan(pi() * 0.5::DOUBLE / 2)"
    return f"""WITH RECURSIVE {E_SQL}, c0 AS (SELECT {hi} - {lo} AS b, {hi} * {lo} AS w), c1 AS (SELECT b, 1 + w AS p, 2 * w - 2 AS q, sqrt(2) * b AS r FROM c0),
c AS (SELECT p * p + r * p + b * b AS a0, 2 * p * q + r * q AS a1, 2 * p * p + q * q - 2 * b * b AS a2, 2 * p * q - r * q AS a3, p * p - r * p + b * b AS a4, b * b AS g FROM c1),
f(utt_id, i, x, y) AS (SELECT DISTINCT utt_id, CAST(-1 AS BIGINT), [0.0::DOUBLE, 0, 0, 0], [0.0::DOUBLE, 0, 0, 0] FROM e
  UNION ALL SELECT f.utt_id, e.frame_idx, [e.v, x[1], x[2], x[3]], [(g * (e.v - 2 * x[2] + x[4]) - a1 * y[1] - a2 * y[2] - a3 * y[3] - a4 * y[4]) / a0, y[1], y[2], y[3]]
  FROM f JOIN e ON e.utt_id = f.utt_id AND e.frame_idx = f.i + 1, c)
SELECT utt_id, i AS frame_idx, round(y[1], 5) + 0.0 AS v FROM f WHERE i >= 0"""


@query(_band_sql())
def butterworth_band(spark, d):
    return _flat(dsp.map_samples(_samples(spark, d), dsp.iir(*dsp.butterworth(2, (0.2, 0.5), "band"))))


# Blocks of 64 that start at every 32nd sample from -32 on; bins 4 to 12 of 15.625 Hz are kept, so a block is folded with their sum of cosines.
@query(f"""WITH {E_SQL}, n AS (SELECT utt_id, max(frame_idx) + 1 AS n FROM e GROUP BY utt_id), b AS (SELECT utt_id, 32 * j - 32 AS o0 FROM n, LATERAL unnest(generate_series(0, (n + 32) // 32 + 1)) AS t(j) WHERE 32 * j + 64 <= n + 96),
h AS (SELECT g, sum(cos(2 * pi() * k * g / 64)) * 2 / 64 AS h FROM (SELECT unnest(generate_series(-63, 63)) AS g), (SELECT unnest(generate_series(4, 12)) AS k) GROUP BY g),
x AS (SELECT b.utt_id, o0, frame_idx - o0 AS m, v * (1 - abs(frame_idx - o0 - 32) / 32::DOUBLE) AS v FROM b JOIN e ON e.utt_id = b.utt_id AND frame_idx BETWEEN o0 AND o0 + 63)
SELECT x.utt_id, o0 + o AS frame_idx, round(sum(v * h), 5) + 0.0 AS v FROM x, (SELECT unnest(generate_series(0, 63)) AS o), h, n WHERE h.g = o - m AND n.utt_id = x.utt_id AND o0 + o BETWEEN 0 AND n - 1 GROUP BY x.utt_id, o0 + o""")
def band_pass(spark, d):
    return _flat(dsp.map_samples(_samples(spark, d), dsp.band_pass([(50.0, 200.0)], 1000, 64)))


_RING = "cos(2 * pi() * {} * (i + 1) / 1000)"


@query(_filtered_sql([
    *_butterworth_stages(0.24, "v", 0), *_butterworth_stages(0.24, f"out1 * {_RING.format(120)}", 2),
    *_butterworth_stages(0.24, "v", 4, high=True), *_butterworth_stages(0.95, f"out5 * {_RING.format(595)}", 6),
], "s[15] + s[31]"))
def splitband_inversion(spark, d):
    return _flat(dsp.map_samples(_samples(spark, d), dsp.split_band_inversion(120.0, 1000, 4)))


@query(f"""WITH RECURSIVE {E_SQL}, n AS (SELECT *, coalesce(lead(v) OVER w, v) AS a, coalesce(lead(v, 2) OVER w, lead(v) OVER w, v) AS b FROM e WINDOW w AS (PARTITION BY utt_id ORDER BY frame_idx)),
f(utt_id, i, y, z) AS (SELECT utt_id, CAST(-1 AS BIGINT), v, v FROM e WHERE frame_idx = 0
  UNION ALL SELECT f.utt_id, n.frame_idx, list_sort([z, y, n.v, a, b])[3], y FROM f JOIN n ON n.utt_id = f.utt_id AND n.frame_idx = f.i + 1)
SELECT utt_id, i AS frame_idx, round(y, 5) + 0.0 AS v FROM f WHERE i >= 0""")
def median_recursive(spark, d):
    return _flat(dsp.map_samples(_samples(spark, d), dsp.recursive_median(5)))


def _pitch(spark, d):
    v = F.col("x")[0]
    return events(spark, d, "event_type").select("utt_id", "frame_idx", (v * 10).alias("f0"), (v * 12).alias("original"), (F.col("event_type") == "click").alias("selected"))


def _pitch_sql(new: str) -> str:
    return f"WITH {E_SQL}, p AS (SELECT utt_id, frame_idx, v * 10 AS f0, v * 12 AS original, event_type = 'click' AS s FROM e) SELECT utt_id, frame_idx, round(CASE WHEN s THEN {new} ELSE f0 END, 5) + 0.0 AS f0 FROM p"


def _edited(spark, d, action):
    return dsp.correct_pitch(_pitch(spark, d), action).select("utt_id", "frame_idx", (F.round("f0", 5) + F.lit(0.0)).alias("f0"))


@query(_pitch_sql("CASE WHEN f0 >= 100 THEN f0 / 2 ELSE f0 END"))
def pitch_half(spark, d):
    return _edited(spark, d, "half")


@query(_pitch_sql("CASE WHEN f0 <= 300 THEN f0 * 2 ELSE f0 END"))
def pitch_double(spark, d):
    return _edited(spark, d, "double")


@query(_pitch_sql("original"))
def pitch_reset(spark, d):
    return _edited(spark, d, "reset")


@query(_pitch_sql("0"))
def pitch_zero(spark, d):
    return _edited(spark, d, "zero")


# The tridiagonal system of second derivatives: eliminated forwards (c, g), solved backwards (m).
@query(f"""WITH RECURSIVE {E_SQL}, p AS (SELECT utt_id, frame_idx AS t, v * 10 AS f0, event_type = 'click' AS s FROM e),
k AS (SELECT utt_id, t, f0 AS y, row_number() OVER w AS j, t - lag(t) OVER w AS h, lead(t) OVER w - t AS hn, (lead(f0) OVER w - f0) / (lead(t) OVER w - t) - (f0 - lag(f0) OVER w) / (t - lag(t) OVER w) AS r,
  count(*) OVER (PARTITION BY utt_id) AS n FROM p WHERE s WINDOW w AS (PARTITION BY utt_id ORDER BY t)),
fw(utt_id, j, c, g) AS (SELECT utt_id, j, 0.0::DOUBLE, 0.0::DOUBLE FROM k WHERE j = 1
  UNION ALL SELECT k.utt_id, k.j, k.hn / (2 * (k.h + k.hn) - k.h * fw.c), (6 * k.r - k.h * fw.g) / (2 * (k.h + k.hn) - k.h * fw.c) FROM fw JOIN k ON k.utt_id = fw.utt_id AND k.j = fw.j + 1 WHERE k.j < k.n),
bw(utt_id, j, m) AS (SELECT utt_id, j, 0.0::DOUBLE FROM k WHERE j = n
  UNION ALL SELECT fw.utt_id, fw.j, CASE WHEN fw.j = 1 THEN 0.0 ELSE fw.g - fw.c * bw.m END FROM bw JOIN fw ON fw.utt_id = bw.utt_id AND fw.j = bw.j - 1),
q AS (SELECT k.utt_id, k.t, lead(k.t) OVER w AS u, y, lead(y) OVER w AS z, m, lead(m) OVER w AS mz FROM k JOIN bw USING (utt_id, j) WINDOW w AS (PARTITION BY k.utt_id ORDER BY k.t)),
i AS (SELECT p.utt_id, p.t, (u - p.t) / (u - q.t)::DOUBLE AS a, (p.t - q.t) / (u - q.t)::DOUBLE AS b, u - q.t AS h, y, z, m, mz FROM p JOIN q ON q.utt_id = p.utt_id AND p.t > q.t AND p.t < q.u)
SELECT p.utt_id, p.t AS frame_idx, round(coalesce(a * y + b * z + ((a * a * a - a) * m + (b * b * b - b) * mz) * h * h / 6, f0), 4) AS f0, s AS selected FROM p LEFT JOIN i USING (utt_id, t)""")
def spline_f0(spark, d):
    rows = dsp.refill_pitch(_pitch(spark, d).drop("original"))
    return rows.select("utt_id", "frame_idx", F.round("f0", 4).alias("f0"), "selected")


@query(f"""WITH {E_SQL} SELECT a.utt_id, a.frame_idx, round(sum(b.v * sin(pi() * (a.frame_idx + 0.5::DOUBLE - b.frame_idx)) / (pi() * (a.frame_idx + 0.5::DOUBLE - b.frame_idx))), 5) + 0.0 AS v
FROM e a JOIN e b ON b.utt_id = a.utt_id AND b.frame_idx BETWEEN a.frame_idx - 500 AND a.frame_idx + 500 WHERE a.frame_idx < (SELECT max(frame_idx) FROM e c WHERE c.utt_id = a.utt_id) GROUP BY a.utt_id, a.frame_idx""")
def sinc_interpolation(spark, d):
    return _flat(dsp.map_samples(_samples(spark, d), dsp.sinc_shift(0.5)))


@query(f"WITH {E_SQL}, s AS (SELECT utt_id, frame_idx, v FROM e WHERE frame_idx < 16) SELECT utt_id, CAST(k AS INTEGER) AS dim, round(CASE WHEN k = 0 THEN 0.54::DOUBLE - 0.46::DOUBLE ELSE 0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * k / 15) END, 6) AS w FROM (SELECT DISTINCT utt_id FROM s), LATERAL unnest(generate_series(0, 15)) AS t(k)")
def window_weights(spark, d):
    weights = F.array(*[F.lit(w) for w in W.hamming(16)])
    return events(spark, d).select("utt_id").distinct().select("utt_id", F.posexplode(weights).alias("dim", "w")).withColumn("w", F.round("w", 6))


@query(f"""WITH {_ACF} SELECT i.vec_id, CAST(d AS INTEGER) AS dim, round(coalesce(r, 0), 5) + 0.0 AS v FROM (SELECT DISTINCT vec_id FROM vl) i CROSS JOIN (SELECT unnest(generate_series(0, 255)) AS d) LEFT JOIN ac ON ac.vec_id = i.vec_id AND ac.k = d""")
def display_autocorrelation(spark, d):
    return _vec(sp.Chain(sp.display_autocorrelation()).apply(_v(spark, d)))


@query("SELECT CAST(k AS INTEGER) AS bin, k * 8000 / 256.0::DOUBLE AS hz FROM (SELECT unnest(generate_series(0, 256)) AS k)")
def frequency_bins(spark, d):
    step = sp.frequency_resolution(16000, 512)
    return spark.range(257).select(F.col("id").cast("int").alias("bin"), (F.col("id") * step).alias("hz"))


@query(f"""WITH {E_SQL}, n AS (SELECT *, lead(v) OVER (PARTITION BY utt_id ORDER BY frame_idx) AS b, min(v) OVER (PARTITION BY utt_id) AS lowest, max(v) OVER (PARTITION BY utt_id) AS highest FROM e)
SELECT utt_id, frame_idx, round(v + 0.25::DOUBLE * (b - v), 5) + 0.0 AS between, v AS before, lowest, highest FROM n WHERE b IS NOT NULL""")
def buffered_audio(spark, d):
    rows = _samples(spark, d).select("*", dsp.extent(F.col("samples")).alias("e"), F.explode(F.sequence(F.lit(0), F.size("samples") - 2)).alias("k"))
    t = F.col("k") + F.lit(0.25)
    return rows.select("utt_id", F.col("k").cast("long").alias("frame_idx"), (F.round(dsp.value_at(F.col("samples"), t), 5) + F.lit(0.0)).alias("between"), dsp.value_at(F.col("samples"), t, False).alias("before"), "e.lowest", "e.highest")


def _windowed_sql(weight: str) -> str:
    """Windows of 16 samples every 10 (wx), their transform to 257 bins of 31.25 Hz (ft) and power (pw); an id per frame."""
    raw = _framing_sql(weight).replace("round(", "(").replace(", 6) + 0.0 AS v", ") AS v")
    return f"""wx AS ({raw}), kk AS (SELECT unnest(generate_series(0, 256)) AS k),
ft AS (SELECT utt_id, frame_idx, k, sum(v * cos(2 * pi() * dim * k / 512)) AS re, sum(v * sin(2 * pi() * dim * k / 512)) AS im FROM wx, kk GROUP BY utt_id, frame_idx, k),
pw AS (SELECT utt_id, frame_idx, k, CASE WHEN k = 0 THEN abs(re) ELSE re * re + im * im END AS p, sqrt(re * re + im * im) AS m FROM ft)"""


@query(f"""WITH {_windowed_sql("1")}, l AS (SELECT utt_id, frame_idx, k, 20 * log10(greatest(m / greatest(sum(m) OVER (PARTITION BY utt_id, frame_idx), 1e-300), 1e-300)) AS v FROM pw)
SELECT utt_id, frame_idx, CAST(k AS INTEGER) AS dim, round(power((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 0.5::DOUBLE), 4) AS v FROM l""")
def spectrogram(spark, d):
    return fr.long_form(ft.spectrogram(_samples(spark, d), 16000, "rect,16s,10s", 0.5), digits=4)


@query(f"""WITH {_windowed_sql("0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / 15)")}, {_mel_sql()}, lb AS (SELECT utt_id, frame_idx, i, ln(sum(p * w) + 0.000001::DOUBLE) AS y FROM pw JOIN bk USING (k) GROUP BY utt_id, frame_idx, i)
SELECT utt_id, frame_idx, CAST(c AS INTEGER) AS dim, round(sum(y * cos(pi() * (i + 0.5::DOUBLE) * c / n)) * sqrt(CASE WHEN c = 0 THEN 1 ELSE 2 END / any_value(n)::DOUBLE), 5) + 0.0 AS v
FROM lb, mn, (SELECT unnest(generate_series(0, 11)) AS c) GROUP BY utt_id, frame_idx, c""")
def extraction(spark, d):
    """Features by parameter strings: windows, spectrum, mel bank, DCT and selection in one plan."""
    return fr.long_form(ft.extract(_samples(spark, d), 16000, "hamm,16s,10s", "", "0-11"), digits=5)


@query(_pitch_sql("123.0"))
def pitch_set(spark, d):
    return dsp.correct_pitch(_pitch(spark, d), "set", 123.0).select("utt_id", "frame_idx", (F.round("f0", 5) + F.lit(0.0)).alias("f0"))
