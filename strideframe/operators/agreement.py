"""Rater agreement and descriptive statistics. Ratings are ``(subject_id, rater_id, rating)``, null where missing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strideframe.operators.order import total_before

Metric = Callable[[Column, Column], Column]


def nominal(a: Column, b: Column) -> Column:
    """1 for equal ratings."""
    return (a == b).cast("double")


def nominal_distance(a: Column, b: Column) -> Column:
    return (a != b).cast("double")


def interval_distance(a: Column, b: Column) -> Column:
    return (a - b) * (a - b) * F.lit(1.0)


def ratio_distance(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide((a - b) * (a - b) * F.lit(1.0), (a + b) * (a + b)), F.lit(0.0))


def cicchetti(span: Column | float, squared: bool = False) -> Metric:
    """Weight 1 - |a - b| / (span - 1), or of the squares."""
    span = span if isinstance(span, Column) else F.lit(float(span))

    def weight(a: Column, b: Column) -> Column:
        d, c = F.abs(a - b) * F.lit(1.0), span - 1
        return 1 - (F.try_divide(d * d, c * c) if squared else F.try_divide(d, c))

    return weight


def kappa(ratings: DataFrame, weight: Metric = nominal) -> DataFrame:
    """One row (kappa): pairwise weighted kappas combined by one minus their chance agreement; ratings are integers >= 0.

    Subjects meet by an equi-join, raters pair off per subject; everything after is over categories, not subjects.
    """
    a = ratings.select("subject_id", F.col("rater_id").alias("r1"), F.col("rating").alias("x")).filter("x IS NOT NULL")
    b = ratings.select("subject_id", F.col("rater_id").alias("r2"), F.col("rating").alias("y")).filter("y IS NOT NULL")
    cells = a.join(b, "subject_id").filter("r1 < r2").groupBy("r1", "r2", "x", "y").agg(F.count("*").alias("n"))
    total = cells.groupBy("r1", "r2").agg(F.sum("n").alias("t"), F.sum(F.col("n") * weight(F.col("x"), F.col("y"))).alias("o"))
    px, py = cells.groupBy("r1", "r2", "x").agg(F.sum("n").alias("nx")), cells.groupBy("r1", "r2", "y").agg(F.sum("n").alias("ny"))
    chance = px.join(py, ["r1", "r2"]).groupBy("r1", "r2").agg(F.sum(F.col("nx") * F.col("ny") * weight(F.col("x"), F.col("y"))).alias("e"))
    each = total.join(chance, ["r1", "r2"]).select((F.col("o") / F.col("t")).alias("o"), (F.col("e") / (F.col("t") * F.col("t"))).alias("e"))
    # Sum of (1 - e) * (o - e) / (1 - e) over the sum of (1 - e).
    return each.agg(F.try_divide(F.sum(F.col("o") - F.col("e")), F.sum(1 - F.col("e"))).alias("kappa"))


def span_of(ratings: DataFrame) -> float:
    """Largest (0 at least) minus smallest rating, as the weights by span need it."""
    r = ratings.agg(F.greatest(F.max("rating"), F.lit(0)).alias("hi"), F.min("rating").alias("lo")).first()
    return float(r["hi"] - r["lo"])


def _pair_sum(n: Column, c: Column, distance: Metric) -> Column:
    """Sum over pairs of different classes of the products of their counts and their distance, as an aggregate over classes."""
    if distance is nominal_distance:
        return (F.sum(n) * F.sum(n) - F.sum(n * n)) / 2
    return F.sum(n) * F.sum(n * c * c) - F.sum(n * c) * F.sum(n * c)


def alpha(ratings: DataFrame, distance: Metric = nominal_distance, on: str = "index") -> DataFrame:
    """One row (alpha): 1 - observed over expected disagreement, on 1-based class indices or on the values.

    Nominal and interval distances have sums over classes, so no pairs are made. Other metrics pair off the classes of
    each subject, and all classes with each other: their cost grows with the square of the number of different ratings.
    """
    valid = ratings.filter("rating IS NOT NULL")
    # Counts per subject and class keep the pairs of a subject out of the plan.
    cells = valid.groupBy("subject_id", "rating").agg(F.count("*").alias("n"))
    cells = cells.withColumn("m", F.sum("n").over(Window.partitionBy("subject_id"))).filter("m > 1")
    if on == "index":
        places = total_before(cells.select("rating").distinct(), "rating", F.lit(1)).select("rating", (F.col("before") + 1).cast("double").alias("c"))
        cells = cells.join(places, "rating")
    else:
        cells = cells.withColumn("c", F.col("rating").cast("double"))
    n, c = F.col("n").cast("double"), F.col("c")
    sums = cells.groupBy("c").agg(F.sum("n").alias("n"))
    if distance in (nominal_distance, interval_distance):
        each = cells.groupBy("subject_id", "m").agg(_pair_sum(n, c, distance).alias("d"))
        observed = each.agg(F.coalesce(F.sum(F.col("d") / (F.col("m") - 1)), F.lit(0.0)).alias("do"))
        expected = sums.agg(F.coalesce(_pair_sum(n, c, distance), F.lit(0.0)).alias("de"))
    else:
        left, right = cells.select("subject_id", "m", F.col("c").alias("a"), F.col("n").alias("na")), cells.select("subject_id", F.col("c").alias("b"), F.col("n").alias("nb"))
        observed = left.join(right, "subject_id").filter("a < b").agg(
            F.coalesce(F.sum(F.col("na") * F.col("nb") / (F.col("m") - 1) * distance(F.col("a"), F.col("b"))), F.lit(0.0)).alias("do"))
        x, y = sums.select(F.col("c").alias("a"), F.col("n").alias("na")), sums.select(F.col("c").alias("b"), F.col("n").alias("nb"))
        expected = x.join(y, F.col("a") < F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb") * distance(F.col("a"), F.col("b"))), F.lit(0.0)).alias("de"))
    return sums.agg(F.sum("n").alias("n")).crossJoin(observed).crossJoin(expected).select((1 - F.try_divide((F.col("n") - 1) * F.col("do"), F.col("de"))).alias("alpha"))  # one row each


METRICS: dict[str, Metric] = {"nominal": nominal_distance, "interval": interval_distance, "ratio": ratio_distance}


def register_metric(name: str, distance: Metric) -> None:
    """Make a distance known by name, as the command-line tools look it up."""
    METRICS[name] = distance


def add_rater(ratings: DataFrame, rater_id: str, own: DataFrame) -> DataFrame:
    """ratings with those of one more rater (subject_id, rating); an error when the plan runs if the rater is there already."""
    known = ratings.filter(F.when(F.col("rater_id") == rater_id, F.raise_error(F.lit(f"rater {rater_id} is there already")).cast("boolean")).otherwise(F.lit(True)))
    return known.unionByName(own.select("subject_id", F.lit(rater_id).alias("rater_id"), F.col("rating").cast("double").alias("rating")))


def basic_stats(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(by..., n, lo, hi, median, mean, sd): upper median, population deviation."""
    rows = df.select(*by, F.col(column).alias("_v")).filter("_v IS NOT NULL")
    order = Window.partitionBy(*by).orderBy("_v")
    if by:
        ranked = rows.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
        mid = ranked.filter(F.col("_k") == F.floor(F.col("_n") / 2) + 1).select(*by, F.col("_v").alias("median"))
        plain = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("sd"))
        return plain.join(mid, list(by)).select(*by, "n", "lo", "hi", "median", "mean", "sd")
    # Over everything: counts per value and a running sum over values, not one task over rows.
    counts = rows.groupBy("_v").agg(F.count("*").alias("c"))
    total = rows.agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("sd"))
    upto = total_before(counts, "_v", "c")
    one = F.broadcast(total)  # one row
    mid = upto.crossJoin(one).filter(F.col("before") + F.col("c") > F.floor(F.col("n") / 2)).agg(F.min("_v").alias("median"))
    return total.crossJoin(mid).select("n", "lo", "hi", "median", "mean", "sd")


def histogram(df: DataFrame, column: str, precision: float = 0.0) -> DataFrame:
    """(bin, n): counts by value truncated toward zero to a multiple of the precision; 0: by value."""
    v = F.col(column)
    key = (v / precision).cast("long") * precision if precision else v
    return df.filter(v.isNotNull()).groupBy(key.alias("bin")).agg(F.count("*").alias("n"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("pearson"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (spearman): 1 - 6 sum d^2 / (n (n^2 - 1)) over average ranks, ties included."""
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")

    def ranks(c: str) -> DataFrame:
        # Average rank per distinct value from counts: rows before it plus the middle of its ties.
        counts = rows.groupBy(c).agg(F.count("*").alias("n"))
        return total_before(counts, c, "n").select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    cells = rows.groupBy("a", "b").agg(F.count("*").alias("c")).join(ranks("a"), "a").join(ranks("b"), "b")
    d = F.col("ra") - F.col("rb")
    n = F.col("n").cast("double")
    return cells.agg(F.sum("c").alias("n"), F.sum(F.col("c") * d * d).alias("d2")).select((1 - F.try_divide(6 * F.col("d2"), n * (n * n - 1))).alias("spearman"))


def categorize(v: Column, thresholds: Sequence[float]) -> Column:
    """len - c + 1 for the last threshold c (counted from 0) that v exceeds, 0 if none."""
    code = F.lit(0)
    for c, t in enumerate(thresholds):
        code = F.when(v > t, len(thresholds) - c).otherwise(code)
    return code.cast("double")


def equidistant(df: DataFrame, column: str, classes: int) -> DataFrame:
    """df with ``category``: the thresholds divide the range between the extremes by 1 + classes."""
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / (1 + classes)
    v = F.col(column)
    code = F.lit(0)
    for c in range(classes):
        code = F.when(v > F.col("_lo") + step * (c + 1), classes - c).otherwise(code)
    return df.crossJoin(F.broadcast(span)).withColumn("category", code.cast("double")).drop("_lo", "_hi")


def peak_prominence(df: DataFrame, utt: str, index: str, value: str) -> DataFrame:
    """(utt, peak_at, prominence): the largest value (first of equals) above the regression line of all others."""
    top = df.groupBy(utt).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(index)).alias("i"))).alias("p")).select(utt, F.col("p.v").alias("peak"), (-F.col("p.i")).alias("peak_at"))
    rest = df.join(top, utt).filter(F.col(index) != F.col("peak_at"))
    lines = rest.groupBy(utt).agg(F.regr_slope(value, index).alias("k"), F.regr_intercept(value, index).alias("b"))
    return top.join(lines, utt).select(utt, "peak_at", (F.col("peak") - (F.col("k") * F.col("peak_at") + F.col("b"))).alias("prominence"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(class, n, recall, precision, f) of every class, and the macro average as class ``average``."""
    cells = df.groupBy(F.col(truth).cast("string").alias("c"), F.col(guess).cast("string").alias("y")).agg(F.count("*").alias("n"))
    rows = cells.groupBy(F.col("c").alias("class")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("c") == F.col("y"), F.col("n")).otherwise(0)).alias("hit"))
    columns = cells.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("guessed"))
    each = rows.join(columns, "class", "left").select(
        "class", "n", (F.col("hit") / F.col("n")).alias("recall"), F.coalesce(F.try_divide(F.col("hit"), F.col("guessed")), F.lit(0.0)).alias("precision"),
    ).withColumn("f", F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), F.lit(0.0)))
    mean = each.agg(F.lit("average").alias("class"), F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("recall", "precision", "f")])
    return each.unionByName(mean)


def compare_streams(a: DataFrame, b: DataFrame) -> DataFrame:
    """(dim, mean_a, mean_b, mean_abs): column means and mean absolute difference of two streams, by place."""
    both = a.select("utt_id", "frame_idx", F.col("x").alias("a")).join(b.select("utt_id", "frame_idx", F.col("x").alias("b")), ["utt_id", "frame_idx"])
    long = both.select(F.posexplode(F.arrays_zip("a", "b")).alias("dim", "s"))
    return long.groupBy("dim").agg(F.avg("s.a").alias("mean_a"), F.avg("s.b").alias("mean_b"), F.avg(F.abs(F.col("s.a") - F.col("s.b"))).alias("mean_abs"))


def clock(seconds: Column) -> Column:
    """hh:mm:ss of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def durations(files: DataFrame, file: str, samples: str, rate: int) -> DataFrame:
    """(file, n_samples, length): per file, and the total in a row of null file."""
    return files.rollup(file).agg(F.sum(samples).alias("n_samples")).select(F.col(file), "n_samples", clock(F.col("n_samples") / rate).alias("length"))
