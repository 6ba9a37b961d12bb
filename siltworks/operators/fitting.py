"""Least-squares fits as aggregates: parabolas per budget, power laws across budgets, leave-one-out errors, elbows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parabolas(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, a, b, c, low, high): least squares of y = a x^2 + b x + c. x is centred on the group's mean, so that power sums keep their
    digits; null where fewer than three different x leave it undefined. low and high bound x. NaN and null points are left out."""
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x)) & ~F.isnan(F.col(y)))
    mean = F.avg(x).over(Window.partitionBy(*by))
    u = p.withColumn("_m", mean).withColumn("_u", F.col(x) - F.col("_m"))
    s = u.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.first("_m").alias("m"), F.min(x).alias("low"), F.max(x).alias("high"), F.countDistinct(x).alias("k"),
        F.sum(F.col("_u") ** 2).alias("s2"), F.sum(F.col("_u") ** 3).alias("s3"), F.sum(F.col("_u") ** 4).alias("s4"),
        F.sum(y).alias("y0"), F.sum(F.col("_u") * F.col(y)).alias("y1"), F.sum(F.col("_u") ** 2 * F.col(y)).alias("y2"),
    )
    det = F.expr("n * s2 * s4 - n * s3 * s3 - s2 * s2 * s2")
    ok = (F.col("k") >= 3) & (det != 0)
    fit = (
        s.withColumn("a", F.when(ok, F.expr("n * s2 * y2 - n * s3 * y1 - s2 * s2 * y0") / F.when(ok, det)))
        .withColumn("_b", F.when(ok, F.expr("n * s4 * y1 - n * s3 * y2 + s2 * s3 * y0 - s2 * s2 * y1") / F.when(ok, det)))
        .withColumn("_c", (F.col("y0") - F.col("a") * F.col("s2")) / F.col("n"))
    )
    return fit.select(
        *by, F.col("n").cast("long").alias("n"), "a",
        (F.col("_b") - 2 * F.col("a") * F.col("m")).alias("b"),
        (F.col("_c") - F.col("_b") * F.col("m") + F.col("a") * F.col("m") * F.col("m")).alias("c"),
        (F.col("m") - F.col("_b") / F.when(F.col("a") != 0, 2 * F.col("a"))).alias("x_min"),
        (F.col("_c") - F.col("_b") * F.col("_b") / F.when(F.col("a") != 0, 4 * F.col("a"))).alias("y_min"),
        "low", "high",
    )


def bracketed_minima(fits: DataFrame) -> DataFrame:
    """The fits with a minimum inside the range of their points."""
    return fits.where("a > 0 AND x_min BETWEEN low AND high")


def power_laws(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, points, coefficient, exponent) of y = coefficient * x^exponent, by least squares of the logarithms."""
    lx, ly = F.ln(F.col(x)), F.ln(F.col(y))
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.exp(F.regr_intercept(ly, lx)).alias("coefficient"), F.regr_slope(ly, lx).alias("exponent"))


def jackknife(points: DataFrame, by: list[str], unit: str, x: str, y: str) -> DataFrame:
    """(by, points, se): leave-one-out standard error of the power law's exponent; NaN for fewer than three points. The sums of all
    points less those of one give each fit, so that the points need not be joined with each other."""
    lx, ly = F.ln(F.col(x)), F.ln(F.col(y))
    w = Window.partitionBy(*by)
    c = points.withColumn("_x", lx - F.avg(lx).over(w)).withColumn("_y", ly - F.avg(ly).over(w))
    for name, e in (("n", F.lit(1.0)), ("sx", F.col("_x")), ("sy", F.col("_y")), ("sxx", F.col("_x") ** 2), ("sxy", F.col("_x") * F.col("_y"))):
        c = c.withColumn(f"_{name}", F.sum(e).over(w) - e)
    det = F.col("_n") * F.col("_sxx") - F.col("_sx") ** 2
    drop = c.withColumn("_d", (F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / F.when(det != 0, det))
    return drop.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"),
        F.when(F.count(F.lit(1)) >= 3, F.sqrt((F.count(F.lit(1)) - 1) * F.var_pop("_d"))).otherwise(F.lit(float("nan"))).alias("se"),
    )


def agreement(df: DataFrame, gap: str, se: str, most: float = 2.0) -> DataFrame:
    """df with sigmas and agree: null (and NaN) where the error is unknown, a gap over an error of 0 being infinite."""
    g, s = F.col(gap), F.col(se)
    unknown = s.isNull() | F.isnan(s)
    sigmas = F.when(unknown, F.lit(float("nan"))).when(s > 0, g / F.when(s > 0, s)).when(g > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return df.withColumn("sigmas", sigmas).withColumn("agree", F.when(~unknown, F.col("sigmas") <= most))


def elbows(curves: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, candidates, chosen, knee): the elbow of a concave rising curve by Kneedle, over the rank of x: the first local maximum of the
    normalized difference from the chord after which it falls below its threshold; without one, the middle candidate."""
    w = Window.partitionBy(*by)
    o = w.orderBy(x)
    r = curves.withColumn("_i", F.row_number().over(o) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    span = F.max(y).over(w) - F.min(y).over(w)
    d = r.withColumn("_d", F.when((F.col("_n") > 1) & (span > 0), (F.col(y) - F.min(y).over(w)) / F.when(span > 0, span) - F.col("_i") / F.when(F.col("_n") > 1, F.col("_n") - 1)))
    d = d.withColumn("_p", F.lag("_d").over(o)).withColumn("_q", F.lead("_d").over(o))
    peak = d.withColumn("_peak", (F.col("_d") >= F.col("_p")) & (F.col("_d") >= F.col("_q")) & (F.col("_d") > 1e-9))
    # of a peak, the threshold lies one mean step of the rank below it
    peak = peak.withColumn("_t", F.when(F.col("_peak"), F.col("_d") - 1 / F.when(F.col("_n") > 1, F.col("_n") - 1)))
    rows = peak.groupBy(*by).agg(F.max("_n").alias("candidates"), F.array_sort(F.collect_list(F.struct("_i", F.col(x).alias("x"), "_d", "_peak", "_t"))).alias("c"))
    # a peak counts if the difference falls below its threshold before the next peak (or at the end)
    falls = """filter(c, p -> p._peak AND exists(c, q -> q._i > p._i AND q._d < p._t AND NOT exists(c, z -> z._peak AND z._i > p._i AND z._i < q._i)))"""
    return rows.withColumn("k", F.expr(falls)).select(*by, "candidates", F.when(F.size("k") > 0, F.col("k")[0]["x"]).otherwise(F.expr("c[cast(candidates div 2 as int)].x")).alias("chosen"), (F.size("k") > 0).alias("knee"))
