"""Statistics of sections and beats, as aggregates over DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.scalars import clean
from pulseloom.operators.framing import ordered, placed


def safe_mean(x: Column, places: int) -> Column:
    """Mean without nulls and NaN, rounded; null if nothing is left."""
    return F.round(F.avg(clean(x)), places)


def hjorth(samples: DataFrame, *keys: str) -> DataFrame:
    """(keys, hjorth): mobility of the first difference over mobility; 0 for a flat signal."""
    w = ordered(*keys)
    d = samples.withColumn("_d", F.col("v") - F.lag("v").over(w)).withColumn("_dd", F.col("_d") - F.lag("_d").over(w))
    z, a, b = F.var_pop("v"), F.var_pop("_d"), F.var_pop("_dd")
    return d.groupBy(*keys).agg(F.when((z == 0) | (a == 0), 0.0).otherwise(F.sqrt(b / a) / F.sqrt(a / z)).alias("hjorth"))


def shape(samples: DataFrame, *keys: str) -> DataFrame:
    """Per section: n, mean, kurtosis (excess, population), ptp, P35, P95, signal-to-noise (0 if flat)."""
    sd = F.stddev_pop("v")
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.kurtosis("v").alias("kurtosis"), (F.max("v") - F.min("v")).alias("ptp"),
        F.percentile("v", F.lit(0.35)).alias("p35"), F.percentile("v", F.lit(0.95)).alias("p95"), F.when(sd == 0, 0.0).otherwise(F.avg("v") / sd).alias("snr"),
    )


def shape_and_hjorth(samples: DataFrame, *keys: str) -> DataFrame:
    """shape and hjorth together: one shuffle by the keys serves the differences and the aggregate."""
    w, sd = ordered(*keys), F.stddev_pop("v")
    d = samples.withColumn("_d", F.col("v") - F.lag("v").over(w)).withColumn("_dd", F.col("_d") - F.lag("_d").over(w))
    z, a, b = F.var_pop("v"), F.var_pop("_d"), F.var_pop("_dd")
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.kurtosis("v").alias("kurtosis"), (F.max("v") - F.min("v")).alias("ptp"), F.percentile("v", F.array(F.lit(0.35), F.lit(0.95))).alias("_p"),
        F.when(sd == 0, 0.0).otherwise(F.avg("v") / sd).alias("snr"), F.when((z == 0) | (a == 0), 0.0).otherwise(F.sqrt(b / a) / F.sqrt(a / z)).alias("hjorth"),
    ).withColumns({"p35": F.col("_p")[0], "p95": F.col("_p")[1]}).drop("_p")


def median_mad(samples: DataFrame, *keys: str) -> DataFrame:
    med = F.percentile("v", F.lit(0.5)).over(Window.partitionBy(*keys))
    return samples.withColumn("_m", med).groupBy(*keys).agg(F.first("_m").alias("median"), F.percentile(F.abs(F.col("v") - F.col("_m")), F.lit(0.5)).alias("mad"))


def adjacent_rr(peaks: DataFrame, fs: float, *keys: str) -> DataFrame:
    """RR of neighbouring peaks that both are valid: (keys, r_idx, rr_ms, hr), hr in beats a minute."""
    w = ordered(*keys, by="r_idx")
    pairs = peaks.withColumns({"_n": F.lead("r_idx").over(w), "_v": F.lead("valid").over(w)}).where("valid = 1 and _v = 1")
    rr = (F.col("_n") - F.col("r_idx")) / fs
    return pairs.select(*keys, "r_idx", (rr * 1000.0).alias("rr_ms"), (60.0 / rr).alias("hr"))


def hrv(rr: DataFrame, *keys: str) -> DataFrame:
    """Heart-rate statistics of sections with two intervals or more: HR, SDNN (population deviation of the rate), sdnn_ms, RMSSD, NN50,
    PNN50, min_HR, max_HR."""
    w = ordered(*keys, by="r_idx")
    d = rr.withColumn("_d", F.col("rr_ms") - F.lag("rr_ms").over(w))
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg("hr"), 2).alias("HR"), F.round(F.stddev_pop("hr"), 5).alias("SDNN"), F.round(F.stddev_pop("rr_ms"), 5).alias("sdnn_ms"),
        F.round(F.sqrt(F.avg(F.col("_d") * F.col("_d"))), 5).alias("RMSSD"), F.count_if(F.abs("_d") > 50).alias("NN50"), F.round(100.0 * F.count_if(F.abs("_d") > 50) / F.count("*"), 4).alias("PNN50"),
        F.round(F.min("hr"), 4).alias("min_HR"), F.round(F.max("hr"), 4).alias("max_HR"),
    ).where("n >= 2")


def qtvi(rows: DataFrame, *keys: str) -> DataFrame:
    """QT variability index of (qt, rr), 2 decimals; null with fewer than two values of either, or a variance of 0."""
    norm = lambda x: F.var_samp(clean(F.col(x))) / F.pow(F.avg(clean(F.col(x))), F.lit(2.0))
    enough = (F.count(clean(F.col("qt"))) >= 2) & (F.count(clean(F.col("rr"))) >= 2)
    q, r = norm("qt"), norm("rr")
    return rows.groupBy(*keys).agg(F.when(enough & (q > 0) & (r > 0), F.round(F.log10(q / r), 2)).alias("qtvi"))


def interval_means(beats: DataFrame, *keys: str, columns=("PR", "QRS", "ST", "QT", "QTc", "TpTe")) -> DataFrame:
    """Means of the intervals without zeros, 1 decimal."""
    return beats.groupBy(*keys).agg(*[safe_mean(F.nullif(F.col(c).cast("double"), F.lit(0.0)), 1).alias(c) for c in columns])


def circular(angles: DataFrame, *keys: str) -> DataFrame:
    """(keys, mean_angle, variance) of ``angle`` in radians."""
    c, s = F.avg(F.cos("angle")), F.avg(F.sin("angle"))
    return angles.groupBy(*keys).agg(F.atan2(s, c).alias("mean_angle"), (1 - F.sqrt(c * c + s * s)).alias("variance"))


def trapezoid(samples: DataFrame, dx: float, *keys: str) -> DataFrame:
    """(keys, area) by the trapezoid rule over steps of dx."""
    w = ordered(*keys)
    return samples.withColumn("_a", (F.col("v") + F.lead("v").over(w)) / 2.0 * dx).groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def linear_fit(samples: DataFrame, *keys: str) -> DataFrame:
    """Least-squares line of v over idx, and of idx over v (inverse_slope)."""
    return samples.groupBy(*keys).agg(F.regr_slope("v", "idx").alias("slope"), F.regr_intercept("v", "idx").alias("intercept"), F.regr_slope("idx", "v").alias("inverse_slope"))


def rmse(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), F.lit(2.0)))).alias("rmse"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, t: s + t)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def majority(rows: DataFrame, label: str, order: str, *keys: str) -> DataFrame:
    """The most frequent label of each group; ties to the one seen first."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("_first")).alias("_f"), F.col(label).alias("label")))["label"].alias("label"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def unpivoted(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_")).select("_.*")


def summary_nonzero(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std, max, min, n) of values that are neither null nor 0, in one pass."""
    x = unpivoted(rows, columns).where("x is not null and not isnan(x) and x <> 0")
    return x.groupBy("column").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.max("x").alias("max"), F.min("x").alias("min"), F.count("*").alias("n"))


def null_report(rows: DataFrame, columns: list[str], limit: float = 30.0) -> DataFrame:
    """(column, nulls, percent, high): nulls and NaN of each column, high if over ``limit`` percent."""
    x = unpivoted(rows, columns)
    nulls = F.count_if(F.col("x").isNull() | F.isnan("x"))
    return x.groupBy("column").agg(nulls.alias("nulls"), (100.0 * nulls / F.count("*")).alias("percent")).withColumn("high", F.col("percent") > limit)


def numeric_report(rows: DataFrame, columns: list[str], limit: float = 30.0) -> DataFrame:
    """(column, mean, std, max, min, n, nulls, percent, high): of the values that are neither null nor 0, and the share of nulls, in one pass."""
    x = unpivoted(rows, columns)
    missing = F.col("x").isNull() | F.isnan("x")
    kept = F.when(~missing & (F.col("x") != 0), F.col("x"))
    got = x.groupBy("column").agg(F.avg(kept).alias("mean"), F.stddev_samp(kept).alias("std"), F.max(kept).alias("max"), F.min(kept).alias("min"), F.count(kept).alias("n"), F.count_if(missing).alias("nulls"), (100.0 * F.count_if(missing) / F.count("*")).alias("percent"))
    return got.withColumn("high", F.col("percent") > limit)


def cosine_of_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, cosine) for a < b of feature columns, nulls replaced by their column's mean; 0 if either is nothing but 0."""
    means = rows.agg(*[F.avg(clean(F.col(c).cast("double"))).alias(f"_m_{c}") for c in columns])
    full = rows.join(F.broadcast(means)).select(*[F.coalesce(clean(F.col(c).cast("double")), F.col(f"_m_{c}")).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = full.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs], *[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"|{c}") for c in columns])
    size = lambda a, b: F.col(f"`|{a}`") * F.col(f"`|{b}`")
    out = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(size(a, b) > 0, F.col(f"`{a}|{b}`") / size(a, b)).otherwise(0.0).alias("cosine")) for a, b in pairs])
    return one.select(F.explode(out).alias("_")).select("_.*")


def bad_ratio(peaks: DataFrame, *keys: str, most: float = 0.25) -> DataFrame:
    """Share of beats that are not valid; the section is valid up to ``most``."""
    r = F.avg((F.col("valid") == 0).cast("double"))
    return peaks.groupBy(*keys).agg(r.alias("ratio"), (r <= most).alias("ok"))


def running_sum(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to each row in ascending ``order`` (distinct). Blocks in that order are summed side by
    side and then shifted by the blocks before; only one row a block meets in one task."""
    blocks = placed(rows, order)
    part = blocks.withColumn("_part", F.sum(value).over(Window.partitionBy("_b").orderBy(order)))
    shift = F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.groupBy("_b").agg(F.sum(value).alias("_t")).select("_b", shift.alias("_o"))
    return part.join(F.broadcast(offsets), "_b").withColumn(name, F.col("_part") + F.col("_o")).drop("_b", "_part", "_o")


def spearman(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho) for a < b: correlation of average ranks. Ranks come from value counts, reduced before they are ordered."""
    ranked = rows.select(*columns).where(" and ".join(f"{c} is not null" for c in columns))
    for c in columns:
        counts = ranked.groupBy(c).agg(F.count("*").alias("_n"))
        upto = running_sum(counts, c, "_n", "_upto")
        ranked = ranked.join(upto.select(c, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(f"_r_{c}")), c)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = ranked.agg(*[F.corr(f"_r_{a}", f"_r_{b}").alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs])).alias("_")).select("_.*")


def time_in_class(rows: DataFrame, keys: list[str], label: Column) -> DataFrame:
    return rows.groupBy(*keys, label.alias("label")).agg(F.count("*").alias("n"))
