"""Preparation of feature tables: nulls, outliers, imputation, subject normalisation, scaling, transforms, folds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.scalars import clean
from pulseloom.operators.framing import numbered
from pulseloom.operators.stats import running_sum


def drop_any_null(rows: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        rows = rows.where(clean(F.col(c).cast("double")).isNotNull())
    return rows


def drop_zeros(rows: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        rows = rows.where(F.col(c) != 0)
    return rows


def quantiles(rows: DataFrame, column: str, probabilities: tuple[float, ...]) -> DataFrame:
    """One row (q0, q1, ...): exact quantiles by linear interpolation, nulls and NaN left out.

    They are read off the running sum of the values' counts, which is taken in range-partitioned blocks: no task sees the whole column.
    """
    counts = rows.select(clean(F.col(column).cast("double")).alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("_n"))
    upto = running_sum(counts, "_v", "_n", "_upto").join(F.broadcast(counts.agg(F.sum("_n").alias("_all"))))
    parts, out = [], []
    for i, q in enumerate(probabilities):
        at = F.lit(float(q)) * (F.col("_all") - 1)
        low = F.floor(at)
        high = F.least(low + 1, F.col("_all") - 1)
        parts += [F.min(F.when(F.col("_upto") > low, F.col("_v"))).alias(f"_l{i}"), F.min(F.when(F.col("_upto") > high, F.col("_v"))).alias(f"_h{i}"), F.max(at - low).alias(f"_w{i}")]
        out.append((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_w{i}")).alias(f"q{i}"))
    return upto.agg(*parts).select(*out)


def impute(rows: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Nulls and NaN replaced by the column's mean, median or mode (the least of several)."""
    for c in columns:
        if how == "mean":
            one = rows.agg(F.avg(clean(F.col(c))).alias("_one"))
        elif how == "median":
            one = quantiles(rows, c, (0.5,)).select(F.col("q0").alias("_one"))
        else:
            counts = rows.select(clean(F.col(c)).alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("_n"))
            one = counts.agg(F.max(F.struct("_n", (-F.col("_v")).alias("m")))["m"].alias("m")).select((-F.col("m")).alias("_one"))
        rows = rows.join(F.broadcast(one)).withColumn(c, F.coalesce(clean(F.col(c)), F.col("_one"))).drop("_one")
    return rows


def outliers(rows: DataFrame, columns: list[str], k: float = 6.0) -> DataFrame:
    """Rows within k interquartile ranges of the quartiles, or null; column after column, quartiles taken anew each time."""
    for c in columns:
        q = quantiles(rows, c, (0.25, 0.75)).select(F.col("q0").alias("_low"), F.col("q1").alias("_high"))
        spread = F.col("_high") - F.col("_low")
        inside = F.col(c).isNull() | F.col(c).between(F.col("_low") - k * spread, F.col("_high") + k * spread)
        rows = rows.join(F.broadcast(q)).where(inside).drop("_low", "_high")
    return rows


def subject_normalised(rows: DataFrame, columns: list[str], subject: str, baseline: Column, order: str) -> DataFrame:
    """(x - b) / (|b| + 1e-6), b the mean of a subject's baseline rows, else of its first tenth of rows (one at least)."""
    w = Window.partitionBy(subject)
    marked = rows.withColumns({"_base": baseline, "_k": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    early = F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    marked = marked.withColumns({f"_b_{c}": F.coalesce(F.avg(F.when(F.col("_base"), F.col(c))).over(w), F.avg(F.when(early, F.col(c))).over(w)) for c in columns})
    out = marked.withColumns({c: (F.col(c) - F.col(f"_b_{c}")) / (F.abs(f"_b_{c}") + 1e-6) for c in columns})
    return out.drop("_base", "_k", "_n", *[f"_b_{c}" for c in columns])


def scaled(rows: DataFrame, columns: list[str], how: str) -> DataFrame:
    """standard (population deviation), minmax, robust (median and quartiles), power (Yeo-Johnson, then standard) or quantile (average
    rank from 0 to 1) scaling; a constant column becomes 0, nulls stay null."""
    for c in columns:
        x = F.col(c)
        if how == "quantile":
            counts = rows.where(x.isNotNull()).groupBy(x.alias("_v")).agg(F.count("*").alias("_n"))
            upto = running_sum(counts, "_v", "_n", "_upto").join(F.broadcast(counts.agg(F.sum("_n").alias("_all"))))
            ranks = upto.select("_v", F.when(F.col("_all") > 1, (F.col("_upto") - (F.col("_n") + 1) / 2.0) / (F.col("_all") - 1)).otherwise(0.0).alias("_r"))
            rows = rows.join(ranks, x == F.col("_v"), "left").withColumn(c, F.col("_r")).drop("_v", "_r")
            continue
        if how == "power":
            rows = transformed(rows, c, "yeojohnson")
        if how == "robust":
            one = quantiles(rows, c, (0.5, 0.25, 0.75)).select(F.col("q0").alias("_c"), (F.col("q2") - F.col("q1")).alias("_s"))
        else:
            centre, spread = (F.min(x), F.max(x) - F.min(x)) if how == "minmax" else (F.avg(x), F.stddev_pop(x))
            one = rows.agg(centre.alias("_c"), spread.alias("_s"))
        rows = rows.join(F.broadcast(one)).withColumn(c, F.when(F.col("_s") != 0, (x - F.col("_c")) / F.col("_s")).otherwise(F.when(x.isNotNull(), 0.0))).drop("_c", "_s")
    return rows


def _power(x: Column, lam: float, kind: str) -> Column:
    if kind == "boxcox":
        return F.log(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def power_lambda(rows: DataFrame, column: str, kind: str = "yeojohnson", low: float = -2.0, high: float = 3.0) -> float:
    """The power of greatest likelihood, on successively finer grids; each grid is one aggregation of the table."""
    x = F.col(column).cast("double")
    slope = F.log(x) if kind == "boxcox" else F.signum(x) * F.log1p(F.abs(x))
    data = rows.where(x.isNotNull() & (x > 0 if kind == "boxcox" else F.lit(True)))
    for _ in range(4):
        grid = np.linspace(low, high, 11).tolist()
        got = data.agg(F.count("*").alias("n"), F.sum(slope).alias("s"), *[F.var_pop(_power(x, g, kind)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
        score = [-got.n / 2 * math.log(v) + (g - 1) * got.s if (v := got[f"v{i}"]) else -math.inf for i, g in enumerate(grid)]
        best = int(np.argmax(score))
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, 10)]
    return grid[best]


def transformed(rows: DataFrame, column: str, how: str) -> DataFrame:
    """log, reciprocal, sqrt, boxcox or yeojohnson of a column; null where undefined."""
    x = F.col(column).cast("double")
    if how in ("boxcox", "yeojohnson"):
        lam = power_lambda(rows, column, how)
        return rows.withColumn(column, F.when(x > 0, _power(x, lam, how)) if how == "boxcox" else _power(x, lam, how))
    return rows.withColumn(column, {"log": F.when(x > 0, F.log(x)), "reciprocal": F.when(x != 0, 1 / x), "sqrt": F.when(x >= 0, F.sqrt(x))}[how])


def vif(rows: DataFrame, columns: list[str]) -> list[tuple[str, float]]:
    """Variance inflation factors, largest first: the diagonal of the inverse correlation matrix; infinite beyond R2 0.99999."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).first() if pairs else {}
    m = np.eye(len(columns))
    for a, b in pairs:
        i, j = columns.index(a), columns.index(b)
        m[i, j] = m[j, i] = got[f"{a}|{b}"] or 0.0
    out = []
    for i, c in enumerate(columns):
        rest = [j for j in range(len(columns)) if j != i]
        r = float(m[i, rest] @ np.linalg.lstsq(m[np.ix_(rest, rest)], m[rest, i], rcond=None)[0]) if rest else 0.0
        out.append((c, math.inf if r > 0.99999 else 1 / (1 - r)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def group_fold(subject: Column, folds: int) -> Column:
    """A fold for each subject, from the first 32 bits of its MD5: all its rows are in one fold."""
    return F.pmod(F.conv(F.substring(F.md5(subject.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def _hash(*parts) -> Column:
    """32 bits of the MD5 of the parts' text, a number from 0 to 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0


def folded(rows: DataFrame, scheme: str, folds: int, key: str, label: str | None = None, group: str | None = None) -> DataFrame:
    """Adds ``fold``. kfold: by the rows' hash. stratified: each class dealt round, in the order of its rows' hashes, so that folds hold as many of
    it. group: all rows of a group in one. leave_one_group_out: a fold for each group, numbered in order. leave_one_out: one for each row."""
    if scheme == "kfold":
        return rows.withColumn("fold", group_fold(F.col(key), folds))
    if scheme == "group":
        return rows.withColumn("fold", group_fold(F.col(group), folds))
    if scheme == "stratified":
        dealt = numbered(rows.withColumn("_h", _hash(F.col(key))), label, "_h", key)
        return dealt.withColumn("fold", (F.col("idx") % folds).cast("int")).drop("_h", "idx", "n")
    if scheme == "leave_one_group_out":
        return rows.join(codes(rows, group).withColumnRenamed("code", "fold"), group)
    if scheme == "leave_one_out":
        dealt = numbered(rows.withColumn("_one", F.lit(0)), "_one", key)
        return dealt.withColumn("fold", F.col("idx").cast("int")).drop("_one", "idx", "n")
    raise ValueError(scheme)


def shuffled(rows: DataFrame, scheme: str, splits: int, share: float, key: str, label: str | None = None, group: str | None = None) -> DataFrame:
    """Each row once for each of ``splits`` random splits, with ``split`` and whether it is a ``test`` row. shuffle and group_shuffle:
    by the hash of the row or group; stratified_shuffle: the rows of the least hashes, as many of each class as its share."""
    every = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    if scheme in ("shuffle", "group_shuffle"):
        return every.withColumn("test", _hash(F.col(key if scheme == "shuffle" else group), F.col("split")) < share)
    if scheme == "stratified_shuffle":
        dealt = numbered(every.withColumns({"_h": _hash(F.col(key), F.col("split")), "_class": F.concat_ws("|", "split", F.col(label).cast("string"))}), "_class", "_h", key)
        return dealt.withColumn("test", F.col("idx") < F.round(F.col("n") * share)).drop("_h", "_class", "idx", "n")
    raise ValueError(scheme)


def codes(rows: DataFrame, label: str) -> DataFrame:
    """(label, code): the distinct labels in order, numbered from 0; nulls have none. Join on ``code`` to turn codes back."""
    distinct = rows.select(label).where(F.col(label).isNotNull()).distinct().withColumn("_one", F.lit(0))
    return numbered(distinct, "_one", label).select(label, F.col("idx").cast("int").alias("code"))


def weighted(rows: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Adds the balanced weight of each row's class, for models' ``weightCol``."""
    return rows.join(F.broadcast(class_weights(rows, label).withColumnRenamed("weight", name)), label)


def binned(rows: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """(bin of each column, n): counts in bins of equal width between each column's least and greatest value, the last one closed. One
    column is a histogram, two are a scatter plot."""
    x = rows.where(" and ".join(f"{c} is not null" for c in columns))
    ends = x.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("a", F.min), ("b", F.max))])
    place = lambda c: F.when(F.col(f"_b_{c}") > F.col(f"_a_{c}"), F.least(F.floor((F.col(c) - F.col(f"_a_{c}")) / (F.col(f"_b_{c}") - F.col(f"_a_{c}")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    return x.join(F.broadcast(ends)).groupBy(*[place(c).alias(f"bin_{c}") for c in columns]).agg(F.count("*").alias("n"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, weight) n / (classes * n of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    return counts.join(F.broadcast(total)).select(label, (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))
