"""Metrics of classifiers from rows (label, prediction) or (label, score), as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.operators.stats import running_sum


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n, percent): percent of the label's rows."""
    n = rows.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def class_report(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, precision, recall, f1, support) of each class; 0 where undefined."""
    both = F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("is"), F.lit(0).alias("said")), F.struct(F.col(prediction).alias("c"), F.lit(0).alias("is"), F.lit(1).alias("said")))
    hit = rows.select(F.explode(both).alias("x"), (F.col(label) == F.col(prediction)).cast("int").alias("hit")).groupBy(F.col("x.c").alias("label")).agg(F.sum("x.is").alias("support"), F.sum("x.said").alias("said"), F.sum(F.col("x.is") * F.col("hit")).alias("tp"))
    p, r = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return hit.select("label", p.alias("precision"), r.alias("recall"), "support").withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def report_averages(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(average, precision, recall, f1, support): macro and weighted means of the class report."""
    r = class_report(rows, label, prediction)
    names = ("precision", "recall", "f1")
    one = r.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in names], F.sum("support").alias("support"))
    kinds = F.array(*[F.struct(F.lit(k).alias("average"), *[F.col(f"{k[0]}_{c}").alias(c) for c in names], F.col("support")) for k in ("macro", "weighted")])
    return one.select(F.explode(kinds).alias("_")).select("_.*")


def summary(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, balanced_accuracy, f1_macro, f1_weighted, mcc (all classes)."""
    r = class_report(rows, label, prediction)
    # classes that are only predicted have no recall of their own
    one = r.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))
    counts = confusion(rows, label, prediction)
    t = counts.groupBy("label").agg(F.sum("n").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum("t").alias("s"))
    p = counts.groupBy("prediction").agg(F.sum("n").alias("p")).agg(F.sum(F.col("p") * F.col("p")).alias("pp"))
    c = counts.agg(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("c"))
    tp = counts.groupBy("label").agg(F.sum("n").alias("t")).join(counts.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("p")), "label").agg(F.coalesce(F.sum(F.col("t") * F.col("p")), F.lit(0)).alias("tp"))
    whole = one
    for x in (t, p, c, tp):
        whole = whole.join(F.broadcast(x))
    s = F.col("s")
    mcc = F.try_divide(F.col("c") * s - F.col("tp"), F.sqrt((s * s - F.col("pp")).cast("double")) * F.sqrt((s * s - F.col("tt")).cast("double")))
    return whole.select("accuracy", "balanced_accuracy", "f1_macro", "f1_weighted", F.coalesce(mcc, F.lit(0.0)).alias("mcc"))


def log_loss(rows: DataFrame, label: str = "label", score: str = "score", eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(score)))
    return rows.agg((-F.avg(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))


def roc_points(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, highest first by threshold."""
    counts = rows.groupBy((-F.col(score)).alias("_s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg"))
    both = running_sum(running_sum(counts, "_s", "pos", "tp"), "_s", "neg", "fp")
    total = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return both.join(F.broadcast(total)).select((F.lit(0.0) - F.col("_s")).alias("threshold"), F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"))


def roc_auc(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the curve from the average ranks of the positives."""
    counts = rows.groupBy(F.col(score).alias("_s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    ranked = running_sum(counts, "_s", "n", "upto")
    rank = F.col("upto") - (F.col("n") - 1) / 2.0
    one = ranked.agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return one.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * F.col("q")).alias("auc"))


def mean_roc(rows: DataFrame, fold: str = "fold", label: str = "label", score: str = "score", points: int = 100) -> DataFrame:
    """(fpr, tpr, std): the folds' curves read at evenly spaced false-positive rates (highest tpr so far, by steps), mean and sample deviation.

    Scores meet the grid on the cell of their rate, so only a row for each fold and cell is left before curves are read.
    """
    cell = F.ceil(F.col("fpr") * (points - 1) - 1e-12).cast("int")
    # the folds' curves side by side: sums run over all folds in order of (fold, score), less what the folds before hold
    counts = rows.groupBy(F.col(fold).alias("fold"), (-F.col(score)).alias("_s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg"))
    keyed = counts.withColumn("_key", F.struct("fold", "_s"))
    both = running_sum(running_sum(keyed, "_key", "pos", "tp"), "_key", "neg", "fp")
    total = counts.groupBy("fold").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    earlier = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumns({"P0": F.coalesce(F.sum("P").over(earlier), F.lit(0)), "N0": F.coalesce(F.sum("N").over(earlier), F.lit(0))})
    curves = both.join(F.broadcast(total), "fold").select("fold", F.try_divide(F.col("fp") - F.col("N0"), "N").alias("fpr"), F.try_divide(F.col("tp") - F.col("P0"), "P").alias("tpr"))
    every = curves.groupBy("fold", cell.alias("cell")).agg(F.max("tpr").alias("tpr"))
    grid = rows.sparkSession.range(points).select(F.col("id").cast("int").alias("cell")).crossJoin(F.broadcast(every.select("fold").distinct()))
    upto = Window.partitionBy("fold").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    read = grid.join(every, ["fold", "cell"], "left").withColumn("tpr", F.coalesce(F.max("tpr").over(upto), F.lit(0.0)))
    return read.groupBy("cell").agg(F.avg("tpr").alias("tpr"), F.stddev_samp("tpr").alias("std")).select((F.col("cell") / (points - 1)).alias("fpr"), "tpr", "std")
