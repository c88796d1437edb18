"""Queries of preparation, folds, neighbours, models and metrics over the driver tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.operators import metrics as me
from pulseloom.operators import models as mo
from pulseloom.operators import prep
from pulseloom.operators.neighbours import nearest, vote
from pulseloom.plans.framing_queries import r6
from pulseloom.plans.registry import query

#: Predictions and scores in SQL that stand for a model's.
PRED = "p AS (SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 WHEN vec_id % 11 = 0 THEN 0 ELSE label END AS prediction, (label = 3)::INT AS y, round(abs(cos(vec_id)) * CASE WHEN label = 3 THEN 1.0 ELSE 0.7 END, 2) AS score FROM embeddings)"


def predictions(spark, sf) -> DataFrame:
    k, l = F.col("vec_id"), F.col("label")
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", F.when(k % 7 == 0, (l + 1) % 10).when(k % 11 == 0, 0).otherwise(l).alias("prediction"), (l == 3).cast("int").alias("y"), F.round(F.abs(F.cos(k)) * F.when(l == 3, 1.0).otherwise(0.7), 2).alias("score"))


def features(spark, sf) -> tuple[DataFrame, list[str]]:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)], prep.group_fold(F.col("vec_id"), 3).alias("fold")), [f"x{i}" for i in range(64)]


@query("confusion_matrix", f"WITH {PRED} SELECT label, prediction, n, round(100.0 * n / sum(n) OVER (PARTITION BY label), 6) AS percent FROM (SELECT label, prediction, count(*) AS n FROM p GROUP BY ALL)")
def q_confusion(spark, sf):
    return me.confusion(predictions(spark, sf)).select("label", "prediction", "n", r6("percent"))


_REPORT = PRED + ", c AS (SELECT DISTINCT label AS c FROM p UNION SELECT prediction FROM p), r AS (SELECT c, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS said, count(*) FILTER (WHERE label = c AND prediction = c) AS tp FROM c, p GROUP BY c), f AS (SELECT c AS label, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support, coalesce(2.0 * tp / nullif(said + support, 0), 0) AS f1 FROM r)"


@query("class_report", f"WITH {_REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, support, round(f1, 6) AS f1 FROM f")
def q_report(spark, sf):
    return me.class_report(predictions(spark, sf)).select("label", r6("precision"), r6("recall"), "support", r6("f1"))


@query("report_averages", f"WITH {_REPORT} SELECT 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, sum(support)::BIGINT AS support FROM f UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f")
def q_report_averages(spark, sf):
    return me.report_averages(predictions(spark, sf)).select("average", r6("precision"), r6("recall"), r6("f1"), "support")


@query("model_summary", f"WITH {_REPORT}, o AS (SELECT count(*) AS s, count(*) FILTER (WHERE label = prediction) AS c FROM p), t AS (SELECT sum(t * t) AS tt FROM (SELECT count(*) AS t FROM p GROUP BY label)), q AS (SELECT sum(t * t) AS pp FROM (SELECT count(*) AS t FROM p GROUP BY prediction)), x AS (SELECT sum(support * said) AS tp FROM r) SELECT round(c / s, 6) AS accuracy, round((SELECT avg(recall) FROM f WHERE support > 0), 6) AS balanced_accuracy, round((SELECT avg(f1) FROM f), 6) AS f1_macro, round((SELECT sum(f1 * support) / sum(support) FROM f), 6) AS f1_weighted, round((c * s - tp) / (sqrt(s * s - pp) * sqrt(s * s - tt)), 6) AS mcc FROM o, t, q, x")
def q_summary(spark, sf):
    return me.summary(predictions(spark, sf)).select(*map(r6, ("accuracy", "balanced_accuracy", "f1_macro", "f1_weighted", "mcc")))


@query("log_loss", f"WITH {PRED} SELECT round(-avg(CASE WHEN y = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, score))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, score))) END), 6) AS log_loss FROM p")
def q_log_loss(spark, sf):
    return me.log_loss(predictions(spark, sf), "y").select(r6("log_loss"))


@query("roc_auc", f"WITH {PRED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM p) SELECT round((sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc FROM r")
def q_auc(spark, sf):
    return me.roc_auc(predictions(spark, sf), "y").select(r6("auc"))


@query("roc_points", f"WITH {PRED}, c AS (SELECT score, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y = 0) AS b FROM p GROUP BY 1) SELECT score AS threshold, round(sum(b) OVER (ORDER BY score DESC) / sum(b) OVER (), 6) AS fpr, round(sum(a) OVER (ORDER BY score DESC) / sum(a) OVER (), 6) AS tpr FROM c")
def q_roc(spark, sf):
    return me.roc_points(predictions(spark, sf), "y").select("threshold", r6("fpr"), r6("tpr"))


_FOLD = "(('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT % {})::INT"


@query("mean_roc", f"WITH {PRED}, c AS (SELECT {_FOLD.format('vec_id', 3)} AS fold, score, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y = 0) AS b FROM p GROUP BY ALL), r AS (SELECT fold, sum(b) OVER (PARTITION BY fold ORDER BY score DESC) / sum(b) OVER (PARTITION BY fold) AS fpr, sum(a) OVER (PARTITION BY fold ORDER BY score DESC) / sum(a) OVER (PARTITION BY fold) AS tpr FROM c), m AS (SELECT fold, ceil(fpr * 99 - 1e-12)::INT AS cell, max(tpr) AS tpr FROM r GROUP BY ALL), g AS (SELECT f.fold, u.cell::INT AS cell, coalesce(max(m.tpr) OVER (PARTITION BY f.fold ORDER BY u.cell), 0) AS tpr FROM (SELECT DISTINCT fold FROM c) f CROSS JOIN range(100) AS u(cell) LEFT JOIN m ON m.fold = f.fold AND m.cell = u.cell) SELECT round(cell / 99, 6) AS fpr, round(avg(tpr), 6) AS tpr, round(stddev_samp(tpr), 6) AS std FROM g GROUP BY cell")
def q_mean_roc(spark, sf):
    return me.mean_roc(predictions(spark, sf).withColumn("fold", prep.group_fold(F.col("vec_id"), 3)), label="y").select(r6("fpr"), r6("tpr"), r6("std"))


@query("subject_normalise", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events), b AS (SELECT *, coalesce(avg(value) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id), avg(value) FILTER (WHERE k <= greatest(1, n // 10)) OVER (PARTITION BY user_id)) AS b FROM r) SELECT event_id, round((value - b) / (abs(b) + 1e-6), 6) + 0.0 AS value FROM b")
def q_subject(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return prep.subject_normalised(e, ["value"], "user_id", F.col("event_type") == "view", "event_id").select("event_id", r6("value"))


for _how, _sql in {"zscore": "(value - avg(value) OVER ()) / stddev_pop(value) OVER ()", "minmax": "(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())", "robust": "(value - quantile_cont(value, 0.5) OVER ()) / (quantile_cont(value, 0.75) OVER () - quantile_cont(value, 0.25) OVER ())"}.items():

    @query(f"{_how}_scale", f"SELECT event_id, round({_sql}, 6) + 0.0 AS value FROM events")
    def q_scale(spark, sf, how=_how):
        e = spark.read.parquet(f"{sf}/events.parquet")
        return prep.scaled(e, ["value"], "standard" if how == "zscore" else how).select("event_id", r6("value"))


for _how, _sql in {"log": "CASE WHEN value > 0 THEN ln(value) END", "reciprocal": "CASE WHEN value <> 0 THEN 1 / value END", "sqrt": "CASE WHEN value >= 0 THEN sqrt(value) END"}.items():

    @query(f"transform_{_how}", f"SELECT event_id, round({_sql}, 6) + 0.0 AS value FROM events")
    def q_transform(spark, sf, how=_how):
        return prep.transformed(spark.read.parquet(f"{sf}/events.parquet"), "value", how).select("event_id", r6("value"))


@query("class_weights", "SELECT event_type, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM events GROUP BY 1")
def q_weights(spark, sf):
    return prep.class_weights(spark.read.parquet(f"{sf}/events.parquet"), "event_type").select("event_type", r6("weight"))


_UNIT = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0)"
#: Schemes of folds in SQL, over the events (key event_id, class event_type, group user_id).
for _scheme, _sql in {
    "kfold": f"SELECT event_id, {_FOLD.format('event_id', 10)} AS fold FROM events",
    "stratified": f"SELECT event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY {_UNIT.format('event_id::VARCHAR')}, event_id) - 1) % 10)::INT AS fold FROM events",
    "leave_one_group_out": "SELECT event_id, (dense_rank() OVER (ORDER BY user_id) - 1)::INT AS fold FROM events",
    "leave_one_out": "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1)::INT AS fold FROM events",
}.items():

    @query(f"folds_{_scheme}", _sql)
    def q_scheme(spark, sf, scheme=_scheme):
        e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "user_id")
        return prep.folded(e, scheme, 10, "event_id", "event_type", "user_id").select("event_id", "fold")


for _scheme, _sql in {
    "shuffle": f"SELECT event_id, split::INT AS split, {_UNIT.format('event_id || chr(124) || split')} < 0.25 AS test FROM events, range(5) AS r(split)",
    "group_shuffle": f"SELECT event_id, split::INT AS split, {_UNIT.format('user_id || chr(124) || split')} < 0.25 AS test FROM events, range(5) AS r(split)",
    "stratified_shuffle": f"SELECT event_id, split::INT AS split, row_number() OVER (PARTITION BY event_type, split ORDER BY {_UNIT.format('event_id || chr(124) || split')}, event_id) - 1 < round(count(*) OVER (PARTITION BY event_type, split) * 0.25) AS test FROM events, range(5) AS r(split)",
}.items():

    @query(f"splits_{_scheme}", _sql)
    def q_splits(spark, sf, scheme=_scheme):
        e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "user_id")
        return prep.shuffled(e, scheme, 5, 0.25, "event_id", "event_type", "user_id").select("event_id", "split", "test")


@query("label_codes", "SELECT event_id, code, event_type AS back FROM events JOIN (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INT AS code FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)")
def q_codes(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    known = prep.codes(e, "event_type")
    coded = e.join(F.broadcast(known), "event_type").select("event_id", "code")
    return coded.join(F.broadcast(known.withColumnRenamed("event_type", "back")), "code").select("event_id", "code", "back")


@query("row_weights", "SELECT event_id, round(count(*) OVER () / ((SELECT count(DISTINCT event_type) FROM events) * count(*) OVER (PARTITION BY event_type)), 6) AS weight FROM events")
def q_row_weights(spark, sf):
    return prep.weighted(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type"), "event_type").select("event_id", r6("weight"))


@query("quantile_scale", "SELECT event_id, round((rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 - 1) / (count(*) OVER () - 1), 6) + 0.0 AS value FROM events")
def q_quantile_scale(spark, sf):
    return prep.scaled(spark.read.parquet(f"{sf}/events.parquet"), ["value"], "quantile").select("event_id", r6("value"))


@query("histogram", "WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT least(floor((value - a) / (b - a) * 20), 19)::INT AS bin_value, count(*) AS n FROM events, e GROUP BY 1")
def q_histogram(spark, sf):
    return prep.binned(spark.read.parquet(f"{sf}/events.parquet"), ["value"], 20)


@query("scatter_bins", "WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem) SELECT least(floor((l_quantity - a) / (b - a) * 12), 11)::INT AS bin_l_quantity, least(floor((l_extendedprice - c) / (d - c) * 12), 11)::INT AS bin_l_extendedprice, count(*) AS n FROM lineitem, e GROUP BY 1, 2")
def q_scatter(spark, sf):
    return prep.binned(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_quantity", "l_extendedprice"], 12)


@query("group_folds", f"SELECT event_id, user_id, {_FOLD.format('user_id', 5)} AS fold FROM events")
def q_folds(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", prep.group_fold(F.col("user_id"), 5).alias("fold"))


_KNN = "WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id % 50 = 0), a AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), d AS (SELECT q.vec_id AS query, a.vec_id AS id, a.label, list_distance(q.e, a.e) AS distance FROM q JOIN a ON q.vec_id <> a.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS place FROM d) "


@query("knn_search", _KNN + "SELECT query, id, label::BIGINT AS label, round(distance, 5) AS distance, place::INT AS place FROM k WHERE place <= 5")
def q_knn(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return nearest(e.where("vec_id % 50 = 0"), e).select("query", "id", "label", F.round("distance", 5).alias("distance"), "place")


@query("knn_vote", _KNN + "SELECT query, label FROM (SELECT query, label::BIGINT AS label, row_number() OVER (PARTITION BY query ORDER BY sum(1.0 / greatest(distance, 1e-12)) DESC, label) AS r FROM k WHERE place <= 5 GROUP BY query, label) WHERE r = 1")
def q_knn_vote(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return vote(nearest(e.where("vec_id % 50 = 0"), e))


@query("soft_vote", "SELECT vec_id, CASE WHEN (embedding[1]::DOUBLE + embedding[2]) >= (embedding[3]::DOUBLE + embedding[4]) THEN 0 ELSE 1 END AS prediction FROM embeddings")
def q_soft_vote(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("e", F.col("embedding").cast("array<double>"))
    parts = [e.select("vec_id", F.array(F.col("e")[i], F.col("e")[i + 2]).alias("probability")) for i in (0, 1)]
    return mo.soft_vote(parts, "vec_id")


def _det(rows: list[int], columns: list[int]) -> str:
    """The determinant of a part of the correlation matrix m0_0, m0_1, ... in SQL."""
    if not rows:
        return "1"
    first, rest = rows[0], rows[1:]
    return "(" + " + ".join(f"{'-' if k % 2 else ''}m{min(first, c)}_{max(first, c)} * {_det(rest, columns[:k] + columns[k + 1 :])}" for k, c in enumerate(columns)) + ")"


_VIF = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_CORR = ", ".join(f"{f'corr({a}, {b})' if i != j else '1.0'} AS m{i}_{j}" for i, a in enumerate(_VIF) for j, b in enumerate(_VIF) if i <= j)


@query("vif", f"WITH m AS (SELECT {_CORR} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS column, round({_det([j for j in range(4) if j != i], [j for j in range(4) if j != i])} / {_det([0, 1, 2, 3], [0, 1, 2, 3])}, 6) AS vif FROM m" for i, c in enumerate(_VIF)))
def q_vif(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return spark.createDataFrame([(c, round(v, 6)) for c, v in prep.vif(rows, list(_VIF))], "column string, vif double")


def _power_sql(x: str, lam: str) -> str:
    """Yeo-Johnson's transform in SQL."""
    up = f"CASE WHEN abs({lam}) < 1e-9 THEN ln(1 + greatest({x}, 0)) ELSE (pow(greatest({x}, 0) + 1, {lam}) - 1) / {lam} END"
    down = f"CASE WHEN abs({lam} - 2) < 1e-9 THEN -ln(1 - least({x}, 0)) ELSE -(pow(1 - least({x}, 0), 2 - {lam}) - 1) / (2 - {lam}) END"
    return f"CASE WHEN {x} >= 0 THEN {up} ELSE {down} END"


def _grids(levels: int) -> str:
    """Grids of eleven powers, each between the neighbours of the best one before."""
    out = "b0 AS (SELECT -2.0::DOUBLE AS low, 3.0::DOUBLE AS high, 0.0::DOUBLE AS lam)"
    for k in range(levels):
        out += f", g{k} AS (SELECT i, CASE WHEN i = 10 THEN high ELSE i * ((high - low) / 10) + low END AS lam FROM b{k}, range(11) AS u(i)), s{k} AS (SELECT i, lam, -count(*) / 2 * ln(var_pop({_power_sql('value', 'lam')})) + (lam - 1) * sum(sign(value) * ln(1 + abs(value))) AS score FROM g{k}, events WHERE value IS NOT NULL GROUP BY i, lam), t{k} AS (SELECT arg_max(i, (score, -i)) AS i FROM s{k}), b{k + 1} AS (SELECT max(lam) FILTER (WHERE g.i = greatest(t.i - 1, 0)) AS low, max(lam) FILTER (WHERE g.i = least(t.i + 1, 10)) AS high, max(lam) FILTER (WHERE g.i = t.i) AS lam FROM g{k} g, t{k} t)"
    return out


@query("power_transform", f"WITH {_grids(4)} SELECT event_id, round({_power_sql('value', 'lam')}, 6) + 0.0 AS value FROM events, b4")
def q_power(spark, sf):
    return prep.transformed(spark.read.parquet(f"{sf}/events.parquet"), "value", "yeojohnson").select("event_id", r6("value"))


@query("power_scale", f"WITH {_grids(4)}, y AS (SELECT event_id, {_power_sql('value', 'lam')} AS y FROM events, b4) SELECT event_id, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) + 0.0 AS value FROM y")
def q_power_scale(spark, sf):
    return prep.scaled(spark.read.parquet(f"{sf}/events.parquet"), ["value"], "power").select("event_id", r6("value"))


def vectors(spark, sf) -> DataFrame:
    """(vec_id, label, x, fold, weight): the embeddings as one vector column, weighted by class."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("x"), prep.group_fold(F.col("vec_id"), 3).alias("fold"))
    return prep.weighted(rows, "label")


@query("logistic_out_of_fold")
def q_logistic(spark, sf):
    return mo.out_of_fold(vectors(spark, sf), ["x"], "logistic", scale="s", weightCol="weight").select("vec_id", "label", "prediction", "fold")


@query("svm_out_of_fold")
def q_svm(spark, sf):
    return mo.out_of_fold(vectors(spark, sf), ["x"], "svm", scale="s", weightCol="weight").select("vec_id", "label", "prediction", "fold")


@query("forest_out_of_fold")
def q_forest(spark, sf):
    return mo.out_of_fold(vectors(spark, sf), ["x"], "forest", weightCol="weight").select("vec_id", "label", "prediction", "fold")


@query("isolation_forest")
def q_isolation(spark, sf):
    rows, columns = features(spark, sf)
    return mo.isolation_forest(rows, columns).select("vec_id", r6("anomaly"))
