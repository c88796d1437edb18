"""Classifiers over feature columns: MLlib pipelines, soft voting, approximate RBF machines and isolation forests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.operators.metrics import summary


def estimator(kind: str, **options):
    """svm (one-vs-rest linear), forest, boosted (one-vs-rest), logistic."""
    weight = {"weightCol": options["weightCol"]} if "weightCol" in options else {}
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(**{"maxIter": 20} | {k: v for k, v in options.items() if k != "weightCol"}), labelCol="label", parallelism=4, **weight)
    if kind == "forest":
        return RandomForestClassifier(**{"numTrees": 50, "maxDepth": 6, "seed": 42} | options)
    if kind == "boosted":
        return OneVsRest(classifier=GBTClassifier(**{"maxIter": 10, "maxDepth": 4, "seed": 42} | {k: v for k, v in options.items() if k != "weightCol"}), labelCol="label", parallelism=4, **weight)
    if kind == "logistic":
        return LogisticRegression(**{"maxIter": 50} | options)
    raise ValueError(kind)


def pipeline(columns: list[str], kind: str, scale: str = "r", components: int = 0, **options) -> Pipeline:
    """Assemble, scale (r: robust, quartiles; s: standard), optionally project on principal components, classify."""
    to = "scaled" if components else "features"
    scaler = RobustScaler(inputCol="raw", outputCol=to, withCentering=True, lower=0.25, upper=0.75) if scale == "r" else StandardScaler(inputCol="raw", outputCol=to, withMean=True)
    project = [PCA(k=components, inputCol="scaled", outputCol="features")] if components else []
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip"), scaler, *project, estimator(kind, **options)])


def out_of_fold(rows: DataFrame, columns: list[str], kind: str, fold: str = "fold", **options) -> DataFrame:
    """Predictions of each fold by a model of the other folds."""
    out = None
    for r in rows.select(fold).distinct().orderBy(fold).collect():
        model = pipeline(columns, kind, **options).fit(rows.where(F.col(fold) != r[0]))
        got = model.transform(rows.where(F.col(fold) == r[0])).drop("raw", "scaled", "features", "rawPrediction")
        out = got if out is None else out.unionByName(got)
    return out


def grid_search(rows: DataFrame, columns: list[str], kind: str, grid: dict[str, list], metric: str = "f1", fold: str | None = "fold"):
    """(best model, its mean metric, [(parameters, metric)]) by cross-validation over the fold column."""
    line = pipeline(columns, kind)
    stage = line.getStages()[-1]
    build = ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(stage.getParam(name), values)
    search = CrossValidator(estimator=line, estimatorParamMaps=build.build(), evaluator=MulticlassClassificationEvaluator(metricName=metric), numFolds=rows.select(fold).distinct().count() if fold else 3, foldCol=fold or "", seed=42)
    found = search.fit(rows)
    scores = [({p.name: v for p, v in m.items()}, s) for m, s in zip(search.getEstimatorParamMaps(), found.avgMetrics)]
    return found.bestModel, max(found.avgMetrics), scores


def search_metrics(rows: DataFrame, columns: list[str], kind: str, settings: list[dict], refit: str = "balanced_accuracy", fold: str = "fold"):
    """(model of the best setting on all rows, that setting, [setting with its metrics]): every setting is scored out of fold by all summary
    metrics; the best one by ``refit`` (the first of equals) is fitted again."""
    scored = [setting | summary(out_of_fold(rows, columns, kind, fold, **setting)).first().asDict() for setting in settings]
    best = max(range(len(settings)), key=lambda i: (scored[i][refit], -i))
    return pipeline(columns, kind, **settings[best]).fit(rows), settings[best], scored


def soft_vote(predictions: list[DataFrame], key: str) -> DataFrame:
    """(key, prediction): the class of the greatest mean probability; each frame holds (key, probability array)."""
    every = predictions[0].select(key, "probability")
    for p in predictions[1:]:
        every = every.unionByName(p.select(key, "probability"))
    one = every.select(key, F.posexplode("probability").alias("c", "p")).groupBy(key, "c").agg(F.avg("p").alias("p"))
    return one.groupBy(key).agg((-F.max(F.struct("p", (-F.col("c")).alias("c")))["c"]).alias("prediction"))


def probabilities(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    return model.transform(rows).select(key, vector_to_array("probability").alias("probability"))


def importances(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    """Tree importances, or mean absolute coefficients, largest first."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        own = getattr(last, "models", [last])
        values = np.mean([np.abs(m.coefficients.toArray()) if hasattr(m, "coefficients") else m.featureImportances.toArray() for m in own], axis=0)
    return sorted(zip(columns, map(float, values)), key=lambda x: (-x[1], x[0]))


def fourier_features(rows: DataFrame, columns: list[str], gamma: float, size: int = 128, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Columns rff_0 ... whose dot products approach exp(-gamma * |x - y|^2): a linear machine on them is an RBF machine."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, (2 * gamma) ** 0.5, (len(columns), size)), rng.uniform(0, 2 * np.pi, size)
    terms = {}
    for j in range(size):
        dot = F.lit(float(b[j]))
        for i, c in enumerate(columns):
            dot = dot + F.col(c) * float(w[i, j])
        terms[f"rff_{j}"] = F.cos(dot) * float((2 / size) ** 0.5)
    return rows.withColumns(terms), list(terms)


def isolation_forest(rows: DataFrame, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Adds ``anomaly`` (0 to 1). The forest is fitted on at most trees * sample rows, those of the least hash; all rows are scored."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    taken = np.array([r[0] for r in rows.select(x.alias("x")).where(F.forall("x", lambda v: v.isNotNull())).orderBy(F.xxhash64("x")).limit(trees * sample).collect()])
    rng = np.random.default_rng(seed)

    def grow(data, depth):
        if depth == 0 or len(data) <= 1 or (data.max(0) == data.min(0)).all():
            return len(data)
        f = rng.choice(np.flatnonzero(data.max(0) > data.min(0)))
        cut = rng.uniform(data[:, f].min(), data[:, f].max())
        left = data[:, f] < cut
        return (int(f), float(cut), grow(data[left], depth - 1), grow(data[~left], depth - 1))

    size = min(sample, len(taken))
    forest = [grow(taken[rng.choice(len(taken), size, replace=False)], int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)] if size else []
    usual = lambda n: 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def depth(tree, data):
        out = np.zeros(len(data))
        todo = [(tree, np.arange(len(data)), 0)]
        while todo:
            node, at, d = todo.pop()
            if isinstance(node, int):
                out[at] = d + usual(node)
            else:
                left = data[at, node[0]] < node[1]
                todo += [(node[2], at[left], d + 1), (node[3], at[~left], d + 1)]
        return out

    schema = rows.withColumn("anomaly", F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            data = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])
            score = 2 ** -(np.mean([depth(t, data) for t in forest], axis=0) / max(usual(size), 1e-9)) if forest else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "anomaly"])

    return rows.mapInArrow(run, schema)
