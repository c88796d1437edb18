"""Sinks: results by recording, summaries, JSON reports, text tables of earlier engines, corrected RR files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.scalars import half_even


def save_results(rows: DataFrame, path: str, run_ts: str, by: str = "record_id", mode: str = "append") -> None:
    """One folder for each recording and run. The committer makes a run visible at once or not at all."""
    rows.withColumn("run_ts", F.lit(run_ts)).write.mode(mode).partitionBy("run_ts", by).parquet(path)


def unprocessed(files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    return files.join(manifest.select(key), key, "left_anti")


def run_summary(sections: DataFrame) -> DataFrame:
    """(kind, value, n): sections by validity and by reason of failure."""
    kinds = F.array(F.struct(F.lit("valid").alias("kind"), F.col("valid").cast("string").alias("value")), F.struct(F.lit("fail_reason").alias("kind"), F.coalesce("fail_reason", F.lit("")).alias("value")))
    return sections.select(F.explode(kinds).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def save_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Regimes, discords and other small results as JSON lines; dates and numbers as Spark writes them."""
    rows.write.mode(mode).json(path)


def save_legacy(sections: DataFrame, path: str, places: int = 2) -> None:
    """Section tables as text: whole numbers as they are, measures with two decimals."""
    columns = [half_even(F.col(c), places).alias(c) if t in ("double", "float") else F.col(c) for c, t in sections.dtypes]
    sections.select(*columns).write.mode("overwrite").csv(path)


def save_search_log(spark, scored: list[dict], path: str, run_ts: str) -> None:
    """Settings of a search with their metrics, appended as JSON lines."""
    spark.createDataFrame([(run_ts, json.dumps(s, sort_keys=True, default=float)) for s in scored], "run_ts string, result string").write.mode("append").json(path)


def save_rr(rows: DataFrame, path: str) -> None:
    """Corrected R positions: tab-separated position and marker, in order within each file."""
    rows.select(F.concat_ws("\t", F.col("rposition").cast("string"), F.coalesce("marker", F.lit(""))).alias("value"), "record_id", "rposition").repartition("record_id").sortWithinPartitions("record_id", "rposition").select("record_id", "value").write.mode("overwrite").partitionBy("record_id").text(path)


def pad_channels(samples: DataFrame) -> DataFrame:
    """(record_id, channel, idx, v): each channel filled with zeros up to its recording's longest."""
    ends = samples.groupBy("record_id", "channel").agg(F.max("idx").alias("last"))
    most = ends.groupBy("record_id").agg(F.max("last").alias("most"))
    missing = ends.join(most, "record_id").where("last < most").select("record_id", "channel", F.explode(F.sequence(F.col("last") + 1, F.col("most"))).alias("idx"), F.lit(0.0).alias("v"))
    return samples.select("record_id", "channel", "idx", "v").unionByName(missing)


def warp_clock(samples: DataFrame, error: float) -> DataFrame:
    """Samples of a clock that gains ``error`` for each sample, interpolated back to whole sample numbers."""
    from pyspark.sql import Window

    w = Window.partitionBy("record_id").orderBy("idx")
    moved = samples.withColumns({"p": F.col("idx") * (1 - error), "v1": F.lead("v").over(w)}).withColumn("q", F.lead("p").over(w))
    whole = moved.where("q is not null").withColumn("at", F.explode(F.sequence(F.ceil("p").cast("long"), (F.ceil("q") - 1).cast("long")))) if error < 0 else moved.where("q is not null and ceil(p) < q").withColumn("at", F.ceil("p").cast("long"))
    return whole.select("record_id", F.col("at").alias("idx"), (F.col("v") + (F.col("v1") - F.col("v")) * (F.col("at") - F.col("p")) / (F.col("q") - F.col("p"))).alias("v"))


def report(title: str, tables: dict[str, DataFrame], rows: int = 50) -> str:
    """An HTML page of small result tables (at most ``rows`` rows of each are shown)."""
    from html import escape

    parts = [f"<h1>{escape(title)}</h1>"]
    for name, table in tables.items():
        body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in table.limit(rows).collect())
        parts.append(f"<h2>{escape(name)}</h2><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in table.columns)}</tr>{body}</table>")
    return "<!DOCTYPE html><html><body>" + "".join(parts) + "</body></html>"


def to_json(values: dict) -> str:
    return json.dumps(values, default=str)
