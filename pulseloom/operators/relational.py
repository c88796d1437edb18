"""Relational pieces: channel blocks, neighbours by flag, interval overlap, matches within a distance, name ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.scalars import name_ratio


def to_blocks(samples: DataFrame, size: int) -> DataFrame:
    """(channel, block, samples ARRAY) of (channel, idx, v): ordered chunks of ``size`` samples."""
    rows = samples.withColumn("block", F.floor(F.col("idx") / size).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "v")))
    return rows.groupBy("channel", "block").agg(F.transform(ordered, lambda x: x["v"]).alias("samples"))


def stitch_blocks(blocks: DataFrame) -> DataFrame:
    """(channel, idx, v): blocks of each channel one after another. Only block sizes are ordered, never samples."""
    before = Window.partitionBy("channel").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.size("samples")).over(before), F.lit(0))
    return blocks.withColumn("_o", offset).select("channel", "_o", F.posexplode("samples").alias("_p", "v")).select("channel", (F.col("_o") + F.col("_p")).cast("long").alias("idx"), "v")


def channel_names(names: DataFrame, column: str = "name") -> DataFrame:
    """Distinct channels of keys <channel>_block_<i>."""
    return names.select(F.regexp_extract(column, "^(.*)_block_", 1).alias("channel")).where("channel <> ''").distinct()


def invalid_neighbours(peaks: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("r_idx")
    bad = F.when(F.col("valid") == 0, F.col("r_idx"))
    after, before = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    return peaks.select(*keys, "r_idx", F.min(bad).over(after).alias("next_invalid"), F.max(bad).over(before).alias("prev_invalid"))


def overlaps(a: Column, z: Column, start: Column, end: Column) -> Column:
    """Interval (a, z) shows in the view (start, end)."""
    return (z > start) & (a < end)


def match_within(points: DataFrame, events: DataFrame, delta: int, *keys: str) -> DataFrame:
    """Points ``d`` with the number of events r_idx at most ``delta`` away. Both sides meet on cells of width delta, not on ranges."""
    width = max(1, delta)
    near = points.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("d") / width) - 1, F.floor(F.col("d") / width) + 1)))
    cells = events.withColumn("_cell", F.floor(F.col("r_idx") / width))
    hits = near.join(cells, [*keys, "_cell"]).where(F.abs(F.col("r_idx") - F.col("d")) <= delta).groupBy(*keys, "d").agg(F.count("*").alias("n"))
    return points.join(hits, [*keys, "d"], "left").select(*keys, "d", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") > 0, F.lit(False)).alias("matched"))


def rank_names(names: DataFrame, target: str, most: int) -> DataFrame:
    """The ``most`` names nearest to ``target``: (name, ratio, place); a name that holds the target counts as equal."""
    ratio = F.when(F.contains(F.lower("name"), F.lit(target.lower())), 1.0).otherwise(name_ratio(F.col("name"), F.lit(target)))
    top = names.select("name", ratio.alias("ratio")).orderBy(F.desc("ratio"), "name").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ratio"), "name")))


def top_k(rows: DataFrame, k: int, score: str, tie: str, *keys: str) -> DataFrame:
    """The k rows of the highest score of each group (all rows without keys), ties by ``tie``, with their place."""
    if not keys:
        top = rows.orderBy(F.desc(score), tie).limit(k)
        return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), tie)))
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
