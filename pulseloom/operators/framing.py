"""Framing: cut recordings into overlapping sections, join samples and events to them, neighbours and runs.

Recordings are rows (record_id, idx, v). All windows are partitioned by record (and section), so recordings and
sections are worked on side by side; joins of positions to sections are equi-joins on computed section numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("record_id", "wave_section")


def ordered(*keys: str, by: str = "idx"):
    return Window.partitionBy(*(keys or ("record_id",))).orderBy(by)


def segment(records: DataFrame, fs: float, seconds: float, overlap: float = 0.2, min_size: float = 0.0) -> DataFrame:
    """(record_id, wave_section, start_point, end_point) of records (record_id, n).

    Windows of ``seconds``, each ``overlap`` of its size over the next, while they end before the record does; a
    tail of at least ``min_size`` seconds is a section too, and with min_size -1 the last window stretches to the end.
    """
    size, step = seconds * fs, (1.0 - overlap) * seconds * fs
    k = F.greatest(F.ceil((F.col("n") - size) / step), F.lit(0)).cast("int")
    full = F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(i.alias("wave_section"), (i * step).cast("long").alias("start_point"), F.floor(i * step + size).cast("long").alias("end_point"))))
    if min_size == -1:
        last = F.array(F.struct((k - 1).alias("wave_section"), ((k - 1) * step).cast("long").alias("start_point"), F.col("n").cast("long").alias("end_point")))
        every = F.when(k > 1, F.concat(F.slice(full, F.lit(1), k - 1), last)).when(k == 1, last).otherwise(F.slice(last, 1, 0))
    else:
        tail = F.array(F.struct(k.alias("wave_section"), (k * step).cast("long").alias("start_point"), F.col("n").cast("long").alias("end_point")))
        none = F.slice(tail, 1, 0)
        every = F.concat(F.coalesce(full, none), F.when(F.col("n") - k * step >= min_size * fs, tail).otherwise(none))
    return records.select("record_id", F.explode(every).alias("s")).select("record_id", "s.*")


def lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy("record_id").agg((F.max("idx") + 1).alias("n"))


def section_join(samples: DataFrame, fs: float, seconds: float, overlap: float = 0.2, min_size: float | None = None, position: str = "idx", closed: str = "left") -> DataFrame:
    """Rows with the sections that cover them: start <= position < end ("left"), both ends out ("none") or in ("both").

    The sections that cover a position follow from it and from the recording's length n, so there is no join at all:
    each row is repeated for its one or two sections. Rows without n get it from their recording's greatest position.
    min_size None: full sections only.
    """
    size, step = seconds * fs, (1.0 - overlap) * seconds * fs
    if "n" not in samples.columns:
        samples = samples.join(samples.groupBy("record_id").agg((F.max(position) + 1).alias("n")), "record_id")
    p, n, k = F.col(position), F.col("n"), F.col("wave_section")
    full = F.greatest(F.ceil((n - size) / step), F.lit(0))
    low = F.greatest(F.floor((p - size) / step), F.lit(0))
    low = F.greatest(F.least(low, full - 1), F.lit(0)) if min_size == -1 else low
    near = samples.withColumn("wave_section", F.explode(F.sequence(low.cast("int"), F.floor(p / step).cast("int"))))
    end = F.when(k < full, F.floor(k * step + size))
    if min_size == -1:
        end = F.when(k == full - 1, n).when(k < full, F.floor(k * step + size))
    elif min_size is not None:
        end = end.when((k == full) & (n - k * step >= min_size * fs), n)
    bounded = near.withColumns({"start_point": (k * step).cast("long"), "end_point": end.cast("long")})
    a, b = F.col("start_point"), F.col("end_point")
    return bounded.where({"left": (p >= a) & (p < b), "none": (p > a) & (p < b), "both": (p >= a) & (p <= b)}[closed])


def placed(rows: DataFrame, *order: str, bits: int = 10) -> DataFrame:
    """Adds ``_b``, the row's block (0 on) of at most 2^``bits`` in ascending ``order``, nulls first.

    A block depends on the row alone, not on the task that reads it, so plans that read the rows again put each into the same block:
    bounds are the rows of least hash, of which at most 2^bits meet in one task, and are searched by halves. Rows of equal order share
    a block. (Ids of range partitions don't do: each plan samples bounds and merges partitions of its own.)
    """
    most = (1 << bits) - 1
    bounds = rows.select(*order).orderBy(F.xxhash64(*order), *order).limit(most).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_bounds")).scalar()
    out = rows.withColumn("_b", F.lit(0))
    for k in reversed(range(bits)):
        out = out.withColumn("_b", F.col("_b") + F.when(F.get(bounds, F.col("_b") + (1 << k) - 1) <= F.struct(*order), 1 << k).otherwise(0))
    return out


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``idx`` (0 on) in ``order`` within each key, and the key's number of rows ``n``.

    Rows are put into blocks by key and order, numbered inside each block and moved by the blocks before, so that no task holds a
    key. ``order`` must tell the rows of a key apart. Only one row for each block and key meets in the sums over blocks.
    """
    blocks = placed(rows, key, *order)
    own = blocks.withColumn("_k", F.row_number().over(Window.partitionBy("_b", key).orderBy(*order)))
    w = Window.partitionBy(key)
    counts = blocks.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(key).alias("_key"), F.col("_b").alias("_block"), before.alias("_o"), F.sum("_n").over(w).alias("n"))
    met = own.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_block")))
    return met.withColumn("idx", (F.col("_k") + F.col("_o") - 1).cast("long")).drop("_b", "_k", "_o", "_key", "_block")


#: Samples of a recording that are worked on together where a method needs neighbours.
BLOCK = 65_536


def with_length(samples: DataFrame) -> DataFrame:
    """Adds ``n``, the recording's length, unless it is there; the sums are by recording, so no task holds one."""
    if "n" in samples.columns:
        return samples
    return samples.join(samples.groupBy("record_id").agg((F.max("idx") + 1).alias("n")), "record_id")


def in_blocks(samples: DataFrame, size: int, block: int) -> DataFrame:
    """Rows of their own block (_own) and, near a border, also of the next one or the one before: _at is the block that a row is for."""
    at, i = F.floor(F.col("idx") / block).cast("long"), F.col("idx") % block
    copies = F.filter(F.array(at, F.when(i >= block - size, at + 1), F.when((i < size // 2) & (at > 0), at - 1)), lambda x: x.isNotNull())
    return with_length(samples).withColumns({"_own": at, "_at": F.explode(copies)})


def rolling_median(samples: DataFrame, size: int = 41, block: int = BLOCK) -> DataFrame:
    """Adds ``rolling_med``: the median of a centred frame; the first half takes the first frame, and the last rows
    take the frame that ends before the last sample (one sample shorter).

    Recordings are worked on in blocks of ``block`` samples (more than ``size``) with a frame's length of the neighbours before and half
    of one after, so that no task holds a recording.
    """
    half, keep_n = size // 2, "n" in samples.columns
    spread = in_blocks(samples, size, block)
    w = Window.partitionBy("record_id", "_at").orderBy("idx")
    whole = Window.partitionBy("record_id", "_at")
    marked = spread.withColumns({"_mid": F.percentile("v", F.lit(0.5)).over(w.rowsBetween(-half, half)), "_late": F.percentile("v", F.lit(0.5)).over(w.rowsBetween(-half, half - 1))})
    head = F.max(F.when(F.col("idx") == half, F.col("_mid"))).over(whole)
    # rows [n - size, n - 1) are centred, one short, on row n - size + half
    tail = F.max(F.when(F.col("idx") == F.col("n") - size + half, F.col("_late"))).over(whole)
    out = F.when(F.col("idx") < half, head).when(F.col("idx") + half + 1 >= F.col("n"), tail).otherwise(F.col("_mid"))
    return marked.withColumn("rolling_med", out).where("_at = _own").drop("_own", "_at", "_mid", "_late", *([] if keep_n else ["n"]))


def gradient(v: Column, w) -> Column:
    """Central differences, one-sided at the ends."""
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    return F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2.0)


def second_gradient(samples: DataFrame, *keys: str) -> DataFrame:
    w = ordered(*keys)
    return samples.withColumn("d1", gradient(F.col("v"), w)).withColumn("d2", gradient(F.col("d1"), w))


def local_minima(samples: DataFrame, *keys: str) -> DataFrame:
    """Rows where the gradient's sign turns upwards; the first row is held against the last."""
    w = ordered(*keys)
    signed = samples.withColumn("s", F.signum(gradient(F.col("v"), w)))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.coalesce(F.lag("s").over(w), F.last("s").over(whole)) - F.col("s")
    return signed.withColumn("turn", turn).where("turn in (-2, -1)").drop("s", "turn")


def runs(rows: DataFrame, *keys: str, by: str = "idx") -> DataFrame:
    """Runs of consecutive numbers: (keys, first, last, n)."""
    island = F.col(by) - F.row_number().over(ordered(*keys, by=by))
    return rows.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(by).alias("first"), F.max(by).alias("last"), F.count("*").alias("n")).drop("_island")


def group_near(rows: DataFrame, delta: float, *keys: str, by: str = "x") -> DataFrame:
    """Sorted numbers whose distance from the one before is at most delta form a group: (keys, grp, centre, n), centre the rounded median."""
    w = ordered(*keys, by=by)
    fresh = F.when(F.col(by) - F.lag(by).over(w) > delta, 1).otherwise(0)
    grouped = rows.withColumn("_new", fresh).withColumn("grp", F.sum("_new").over(w))
    return grouped.groupBy(*keys, "grp").agg(F.bround(F.percentile(by, F.lit(0.5))).cast("long").alias("centre"), F.count("*").alias("n"))


def beat_pairs(peaks: DataFrame, *keys: str) -> DataFrame:
    """Each beat with the next: adds next_idx, next_valid and rr (samples)."""
    w = ordered(*keys, by="r_idx")
    return peaks.withColumns({"next_idx": F.lead("r_idx").over(w), "next_valid": F.lead("valid").over(w)}).withColumn("rr", F.col("next_idx") - F.col("r_idx"))


def valid_lookback(peaks: DataFrame, lookback: int, *keys: str) -> DataFrame:
    """The latest run of valid peaks that spans more than ``lookback`` samples, from its newest peak to the first one that far back.

    A run that needs the recording's oldest peak to span that much doesn't count; no such run gives no rows.
    """
    down = Window.partitionBy(*keys).orderBy(F.desc("r_idx"))
    whole = Window.partitionBy(*keys)
    run = peaks.withColumns({"_run": F.sum((F.col("valid") == 0).cast("int")).over(down), "_oldest": F.min("r_idx").over(whole)}).where("valid = 1")
    spans = run.withColumn("_span", F.max("r_idx").over(Window.partitionBy(*keys, "_run")) - F.col("r_idx"))
    hit = F.max(F.when((F.col("_span") > lookback) & (F.col("r_idx") > F.col("_oldest")), F.struct("r_idx", "_run"))).over(whole)
    found = spans.withColumn("_hit", hit).where((F.col("_run") == F.col("_hit._run")) & (F.col("r_idx") >= F.col("_hit.r_idx")))
    return found.select(*keys, "r_idx")


def asof_section(points: DataFrame, sections: DataFrame, by: str = "idx") -> DataFrame:
    """Each point with the last section that starts at or before it (the first section if none does), without a range join."""
    s = sections.select("record_id", F.col("start_point").alias(by), F.col("wave_section").alias("_s"), F.lit(0).alias("_kind"))
    p = points.select("record_id", by, F.lit(None).cast("int").alias("_s"), F.lit(1).alias("_kind"))
    w = Window.partitionBy("record_id").orderBy(by, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("_s").over(Window.partitionBy("record_id"))
    both = s.unionByName(p).withColumn("wave_section", F.coalesce(F.last("_s", ignorenulls=True).over(w), first))
    return both.where("_kind = 1").drop("_s", "_kind")


def downsample(samples: DataFrame, most: int = 5000) -> DataFrame:
    """Every k-th sample, k the recording's length over ``most``, 1 at least."""
    k = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    return with_length(samples).where(F.col("idx") % k == 0).select(*samples.columns)


def drop_known(fresh: DataFrame, stored: DataFrame, last: int = 20) -> DataFrame:
    """New peaks without those among the last stored ones of their recording."""
    recent = stored.withColumn("_k", F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("r_idx")))).where(F.col("_k") <= last)
    return fresh.join(recent.select("record_id", "r_idx"), ["record_id", "r_idx"], "left_anti")
