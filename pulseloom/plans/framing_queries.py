"""Queries of framing, neighbours, runs, joins and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.operators import framing as fr
from pulseloom.operators import relational as rel
from pulseloom.plans.registry import query

#: The signal that the driver's events hold: a recording for each type, nominally 10 samples a second.
FS, SECONDS, OVERLAP = 10.0, 10.0, 0.2
#: The same in SQL: sig, its full sections sec, local maxima peaks of each section (valid: above the section's mean).
SIG = "sig AS (SELECT event_type AS record_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value AS v FROM events), num AS (SELECT record_id, count(*) AS n FROM sig GROUP BY 1)"
SEC = SIG + ", sec AS (SELECT s.record_id, k.k::INT AS wave_section, s.idx, s.v FROM sig s JOIN num USING (record_id), unnest(range(greatest(0, ceil((n - 100) / 80.0))::BIGINT)) AS k(k) WHERE s.idx >= k.k * 80 AND s.idx < k.k * 80 + 100)"
PEAKS = SEC + ", near AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b, avg(v) OVER (PARTITION BY record_id, wave_section) AS m FROM sec WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY idx)), peaks AS (SELECT record_id, wave_section, idx AS r_idx, v, (v > m)::INT AS valid FROM near WHERE v > a AND v >= b)"


#: Power density of each full section in SQL: windows of 20 samples half over each other, Hann, with the mean (psd) or a line (lin) taken away.
_DFT20 = "SELECT record_id, wave_section, k, avg(p) / 75 * CASE WHEN k IN (0, 10) THEN 1 ELSE 2 END AS p FROM (SELECT record_id, wave_section, w, k, pow(sum(x * cos(2 * pi() * k * j / 20)), 2) + pow(sum(x * sin(2 * pi() * k * j / 20)), 2) AS p FROM {}, range(11) AS r(k) GROUP BY record_id, wave_section, w, k) GROUP BY record_id, wave_section, k"
_HANN20 = "(0.5 - 0.5 * cos(2 * pi() * j / 20))"
PSD = SEC + f", seg AS (SELECT record_id, wave_section, w, idx - wave_section * 80 - w * 10 AS j, v FROM sec, range(9) AS u(w) WHERE idx - wave_section * 80 - w * 10 BETWEEN 0 AND 19), flat AS (SELECT record_id, wave_section, w, j, (v - avg(v) OVER (PARTITION BY record_id, wave_section, w)) * {_HANN20} AS x FROM seg), psd AS ({_DFT20.format('flat')})"
LIN = f", lines AS (SELECT record_id, wave_section, w, regr_slope(v, j) AS b, regr_intercept(v, j) AS a FROM seg GROUP BY ALL), bent AS (SELECT seg.record_id, seg.wave_section, seg.w, j, (v - a - b * j) * {_HANN20} AS x FROM seg JOIN lines USING (record_id, wave_section, w)), lin AS ({_DFT20.format('bent')})"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal with its recording's length n; samples are numbered in blocks."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value")
    return fr.numbered(rows, "event_type", "ts", "event_id").select(F.col("event_type").alias("record_id"), "idx", F.col("value").alias("v"), "n")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).drop("n")


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.section_join(measured(spark, sf_dir), FS, SECONDS, OVERLAP).select("record_id", "wave_section", "idx", "v")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sectioned(spark, sf_dir)
    w = fr.ordered(*fr.KEYS)
    near = s.withColumns({"a": F.lag("v").over(w), "b": F.lead("v").over(w), "m": F.avg("v").over(Window.partitionBy(*fr.KEYS))})
    return near.where("v > a and v >= b").select(*fr.KEYS, F.col("idx").alias("r_idx"), "v", (F.col("v") > F.col("m")).cast("int").alias("valid"))


def r6(c: str) -> F.Column:
    return (F.round(F.col(c), 6) + 0.0).alias(c)


@query("segment", f"WITH {SIG} SELECT record_id, k::INT AS wave_section, (k * 80)::BIGINT AS start_point, CASE WHEN k * 80 + 100 < n THEN k * 80 + 100 ELSE n END::BIGINT AS end_point FROM num, unnest(range(greatest(0, ceil((n - 100) / 80.0))::BIGINT + 1)) AS u(k) WHERE k * 80 + 100 < n OR n - k * 80 >= 50")
def q_segment(spark, sf):
    return fr.segment(fr.lengths(signal(spark, sf)), FS, SECONDS, OVERLAP, 5.0)


@query("section_join", f"WITH {SEC} SELECT record_id, wave_section, count(*) AS n, round(sum(v), 4) AS total FROM sec GROUP BY ALL")
def q_section_join(spark, sf):
    return sectioned(spark, sf).groupBy(*fr.KEYS).agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("beat_section_open", f"WITH {PEAKS}, every AS (SELECT DISTINCT record_id, r_idx FROM peaks), bounds AS (SELECT record_id, wave_section, min(idx) AS a, min(idx) + 100 AS b FROM sec GROUP BY ALL) SELECT p.record_id, wave_section, r_idx FROM every p JOIN bounds s ON p.record_id = s.record_id AND r_idx > a AND r_idx < b")
def q_beat_section(spark, sf):
    found = peaks(spark, sf).select("record_id", "r_idx").distinct().join(fr.lengths(signal(spark, sf)), "record_id")
    return fr.section_join(found, FS, SECONDS, OVERLAP, position="r_idx", closed="none").select("record_id", "wave_section", "r_idx")


@query("rolling_median", f"""WITH {SIG}, f AS (SELECT record_id, idx, v, n, quantile_cont(v, 0.5) OVER (PARTITION BY record_id ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS mid, quantile_cont(v, 0.5) OVER (PARTITION BY record_id ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) AS late FROM sig JOIN num USING (record_id))
SELECT record_id, idx, round(CASE WHEN idx < 20 THEN (SELECT mid FROM f g WHERE g.record_id = f.record_id AND g.idx = 20) WHEN idx + 21 >= n THEN (SELECT late FROM f g WHERE g.record_id = f.record_id AND g.idx = g.n - 21) ELSE mid END, 6) AS rolling_med FROM f""")
def q_rolling_median(spark, sf):
    return fr.rolling_median(measured(spark, sf)).select("record_id", "idx", r6("rolling_med"))


@query("second_gradient", f"""WITH {SEC}, a AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END AS d1 FROM sec WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY idx))
SELECT record_id, wave_section, idx, round(d1, 6) + 0.0 AS d1, round(CASE WHEN lag(d1) OVER w IS NULL THEN lead(d1) OVER w - d1 WHEN lead(d1) OVER w IS NULL THEN d1 - lag(d1) OVER w ELSE (lead(d1) OVER w - lag(d1) OVER w) / 2 END, 6) + 0.0 AS d2 FROM a WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY idx)""")
def q_second_gradient(spark, sf):
    return fr.second_gradient(sectioned(spark, sf), *fr.KEYS).select(*fr.KEYS, "idx", r6("d1"), r6("d2"))


@query("local_minima", f"""WITH {SEC}, a AS (SELECT *, sign(CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END) AS s FROM sec WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY idx)),
b AS (SELECT *, coalesce(lag(s) OVER w, last_value(s) OVER (PARTITION BY record_id, wave_section ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - s AS t FROM a WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY idx))
SELECT record_id, wave_section, idx FROM b WHERE t IN (-2, -1)""")
def q_local_minima(spark, sf):
    return fr.local_minima(sectioned(spark, sf), *fr.KEYS).select(*fr.KEYS, "idx")


@query("run_islands", f"WITH {SIG}, hot AS (SELECT record_id, idx, idx - row_number() OVER (PARTITION BY record_id ORDER BY idx) AS g FROM sig WHERE v > 20) SELECT record_id, min(idx) AS first, max(idx) AS last, count(*) AS n FROM hot GROUP BY record_id, g")
def q_runs(spark, sf):
    return fr.runs(signal(spark, sf).where("v > 20"), "record_id")


@query("group_numbers", f"WITH {SIG}, hot AS (SELECT record_id, idx AS x FROM sig WHERE v > 60), f AS (SELECT *, CASE WHEN x - lag(x) OVER w > 5 THEN 1 ELSE 0 END AS c FROM hot WINDOW w AS (PARTITION BY record_id ORDER BY x)), g AS (SELECT *, sum(c) OVER (PARTITION BY record_id ORDER BY x) AS grp FROM f) SELECT record_id, grp::BIGINT AS grp, round_even(quantile_cont(x, 0.5), 0)::BIGINT AS centre, count(*) AS n FROM g GROUP BY record_id, grp")
def q_group_numbers(spark, sf):
    return fr.group_near(signal(spark, sf).where("v > 60").select("record_id", F.col("idx").alias("x")), 5, "record_id")


@query("beat_pairs", f"WITH {PEAKS} SELECT record_id, wave_section, r_idx, lead(r_idx) OVER w AS next_idx, lead(valid) OVER w AS next_valid, lead(r_idx) OVER w - r_idx AS rr FROM peaks WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY r_idx)")
def q_beat_pairs(spark, sf):
    return fr.beat_pairs(peaks(spark, sf), *fr.KEYS).select(*fr.KEYS, "r_idx", "next_idx", "next_valid", "rr")


@query("valid_lookback", f"""WITH {PEAKS}, f AS (SELECT *, sum((valid = 0)::INT) OVER (PARTITION BY record_id, wave_section ORDER BY r_idx DESC) AS run, min(r_idx) OVER (PARTITION BY record_id, wave_section) AS oldest FROM peaks),
g AS (SELECT *, max(r_idx) OVER (PARTITION BY record_id, wave_section, run) - r_idx AS span FROM f WHERE valid = 1), h AS (SELECT record_id, wave_section, max(r_idx) AS hit FROM g WHERE span > 8 AND r_idx > oldest GROUP BY ALL)
SELECT g.record_id, g.wave_section, g.r_idx FROM g JOIN h USING (record_id, wave_section) JOIN g j ON j.record_id = g.record_id AND j.wave_section = g.wave_section AND j.r_idx = hit AND j.run = g.run WHERE g.r_idx >= hit""")
def q_valid_lookback(spark, sf):
    return fr.valid_lookback(peaks(spark, sf), 8, *fr.KEYS)


@query("asof_section", f"""WITH {SEC}, b AS (SELECT record_id, wave_section, wave_section * 80 AS a FROM sec GROUP BY ALL) SELECT s.record_id, s.idx, coalesce(max(b.wave_section) FILTER (WHERE a <= s.idx), 0)::INT AS wave_section FROM sig s JOIN b USING (record_id) GROUP BY s.record_id, s.idx""")
def q_asof(spark, sf):
    s = signal(spark, sf)
    bounds = fr.segment(fr.lengths(s), FS, SECONDS, OVERLAP, 1e9)
    return fr.asof_section(s, bounds).select("record_id", "idx", "wave_section")


@query("section_finder", f"WITH {SEC} SELECT record_id, idx, min(wave_section)::INT AS wave_section FROM (SELECT s.record_id, s.idx, k.k AS wave_section FROM sig s JOIN num USING (record_id), unnest(range(greatest(0, ceil((n - 100) / 80.0))::BIGINT)) AS k(k) WHERE s.idx >= k.k * 80 AND s.idx <= k.k * 80 + 100) GROUP BY ALL")
def q_section_finder(spark, sf):
    return fr.section_join(measured(spark, sf), FS, SECONDS, OVERLAP, closed="both").groupBy("record_id", "idx").agg(F.min("wave_section").alias("wave_section"))


@query("downsample", f"WITH {SIG} SELECT record_id, idx, v FROM sig JOIN num USING (record_id) WHERE idx % greatest(1, n // 100) = 0")
def q_downsample(spark, sf):
    return fr.downsample(measured(spark, sf), 100).select("record_id", "idx", "v")


@query("peak_intersect", f"WITH {PEAKS} SELECT DISTINCT a.record_id, a.r_idx FROM peaks a JOIN peaks b USING (record_id, r_idx) WHERE a.wave_section = b.wave_section + 1")
def q_peak_intersect(spark, sf):
    p = peaks(spark, sf)
    return p.where("wave_section % 2 = 0").select("record_id", "r_idx").intersect(p.where("wave_section % 2 = 1").select("record_id", "r_idx"))


@query("peak_except", f"WITH {PEAKS} SELECT record_id, r_idx FROM peaks GROUP BY ALL HAVING bool_and(wave_section % 2 = 0)")
def q_peak_except(spark, sf):
    p = peaks(spark, sf)
    return p.where("wave_section % 2 = 0").select("record_id", "r_idx").subtract(p.where("wave_section % 2 = 1").select("record_id", "r_idx"))


@query("peak_overlap_dedup", f"WITH {PEAKS}, stored AS (SELECT record_id, r_idx FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY r_idx DESC) AS k FROM peaks WHERE wave_section = 0) WHERE k <= 20) SELECT record_id, r_idx FROM peaks p WHERE wave_section = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.record_id = p.record_id AND s.r_idx = p.r_idx)")
def q_overlap_dedup(spark, sf):
    p = peaks(spark, sf)
    return fr.drop_known(p.where("wave_section = 1").select("record_id", "r_idx"), p.where("wave_section = 0"))


@query("union_records", f"WITH {SIG} SELECT record_id, count(*) AS n FROM (SELECT * FROM sig WHERE v > 10 UNION ALL SELECT * FROM sig WHERE v <= 10) GROUP BY 1")
def q_union(spark, sf):
    s = signal(spark, sf)
    return s.where("v > 10").unionByName(s.where("v <= 10")).groupBy("record_id").agg(F.count("*").alias("n"))


@query("block_stitch", f"WITH {SIG} SELECT record_id AS channel, idx, v FROM sig")
def q_stitch(spark, sf):
    blocks = rel.to_blocks(signal(spark, sf).withColumnRenamed("record_id", "channel"), 256)
    return rel.stitch_blocks(blocks)


@query("distinct_channels", "SELECT DISTINCT regexp_extract(name, '^(.*)_block_', 1) AS channel FROM (SELECT event_type || '_block_' || (event_id % 7) AS name FROM events) ORDER BY 1")
def q_channels(spark, sf):
    names = spark.read.parquet(f"{sf}/events.parquet").select(F.concat("event_type", F.lit("_block_"), (F.col("event_id") % 7).cast("string")).alias("name"))
    return rel.channel_names(names)


@query("next_invalid", f"WITH {PEAKS} SELECT record_id, wave_section, r_idx, min(CASE WHEN valid = 0 THEN r_idx END) OVER (PARTITION BY record_id, wave_section ORDER BY r_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_invalid, max(CASE WHEN valid = 0 THEN r_idx END) OVER (PARTITION BY record_id, wave_section ORDER BY r_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_invalid FROM peaks")
def q_next_invalid(spark, sf):
    return rel.invalid_neighbours(peaks(spark, sf), *fr.KEYS)


@query("interval_overlap", f"WITH {PEAKS}, b AS (SELECT record_id, wave_section, r_idx AS a, lead(r_idx) OVER (PARTITION BY record_id, wave_section ORDER BY r_idx) AS z FROM peaks) SELECT record_id, wave_section, a, z FROM b WHERE z > wave_section * 80 + 40 AND a < wave_section * 80 + 60")
def q_interval_overlap(spark, sf):
    b = fr.beat_pairs(peaks(spark, sf), *fr.KEYS).select(*fr.KEYS, F.col("r_idx").alias("a"), F.col("next_idx").alias("z"))
    return b.where(rel.overlaps(F.col("a"), F.col("z"), F.col("wave_section") * 80 + 40, F.col("wave_section") * 80 + 60))


@query("discord_match", f"WITH {PEAKS}, d AS (SELECT record_id, wave_section, arg_max(r_idx, (v, -r_idx)) AS d FROM peaks GROUP BY ALL) SELECT record_id, wave_section, d, count(*) FILTER (WHERE valid = 0 AND abs(r_idx - d) <= 10) AS n, count(*) FILTER (WHERE valid = 0 AND abs(r_idx - d) <= 10) > 0 AS matched FROM d JOIN peaks USING (record_id, wave_section) GROUP BY ALL")
def q_discord_match(spark, sf):
    p = peaks(spark, sf)
    d = p.groupBy(*fr.KEYS).agg(F.max(F.struct("v", (-F.col("r_idx")).alias("i")))["i"].alias("d")).withColumn("d", -F.col("d"))
    return rel.match_within(d, p.where("valid = 0").select(*fr.KEYS, "r_idx"), 10, *fr.KEYS)
