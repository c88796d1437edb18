"""Queries of statistics, heart-rate variability, intervals, scalar functions and data reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import scalars as sc
from pulseloom.operators import framing as fr
from pulseloom.operators import relational as rel
from pulseloom.operators import stats as st
from pulseloom.operators.prep import drop_any_null, drop_zeros, impute, outliers
from pulseloom.plans.framing_queries import FS, PEAKS, SEC, peaks, r6, sectioned, signal
from pulseloom.plans.registry import query
from pulseloom.sources.writers import pad_channels, run_summary, warp_clock

K = fr.KEYS
#: Beats in SQL: neighbouring local maxima with stand-ins for the fiducials, at whole samples.
BEATS = PEAKS + ", beats AS (SELECT record_id, wave_section, r_idx AS r, lead(r_idx) OVER (PARTITION BY record_id, wave_section ORDER BY r_idx) - r_idx AS rr, valid, v, r_idx % 5 AS qt_s FROM peaks)"


def t(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def beats(spark, sf) -> DataFrame:
    return fr.beat_pairs(peaks(spark, sf), *K).select(*K, F.col("r_idx").alias("r"), "rr", "valid", "v", (F.col("r_idx") % 5).alias("qt_s"))


def rr_rows(spark, sf) -> DataFrame:
    return st.adjacent_rr(peaks(spark, sf).withColumn("valid", F.lit(1)), FS, *K)


RR = PEAKS + ", rr AS (SELECT record_id, wave_section, r_idx, (lead(r_idx) OVER w - r_idx) / 10.0 * 1000 AS rr_ms, 60.0 / ((lead(r_idx) OVER w - r_idx) / 10.0) AS hr FROM peaks WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY r_idx)), rd AS (SELECT *, rr_ms - lag(rr_ms) OVER (PARTITION BY record_id, wave_section ORDER BY r_idx) AS d FROM rr WHERE rr_ms IS NOT NULL)"
_D = ", d AS (SELECT *, v - lag(v) OVER w AS d1 FROM sec WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY idx)), dd AS (SELECT *, d1 - lag(d1) OVER w AS d2 FROM d WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY idx))"


@query("section_stats", f"WITH {SEC}{_D} SELECT record_id, wave_section, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(kurtosis_pop(v), 6) + 0.0 AS kurtosis, round(max(v) - min(v), 6) AS ptp, round(quantile_cont(v, 0.35), 6) AS p35, round(quantile_cont(v, 0.95), 6) AS p95, round(avg(v) / stddev_pop(v), 6) AS snr, round(sqrt(var_pop(d2) / var_pop(d1)) / sqrt(var_pop(d1) / var_pop(v)), 6) AS hjorth FROM dd GROUP BY ALL")
def q_section_stats(spark, sf):
    return st.shape_and_hjorth(sectioned(spark, sf), *K).select(*K, "n", *[r6(c) for c in ("mean", "kurtosis", "ptp", "p35", "p95", "snr", "hjorth")])


@query("hjorth", f"WITH {SEC}{_D} SELECT record_id, wave_section, round(sqrt(var_pop(d2) / var_pop(d1)) / sqrt(var_pop(d1) / var_pop(v)), 6) AS hjorth FROM dd GROUP BY ALL")
def q_hjorth(spark, sf):
    return st.hjorth(sectioned(spark, sf), *K).select(*K, r6("hjorth"))


@query("kurtosis_gate", f"WITH {SEC} SELECT record_id, wave_section, CASE WHEN kurtosis_pop(v) < 4 THEN 'Low Kurtosis | ' ELSE '' END AS reason FROM sec GROUP BY ALL")
def q_kurtosis_gate(spark, sf):
    return sectioned(spark, sf).groupBy(*K).agg(F.when(F.kurtosis("v") < 4, "Low Kurtosis | ").otherwise("").alias("reason"))


@query("percentiles", f"WITH {SEC} SELECT record_id, wave_section, {', '.join(f'round(quantile_cont(v, {p / 100}), 6) + 0.0 AS p{p}' for p in (20, 35, 40, 50, 60, 80, 90, 94, 95, 97, 99))} FROM sec GROUP BY ALL")
def q_percentiles(spark, sf):
    ps = (20, 35, 40, 50, 60, 80, 90, 94, 95, 97, 99)
    got = sectioned(spark, sf).groupBy(*K).agg(F.percentile("v", F.array(*[F.lit(p / 100) for p in ps])).alias("p"))
    return got.select(*K, *[(F.round(F.col("p")[i], 6) + 0.0).alias(f"p{p}") for i, p in enumerate(ps)])


@query("median_mad", f"WITH {SEC}, m AS (SELECT *, median(v) OVER (PARTITION BY record_id, wave_section) AS med FROM sec) SELECT record_id, wave_section, round(any_value(med), 6) AS median, round(median(abs(v - med)), 6) AS mad FROM m GROUP BY ALL")
def q_median_mad(spark, sf):
    return st.median_mad(sectioned(spark, sf), *K).select(*K, r6("median"), r6("mad"))


@query("rr_adjacent_valid", f"WITH {PEAKS}, p AS (SELECT *, lead(r_idx) OVER w AS n, lead(valid) OVER w AS nv FROM peaks WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY r_idx)) SELECT record_id, wave_section, r_idx, round((n - r_idx) / 10.0 * 1000, 6) AS rr_ms, round(60.0 / ((n - r_idx) / 10.0), 6) AS hr FROM p WHERE valid = 1 AND nv = 1")
def q_rr(spark, sf):
    return st.adjacent_rr(peaks(spark, sf), FS, *K).select(*K, "r_idx", r6("rr_ms"), r6("hr"))


_HRV = {"hr_stats": ("round(avg(hr), 2) AS \"HR\", round(min(hr), 4) AS \"min_HR\", round(max(hr), 4) AS \"max_HR\"", ["HR", "min_HR", "max_HR"]), "sdnn": ("round(stddev_pop(hr), 5) AS \"SDNN\", round(stddev_pop(rr_ms), 5) AS sdnn_ms", ["SDNN", "sdnn_ms"]), "rmssd": ("round(sqrt(avg(d * d)), 5) AS \"RMSSD\"", ["RMSSD"]), "nn50_pnn50": ("count(*) FILTER (WHERE abs(d) > 50) AS \"NN50\", round(100.0 * count(*) FILTER (WHERE abs(d) > 50) / count(*), 4) AS \"PNN50\"", ["NN50", "PNN50"])}
for _name, (_sql, _columns) in _HRV.items():

    @query(_name, f"WITH {RR} SELECT record_id, wave_section, {_sql} FROM rd GROUP BY ALL HAVING count(*) >= 2")
    def q_hrv(spark, sf, columns=tuple(_columns)):
        return st.hrv(rr_rows(spark, sf), *K).select(*K, *columns)


_QTC = {"bazett": "qt / sqrt(rr / 1000.0)", "fridericia": "qt / pow(rr / 1000.0, 1.0 / 3.0)", "framingham": "qt + 154.0 * (1.0 - rr / 1000.0)"}
for _name, _sql in _QTC.items():

    @query(f"qtc_{_name}", f"WITH {BEATS}, q AS (SELECT record_id, wave_section, r, (300 + qt_s * 20)::INT AS qt, rr * 100 AS rr FROM beats) SELECT record_id, wave_section, r, coalesce(CASE WHEN qt > 0 AND rr > 0 THEN floor({_sql}) END, 0)::INT AS qtc FROM q")
    def q_qtc(spark, sf, name=_name):
        b = beats(spark, sf).select(*K, "r", (300 + F.col("qt_s") * 20).alias("qt"), (F.col("rr") * 100).alias("rr"))
        return b.select(*K, "r", sc.qtc(F.col("qt"), F.col("rr"), name).alias("qtc"))


@query("qtvi", f"WITH {BEATS}, q AS (SELECT record_id, wave_section, (300 + qt_s * 20)::DOUBLE AS qt, (rr * 100)::DOUBLE AS rr FROM beats), a AS (SELECT record_id, wave_section, count(qt) AS n, count(rr) AS m, var_samp(qt) / pow(avg(qt), 2) AS x, var_samp(rr) / pow(avg(rr), 2) AS y FROM q GROUP BY ALL) SELECT record_id, wave_section, CASE WHEN n >= 2 AND m >= 2 AND x > 0 AND y > 0 THEN round(log10(x / y), 2) + 0.0 END AS qtvi FROM a")
def q_qtvi(spark, sf):
    b = beats(spark, sf).select(*K, (300 + F.col("qt_s") * 20).cast("double").alias("qt"), (F.col("rr") * 100).cast("double").alias("rr"))
    return st.qtvi(b, *K).select(*K, (F.col("qtvi") + 0.0).alias("qtvi"))


@query("beat_intervals", f'WITH {BEATS} SELECT record_id, wave_section, r, trunc(1000 * (rr - 1) / 10.0)::INT AS "PR", trunc(1000 * qt_s / 10.0)::INT AS "QRS", CASE WHEN rr > 3 AND qt_s > 0 AND r > 0 AND valid > 0 AND v > 0 THEN 1 ELSE 0 END::INT AS valid_qrs FROM beats')
def q_intervals(spark, sf):
    b = beats(spark, sf)
    ok = sc.valid_qrs(F.col("rr") - 3, F.col("qt_s"), F.col("r"), F.col("valid"), F.col("v"))
    return b.select(*K, "r", sc.interval_ms(F.col("rr"), F.lit(1), FS).alias("PR"), sc.interval_ms(F.col("qt_s"), F.lit(0), FS).alias("QRS"), ok.alias("valid_qrs"))


@query("interval_means", f'WITH {BEATS} SELECT record_id, wave_section, round(avg(nullif(qt_s * 100.0, 0)), 1) AS "QT", round(avg(nullif(rr * 100.0, 0)), 1) AS "PR" FROM beats GROUP BY ALL')
def q_interval_means(spark, sf):
    b = beats(spark, sf).select(*K, (F.col("qt_s") * 100.0).alias("QT"), (F.col("rr") * 100.0).alias("PR"))
    return st.interval_means(b, *K, columns=("QT", "PR"))


@query("safe_mean", f"WITH {PEAKS} SELECT record_id, wave_section, round(avg(CASE WHEN valid = 1 THEN v END), 4) AS mean FROM peaks GROUP BY ALL")
def q_safe_mean(spark, sf):
    return peaks(spark, sf).withColumn("v", F.when(F.col("valid") == 1, F.col("v")).otherwise(float("nan"))).groupBy(*K).agg(st.safe_mean(F.col("v"), 4).alias("mean"))


@query("trapezoid_auc", f"WITH {SEC} SELECT record_id, wave_section, round(sum(a), 6) AS area FROM (SELECT *, (v + lead(v) OVER (PARTITION BY record_id, wave_section ORDER BY idx)) / 2 * 0.1 AS a FROM sec) GROUP BY ALL")
def q_trapezoid(spark, sf):
    return st.trapezoid(sectioned(spark, sf), 1 / FS, *K).select(*K, r6("area"))


@query("linear_slope", f"WITH {SEC} SELECT record_id, wave_section, round(regr_slope(v, idx), 6) + 0.0 AS slope, round(regr_intercept(v, idx), 4) + 0.0 AS intercept, round(regr_slope(idx, v), 6) + 0.0 AS inverse_slope FROM sec GROUP BY ALL")
def q_slope(spark, sf):
    return st.linear_fit(sectioned(spark, sf), *K).select(*K, r6("slope"), (F.round("intercept", 4) + 0.0).alias("intercept"), r6("inverse_slope"))


@query("rmse", f"WITH {SEC} SELECT record_id, wave_section, round(sqrt(avg(pow(v - p, 2))), 6) AS rmse FROM (SELECT *, lag(v) OVER (PARTITION BY record_id, wave_section ORDER BY idx) AS p FROM sec) GROUP BY ALL")
def q_rmse(spark, sf):
    s = sectioned(spark, sf).withColumn("p", F.lag("v").over(fr.ordered(*K)))
    return st.rmse(s, "v", "p", *K).select(*K, r6("rmse"))


_CIRC = "WITH a AS (SELECT event_type AS record_id, value / 10.0 AS x FROM events), b AS (SELECT record_id, avg(cos(x)) AS c, avg(sin(x)) AS s FROM a GROUP BY 1) "


@query("circular_mean", _CIRC + "SELECT record_id, round(atan2(s, c), 6) AS mean_angle FROM b")
def q_circular_mean(spark, sf):
    return st.circular(t(spark, sf, "events").select(F.col("event_type").alias("record_id"), (F.col("value") / 10.0).alias("angle")), "record_id").select("record_id", r6("mean_angle"))


@query("circular_variance", _CIRC + "SELECT record_id, round(1 - sqrt(c * c + s * s), 6) AS variance FROM b")
def q_circular_variance(spark, sf):
    return st.circular(t(spark, sf, "events").select(F.col("event_type").alias("record_id"), (F.col("value") / 10.0).alias("angle")), "record_id").select("record_id", r6("variance"))


@query("cosine_similarity", "WITH e AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS a, vec_id FROM embeddings), c AS (SELECT label, arg_min(a, vec_id) AS b FROM e GROUP BY label) SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))), 5) + 0.0 AS cosine FROM e JOIN c USING (label)")
def q_cosine(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    first = e.groupBy("label").agg(F.min_by("a", "vec_id").alias("b"))
    return e.join(first, "label").select("vec_id", (F.round(st.cosine(F.col("a"), F.col("b")), 5) + 0.0).alias("cosine"))


@query("bad_beat_ratio", f"WITH {PEAKS} SELECT record_id, wave_section, round(avg((valid = 0)::INT), 6) AS ratio, avg((valid = 0)::INT) <= 0.25 AS ok FROM peaks GROUP BY ALL")
def q_bad_ratio(spark, sf):
    return st.bad_ratio(peaks(spark, sf), *K).select(*K, r6("ratio"), "ok")


@query("peak_count_gate", f"WITH {PEAKS} SELECT record_id, wave_section, count(*) AS n, CASE WHEN count(*) < 4 OR count(*) > 100 THEN 'no_sig' ELSE '' END AS reason FROM peaks GROUP BY ALL")
def q_count_gate(spark, sf):
    n = F.count("*")
    return peaks(spark, sf).groupBy(*K).agg(n.alias("n"), F.when((n < 4) | (n > 100), "no_sig").otherwise("").alias("reason"))


@query("shock_class", "WITH e AS (SELECT event_id, value, max(value) OVER (PARTITION BY user_id) AS m FROM events) SELECT event_id, CASE WHEN value / m >= 1 THEN 'BL' WHEN value / m >= 0.85 THEN 'C1' WHEN value / m >= 0.70 THEN 'C2' WHEN value / m >= 0.60 THEN 'C3' WHEN value / m < 0.60 THEN 'C4' END AS cls FROM e")
def q_shock(spark, sf):
    e = t(spark, sf, "events")
    most = e.groupBy("user_id").agg(F.max("value").alias("m"))
    return e.join(most, "user_id").select("event_id", sc.shock_class(F.col("value"), F.col("m")).alias("cls"))


@query("majority_label", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, event_type AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) WHERE k = 1")
def q_majority(spark, sf):
    return st.majority(t(spark, sf, "events"), "event_type", "event_id", "user_id")


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q_value_counts(spark, sf):
    return st.value_counts(t(spark, sf, "events"), "event_type")


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("summary_nonzero", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, max({c}) AS max, min({c}) AS min, count(*) AS n FROM lineitem WHERE {c} <> 0" for c in _LINE))
def q_summary(spark, sf):
    return st.summary_nonzero(t(spark, sf, "lineitem"), _LINE).select("column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "max", "min", "n")


_NULLS = "SELECT nullif(l_discount, 0) AS a, CASE WHEN l_tax > 0.05 THEN l_tax END AS b, l_quantity AS c FROM lineitem"


def nulled(spark, sf) -> DataFrame:
    return t(spark, sf, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("a"), F.when(F.col("l_tax") > 0.05, F.col("l_tax")).alias("b"), F.col("l_quantity").alias("c"))


@query("null_report", f"WITH x AS ({_NULLS}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 6) AS percent, 100.0 * (count(*) - count({c})) / count(*) > 30 AS high FROM x" for c in "abc"))
def q_null_report(spark, sf):
    return st.null_report(nulled(spark, sf), list("abc")).select("column", "nulls", r6("percent"), "high")


@query("numeric_report", f"WITH x AS ({_NULLS}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}) FILTER (WHERE {c} <> 0), 4) AS mean, round(stddev_samp({c}) FILTER (WHERE {c} <> 0), 4) AS std, (max({c}) FILTER (WHERE {c} <> 0))::DOUBLE AS max, (min({c}) FILTER (WHERE {c} <> 0))::DOUBLE AS min, count(*) FILTER (WHERE {c} <> 0) AS n, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 6) AS percent, 100.0 * (count(*) - count({c})) / count(*) > 30 AS high FROM x" for c in "abc"))
def q_numeric_report(spark, sf):
    return st.numeric_report(nulled(spark, sf), list("abc")).select("column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "max", "min", "n", "nulls", r6("percent"), "high")


@query("cosine_of_columns", f"WITH x AS ({_NULLS}), f AS (SELECT coalesce(a, avg(a) OVER ())::DOUBLE AS a, coalesce(b, avg(b) OVER ())::DOUBLE AS b, coalesce(c, avg(c) OVER ())::DOUBLE AS c FROM x) " + " UNION ALL ".join(f"SELECT '{p}' AS a, '{q}' AS b, round(sum({p} * {q}) / (sqrt(sum({p} * {p})) * sqrt(sum({q} * {q}))), 6) AS cosine FROM f" for p, q in ("ab", "ac", "bc")))
def q_cosine_of_columns(spark, sf):
    return st.cosine_of_columns(nulled(spark, sf), list("abc")).select("a", "b", r6("cosine"))


@query("distinct_indexes", "SELECT user_id, list_sort(list_distinct(list((event_id % 7)::BIGINT))) AS bad FROM events GROUP BY 1")
def q_distinct_indexes(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.array_distinct(F.collect_list((F.col("event_id") % 7).cast("long")))).alias("bad"))


@query("dropna_any", f"WITH x AS ({_NULLS}) SELECT count(*) AS n, round(sum(c), 2) AS total FROM x WHERE a IS NOT NULL AND b IS NOT NULL")
def q_dropna(spark, sf):
    return drop_any_null(nulled(spark, sf), ["a", "b"]).agg(F.count("*").alias("n"), F.round(F.sum("c"), 2).alias("total"))


@query("drop_zero", "SELECT count(*) AS n FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0")
def q_drop_zero(spark, sf):
    return drop_zeros(t(spark, sf, "lineitem"), ["l_discount", "l_tax"]).agg(F.count("*").alias("n"))


for _how, _sql in {"mean": "avg(b)", "median": "median(b)", "mode": "(SELECT b FROM x WHERE b IS NOT NULL GROUP BY b ORDER BY count(*) DESC, b LIMIT 1)"}.items():

    @query(f"impute_{_how}", f"WITH x AS ({_NULLS}), m AS (SELECT {_sql} AS m FROM x LIMIT 1) SELECT round(sum(coalesce(b, m)), 4) AS total, count(*) AS n FROM x, m")
    def q_impute(spark, sf, how=_how):
        return impute(nulled(spark, sf), ["b"], how).agg(F.round(F.sum("b"), 4).alias("total"), F.count("*").alias("n"))


@query("outlier_iqr_chain", """WITH a AS (SELECT l_extendedprice AS p, l_quantity AS q FROM lineitem), b AS (SELECT quantile_cont(p, 0.25) AS x, quantile_cont(p, 0.75) AS y FROM a), c AS (SELECT a.* FROM a, b WHERE p IS NULL OR (p >= x - 0.5 * (y - x) AND p <= y + 0.5 * (y - x))), d AS (SELECT quantile_cont(q, 0.25) AS x, quantile_cont(q, 0.75) AS y FROM c)
SELECT count(*) AS n, round(sum(p), 2) AS total FROM c, d WHERE q IS NULL OR (q >= x - 0.4 * (y - x) AND q <= y + 0.4 * (y - x))""")
def q_outliers(spark, sf):
    x = t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"))
    return outliers(outliers(x, ["p"], 0.5), ["q"], 0.4).agg(F.count("*").alias("n"), F.round(F.sum("p"), 2).alias("total"))


@query("pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def q_pearson(spark, sf):
    return t(spark, sf, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


def _ranks(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query("spearman", f"WITH r AS (SELECT {_ranks('l_quantity')} AS a, {_ranks('l_extendedprice')} AS b, {_ranks('l_tax')} AS c FROM lineitem) SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(a, b), 6) + 0.0 AS rho FROM r UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(a, c), 6) + 0.0 FROM r UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(b, c), 6) + 0.0 FROM r")
def q_spearman(spark, sf):
    return st.spearman(t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).select("a", "b", r6("rho"))


@query("time_labels", "SELECT event_id, CASE WHEN s < 60 THEN format('{:.1f} s', s) WHEN s < 3600 THEN format('{:.1f} m', s / 60) ELSE format('{:.1f} h', s / 3600) END AS label FROM (SELECT event_id, (event_id * 7 + 0.25)::DOUBLE AS s FROM events)")
def q_time_labels(spark, sf):
    return t(spark, sf, "events").select("event_id", sc.time_label(F.col("event_id") * 7 + F.lit(0.25)).alias("label"))


@query("count_labels", "SELECT event_id, replace(format('{:,}', n), ',', '_') || CASE WHEN n >= 1000000 THEN ' M' WHEN n >= 1000 THEN ' K' ELSE '' END AS label FROM (SELECT event_id, event_id * 613 AS n FROM events)")
def q_count_labels(spark, sf):
    return t(spark, sf, "events").select("event_id", sc.count_label(F.col("event_id") * 613).alias("label"))


@query("size_labels", "SELECT event_id, CASE WHEN n < 1024 THEN format('{:.2f} B', n) WHEN n < 1024.0**2 THEN format('{:.2f} KB', n / 1024) WHEN n < 1024.0**3 THEN format('{:.2f} MB', n / 1024.0**2) WHEN n < 1024.0**4 THEN format('{:.2f} GB', n / 1024.0**3) ELSE format('{:.2f} PB', n / 1024.0**4) END AS label FROM (SELECT event_id, (event_id::DOUBLE * event_id * event_id * 7) AS n FROM events)")
def q_size_labels(spark, sf):
    x = F.col("event_id").cast("double")
    return t(spark, sf, "events").select("event_id", sc.size_label(x * x * x * 7).alias("label"))


@query("clean_names", "SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9]', '_', 'g') AS name FROM customer")
def q_clean_names(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", sc.clean_name(F.col("c_name")).alias("name"))


@query("fold_names", "SELECT doc_id, substr(translate(text, 'äöüÄÖÜß', 'aouAOUs'), 1, 16) AS name FROM documents WHERE lang = 'de'")
def q_fold_names(spark, sf):
    return t(spark, sf, "documents").where("lang = 'de'").select("doc_id", sc.fold_name(F.col("text")).alias("name"))


@query("fail_reasons", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '|'), lambda x: trim(x)), lambda x: x <> ''), ';') AS reasons FROM documents WHERE contains(text, '|')")
def q_reasons(spark, sf):
    return t(spark, sf, "documents").where(F.contains("text", F.lit("|"))).select("doc_id", F.array_join(sc.reasons(F.col("text")), ";").alias("reasons"))


@query("lead_rank_levenshtein", "SELECT name, round(ratio, 6) AS ratio, row_number() OVER (ORDER BY ratio DESC, name)::INT AS place FROM (SELECT n_name AS name, CASE WHEN contains(lower(n_name), 'india') THEN 1.0 ELSE (greatest(length(n_name), 5) - levenshtein(lower(n_name), 'india')) / greatest(length(n_name), 5) END AS ratio FROM nation) ORDER BY ratio DESC, name LIMIT 6")
def q_lead_rank(spark, sf):
    return rel.rank_names(t(spark, sf, "nation").select(F.col("n_name").alias("name")), "India", 6).select("name", r6("ratio"), "place")


@query("clock_correction", f"WITH {PEAKS} SELECT record_id, wave_section, r_idx, round(r_idx - (r_idx - wave_section * 80) * 0.013)::BIGINT AS corrected FROM peaks")
def q_clock(spark, sf):
    return peaks(spark, sf).select(*K, "r_idx", sc.clock_corrected(F.col("r_idx").cast("double"), F.col("wave_section") * 80, F.lit(0.013)).alias("corrected"))


@query("block_times", "SELECT event_id, ts + to_milliseconds((value * 1000)::BIGINT) AS stop, date_diff('second', lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id), ts) AS gap FROM events")
def q_block_times(spark, sf):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = t(spark, sf, "events")
    stop = F.timestamp_add("MILLISECOND", F.round(F.col("value") * 1000).cast("int"), F.col("ts"))
    gap = F.timestamp_diff("SECOND", F.date_trunc("second", F.lag("ts").over(w)), F.date_trunc("second", F.col("ts")))
    return e.select("event_id", stop.alias("stop"), gap.alias("gap"))


@query("null_tokens", "SELECT o_orderkey, CASE WHEN p IN ('UNKNOWN', 'nan', '') THEN NULL ELSE p END AS label FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END AS p FROM orders)")
def q_null_tokens(spark, sf):
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").select("o_orderkey", sc.null_token(F.when(k % 5 == 0, "UNKNOWN").when(k % 7 == 0, "").otherwise(F.col("o_orderstatus"))).alias("label"))


@query("event_props", "SELECT event_id, props->>'$.k' AS k, length(props) AS n FROM events")
def q_props(spark, sf):
    return t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


@query("top_discords", f"WITH {PEAKS} SELECT record_id, wave_section, r_idx, v, row_number() OVER (ORDER BY v DESC, record_id, r_idx, wave_section)::INT AS place FROM peaks ORDER BY v DESC, record_id, r_idx, wave_section LIMIT 10")
def q_top_discords(spark, sf):
    p = peaks(spark, sf).withColumn("tie", F.struct("record_id", "r_idx", "wave_section"))
    return rel.top_k(p, 10, "v", "tie").select(*K, "r_idx", "v", "place")


@query("section_discord", f"WITH {PEAKS} SELECT record_id, wave_section, r_idx, v FROM (SELECT *, row_number() OVER (PARTITION BY record_id, wave_section ORDER BY v DESC, r_idx) AS k FROM peaks) WHERE k = 1")
def q_section_discord(spark, sf):
    return rel.top_k(peaks(spark, sf), 1, "v", "r_idx", *K).select(*K, "r_idx", "v")


@query("lowest_k", f"WITH {PEAKS} SELECT record_id, wave_section, r_idx FROM (SELECT *, row_number() OVER (PARTITION BY record_id, wave_section ORDER BY v, r_idx) AS k, count(*) FILTER (WHERE valid = 0) OVER (PARTITION BY record_id, wave_section) AS bad FROM peaks) WHERE k <= bad")
def q_lowest_k(spark, sf):
    p = peaks(spark, sf)
    bad = F.count_if(F.col("valid") == 0).over(Window.partitionBy(*K))
    ranked = p.withColumns({"k": F.row_number().over(Window.partitionBy(*K).orderBy("v", "r_idx")), "bad": bad})
    return ranked.where("k <= bad").select(*K, "r_idx")


@query("snr", f"WITH {SEC} SELECT record_id, wave_section, round(avg(v) / stddev_pop(v), 6) AS snr FROM sec GROUP BY ALL")
def q_snr(spark, sf):
    return st.shape(sectioned(spark, sf), *K).select(*K, r6("snr"))


@query("ptp", f"WITH {SEC} SELECT record_id, wave_section, round(max(v) - min(v), 6) AS ptp FROM sec GROUP BY ALL")
def q_ptp(spark, sf):
    return st.shape(sectioned(spark, sf), *K).select(*K, r6("ptp"))


@query("run_summary", f"WITH {PEAKS}, s AS (SELECT record_id, wave_section, (avg((valid = 0)::INT) <= 0.5)::INT AS valid FROM peaks GROUP BY ALL), r AS (SELECT *, CASE WHEN valid = 1 THEN '' ELSE 'Bad Beat' END AS fail_reason FROM s) SELECT 'valid' AS kind, valid::VARCHAR AS value, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'fail_reason', fail_reason, count(*) FROM r GROUP BY ALL")
def q_run_summary(spark, sf):
    s = st.bad_ratio(peaks(spark, sf), *K, most=0.5).withColumn("valid", F.col("ok").cast("int")).withColumn("fail_reason", F.when(F.col("ok"), "").otherwise("Bad Beat"))
    return run_summary(s)


@query("valid_section_runs", f"WITH {PEAKS}, s AS (SELECT record_id, wave_section FROM peaks GROUP BY ALL HAVING avg((valid = 0)::INT) <= 0.5), g AS (SELECT *, wave_section - row_number() OVER (PARTITION BY record_id ORDER BY wave_section) AS g FROM s) SELECT record_id, min(wave_section) AS first, max(wave_section) AS last, count(*) AS n FROM g GROUP BY record_id, g")
def q_valid_runs(spark, sf):
    s = st.bad_ratio(peaks(spark, sf), *K, most=0.5).where("ok")
    return fr.runs(s, "record_id", by="wave_section")


@query("top_sections_rmssd", f"WITH {RR}, r AS (SELECT record_id, wave_section, round(sqrt(avg(d * d)), 5) AS rmssd FROM rd GROUP BY ALL HAVING count(*) >= 2) SELECT record_id, wave_section, rmssd, row_number() OVER (ORDER BY rmssd DESC, record_id, wave_section)::INT AS place FROM r ORDER BY rmssd DESC, record_id, wave_section LIMIT 20")
def q_top_sections(spark, sf):
    r = st.hrv(rr_rows(spark, sf), *K).select(*K, F.col("RMSSD").alias("rmssd"), F.struct("record_id", "wave_section").alias("tie"))
    return rel.top_k(r, 20, "rmssd", "tie").select(*K, "rmssd", "place")


@query("block_clock", f"WITH {PEAKS} SELECT record_id, wave_section, r_idx, (r_idx // 300) AS block, round(r_idx - (r_idx - (r_idx // 300) * 300) * 0.02)::BIGINT AS corrected FROM peaks")
def q_block_clock(spark, sf):
    # the block of a position follows from the position: no range join
    block = F.floor(F.col("r_idx") / 300)
    return peaks(spark, sf).select(*K, "r_idx", block.alias("block"), sc.clock_corrected(F.col("r_idx").cast("double"), block * 300, F.lit(0.02)).alias("corrected"))


@query("pad_channels", f"WITH {SEC} SELECT s.record_id AS channel, g AS idx, coalesce(v, 0) AS v FROM (SELECT record_id, unnest(range((SELECT max(n) FROM num))) AS g FROM num) s LEFT JOIN sig ON sig.record_id = s.record_id AND sig.idx = s.g")
def q_pad(spark, sf):
    s = signal(spark, sf).select(F.lit("all").alias("record_id"), F.col("record_id").alias("channel"), "idx", "v")
    return pad_channels(s).select("channel", "idx", "v")


@query("warp_clock", f"WITH {SEC}, m AS (SELECT record_id, idx * 0.98 AS p, lead(idx) OVER w * 0.98 AS q, v, lead(v) OVER w AS v1 FROM sig WINDOW w AS (PARTITION BY record_id ORDER BY idx)) SELECT record_id, ceil(p)::BIGINT AS idx, round(v + (v1 - v) * (ceil(p) - p) / (q - p), 5) + 0.0 AS v FROM m WHERE q IS NOT NULL AND ceil(p) < q")
def q_warp(spark, sf):
    return warp_clock(signal(spark, sf), 0.02).select("record_id", "idx", (F.round("v", 5) + 0.0).alias("v"))


@query("interval_backfill", f'WITH {PEAKS}, s AS (SELECT record_id, wave_section, min(idx) AS a FROM sec GROUP BY ALL), b AS (SELECT DISTINCT record_id, r_idx, (r_idx % 4) * 20.0 AS "QT" FROM peaks) SELECT s.record_id, s.wave_section, round(avg(nullif("QT", 0)), 1) AS "QT" FROM s JOIN b ON b.record_id = s.record_id AND b.r_idx > s.a AND b.r_idx < s.a + 100 GROUP BY ALL')
def q_backfill(spark, sf):
    b = peaks(spark, sf).select("record_id", "r_idx").distinct().withColumn("QT", (F.col("r_idx") % 4) * 20.0).join(fr.lengths(signal(spark, sf)), "record_id")
    placed = fr.section_join(b, FS, 10.0, 0.2, position="r_idx", closed="none")
    return st.interval_means(placed, *K, columns=("QT",))
