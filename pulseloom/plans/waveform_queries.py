"""Queries of the waveform operators over the driver's events and embeddings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.operators import framing as fr
from pulseloom.operators import stats as st
from pulseloom.operators import waveforms as wf
from pulseloom.plans.framing_queries import FS, LIN, OVERLAP, PEAKS, PSD, SEC, SECONDS, SIG, measured, peaks, r6, sectioned, signal
from pulseloom.plans.registry import query

K = fr.KEYS
#: The same kernels written out in SQL: Savitzky-Golay weights of 15 samples, order 3, in the middle of a section.
_W = ", ".join(f"({x}, {(167 - 5 * x * x) / 1105})" for x in range(-7, 8))


def arrays(spark, sf) -> DataFrame:
    return wf.section_arrays(sectioned(spark, sf))


#: The ECG that the events stand for: 0.2 s for each event at 250 samples a second, a beat every 0.8 s whose R wave follows the event's value.
#: By time in a cycle of 200 s: clean, from 90 s on at 0.3 of its height, from 100 s to 165 s noise; recordings begin at a place that their
#: name decides.
ECG_FS, PER_EVENT, BEAT_S, CYCLE = 250.0, 50, 0.8, 200.0
_WAVES = ((0.16, 0.02, 0.12), (0.235, 0.008, -0.12), (0.29, 0.01, -0.2), (0.48, 0.035, 0.3))


#: The same ECG, its sections and their local maxima (middles of flat tops) in SQL.
_BELL = "exp(-pow((phase - {}::DOUBLE) / {}::DOUBLE, 2) / 2)"
ECG_SQL = SIG + f""", raw AS (SELECT record_id, idx * {PER_EVENT} + j AS idx, n * {PER_EVENT} AS n, v AS value, (('0x' || substr(md5(record_id), 1, 8))::BIGINT % {int(CYCLE)}) AS off FROM sig JOIN num USING (record_id), range({PER_EVENT}) AS u(j)),
timed AS (SELECT *, idx / 250::DOUBLE AS t, (idx / 250::DOUBLE + off) % {CYCLE}::DOUBLE AS place, (idx / 250::DOUBLE) % {BEAT_S}::DOUBLE AS phase, sin(0.37::DOUBLE * (idx * (idx % 1009) % 8191)) AS noise FROM raw),
ecg AS (SELECT record_id, idx, n, round(CASE WHEN place >= 100 AND place < 165 THEN 0.5::DOUBLE * noise ELSE (CASE WHEN place >= 90 AND place < 100 THEN 0.3 ELSE 1 END)::DOUBLE * ((1.1::DOUBLE + 0.001::DOUBLE * value) * {_BELL.format(0.26, 0.009)} {' '.join(f'+ ({h})::DOUBLE * {_BELL.format(a, w)}' for a, w, h in _WAVES)}) + 0.02::DOUBLE * sin(pi() / 2 * t) + 0.004::DOUBLE * noise END, 6) AS v FROM timed),
es AS (SELECT record_id, k::INT AS wave_section, idx, v FROM ecg, unnest(range(greatest(0, ceil((n - 2500) / 2000.0))::BIGINT)) AS u(k) WHERE idx >= k * 2000 AND idx < k * 2000 + 2500),
er AS (SELECT record_id, wave_section, run, min(idx) AS a, max(idx) AS b, any_value(v) AS v FROM (SELECT *, sum(fresh) OVER (PARTITION BY record_id, wave_section ORDER BY idx) AS run FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY record_id, wave_section ORDER BY idx) THEN 0 ELSE 1 END AS fresh FROM es)) GROUP BY record_id, wave_section, run),
tops AS (SELECT record_id, wave_section, (a + b) // 2 AS p, v FROM (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM er WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY run)) WHERE v > before AND v > after)"""


def _offset() -> F.Column:
    return F.conv(F.substring(F.md5(F.col("record_id").cast("binary")), 1, 8), 16, 10).cast("long") % int(CYCLE)


def ecg(spark, sf) -> DataFrame:
    """(record_id, idx, v, n) of the ECG that the events stand for."""
    e = measured(spark, sf).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(PER_EVENT - 1))))
    rows = e.select("record_id", (F.col("idx") * PER_EVENT + F.col("_j")).alias("idx"), "v", (F.col("n") * PER_EVENT).alias("n"))
    t, i = F.col("idx") / ECG_FS, F.col("idx")
    place, phase = F.pmod(t + _offset(), F.lit(CYCLE)), F.pmod(t, F.lit(BEAT_S))
    bell = lambda at, width: F.exp(-F.pow((phase - at) / width, F.lit(2.0)) / 2)
    beat = (1.1 + 0.001 * F.col("v")) * bell(0.26, 0.009)
    for at, width, height in _WAVES:
        beat = beat + height * bell(at, width)
    noise = F.sin(0.37 * (i * (i % 1009) % 8191))
    clean = F.when((place >= 90) & (place < 100), 0.3).otherwise(1.0) * beat + 0.02 * F.sin(math.pi / 2 * t) + 0.004 * noise
    return rows.select("record_id", "idx", F.round(F.when((place >= 100) & (place < 165), 0.5 * noise).otherwise(clean), 6).alias("v"), "n")


def _ecg_wave(values: np.ndarray, idx: np.ndarray, off: int) -> np.ndarray:
    """ecg's samples ``idx`` (ascending, of whole events) from the events' values."""
    v, t = np.repeat(values, PER_EVENT), idx / ECG_FS
    place, phase = np.fmod(t + off, CYCLE), np.fmod(t, BEAT_S)
    bell = lambda at, width: np.exp(-(((phase - at) / width) ** 2) / 2)
    beat = (1.1 + 0.001 * v) * bell(0.26, 0.009)
    for at, width, height in _WAVES:
        beat = beat + height * bell(at, width)
    noise = np.sin(0.37 * (idx * (idx % 1009) % 8191))
    clean = np.where((place >= 90) & (place < 100), 0.3, 1.0) * beat + 0.02 * np.sin(math.pi / 2 * t) + 0.004 * noise
    return np.round(np.where((place >= 100) & (place < 165), 0.5 * noise, clean), 6)


def ecg_sections(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Sections of 10 s of the ECG (with its rolling median as ``med``), and of its rolling median.

    Events, not samples, meet their sections and are shuffled, with one event more on either side for the median's frames; a kernel makes
    the samples. Full sections end before the recording's last event, so no frame is cut short there.
    """
    size, step = (int(s * ECG_FS / PER_EVENT) for s in (SECONDS, SECONDS * (1 - OVERLAP)))
    k, i = F.col("wave_section"), F.col("idx")
    full = F.ceil((F.col("n") - size) / step)
    span = F.sequence(F.greatest(F.lit(0), F.ceil((i - size) / step)).cast("int"), F.least(full - 1, F.floor((i + 1) / step)).cast("int"), F.lit(1))
    met = measured(spark, sf).where((F.col("n") > size) & (i <= (full - 1) * step + size)).withColumn("wave_section", F.explode(span))
    held = wf.dealt(met, *K).groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("r"))
    rows = held.select(*K, (k * step * PER_EVENT).cast("long").alias("start"), (F.col("r")[0]["idx"] * PER_EVENT).alias("first"), F.transform("r", lambda x: x["v"].cast("double")).alias("values"), _offset().alias("off"))

    def run(batches):
        for batch in batches:
            waves, meds = [], []
            for start, first, values, off in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist()):
                values = values.values.to_numpy(zero_copy_only=False).astype(float)
                x = _ecg_wave(values, np.arange(first, first + PER_EVENT * len(values)), off)
                med = wf.frame_medians(x)
                at = start - first
                if first == 0:
                    med[:20] = med[20]
                waves.append(x[at : at + size * PER_EVENT])
                meds.append(med[at : at + size * PER_EVENT])
            ends = pa.array(np.arange(len(waves) + 1, dtype=np.int32) * size * PER_EVENT)
            whole = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0), *part]), from_pandas=True)) for part in (waves, meds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *whole], ["record_id", "wave_section", "start", "wave", "med"])

    wf.small_batches(spark)
    both = rows.mapInArrow(run, f"{wf.KEYS}, start long, wave array<double>, med array<double>")
    return both, both.select(*K, "start", F.col("med").alias("wave"))


def ecg_folded(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    waves, meds = ecg_sections(spark, sf)
    return waves, meds, wf.history_fold(wf.quality_rows(waves, meds, ECG_FS), ECG_FS)


def vectors(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("record_id"), F.lit(0).alias("wave_section"), F.lit(0).cast("long").alias("start"), F.col("embedding").cast("array<double>").alias("wave"))


@query("section_arrays", f"WITH {SEC} SELECT record_id, wave_section, min(idx) AS start, count(*)::INT AS n, arg_min(v, idx) AS first, arg_max(v, idx) AS last FROM sec GROUP BY ALL")
def q_arrays(spark, sf):
    return arrays(spark, sf).select(*K, "start", F.size("wave").alias("n"), F.col("wave")[0].alias("first"), F.element_at("wave", -1).alias("last"))


@query("savgol", f"WITH {SEC}, w(o, c) AS (VALUES {_W}) SELECT a.record_id, a.wave_section, a.idx, round(sum(b.v * c), 5) + 0.0 AS y FROM sec a JOIN w ON true JOIN sec b ON b.record_id = a.record_id AND b.wave_section = a.wave_section AND b.idx = a.idx + o WHERE a.idx - a.wave_section * 80 BETWEEN 7 AND 92 GROUP BY ALL")
def q_savgol(spark, sf):
    out = wf.smoothed(arrays(spark, sf), FS, "savgol", window=15, order=3)
    return out.where((F.col("idx") - F.col("wave_section") * 80).between(7, 92)).select(*K, "idx", (F.round("y", 5) + 0.0).alias("y"))


@query("highpass")
def q_highpass(spark, sf):
    return wf.smoothed(arrays(spark, sf), FS, "high", cut=0.5).select(*K, "idx", r6("y"))


@query("notch")
def q_notch(spark, sf):
    return wf.smoothed(ecg_sections(spark, sf)[0], ECG_FS, "notch").select(*K, "idx", r6("y"))


@query("lowpass")
def q_lowpass(spark, sf):
    return wf.smoothed(arrays(spark, sf), FS, "low", cut=2.0).select(*K, "idx", r6("y"))


@query("bandpass")
def q_bandpass(spark, sf):
    return wf.smoothed(arrays(spark, sf), FS, "band", cut=(0.5, 2.0)).select(*K, "idx", r6("y"))


def _edge_weights() -> str:
    """(place in the section, offset, weight) of the first derivative of a cubic through five samples: the middle (-1) and both ends."""
    t = np.arange(-2, 3)
    solve = np.linalg.inv(np.vander(t, 4, increasing=True).T @ np.vander(t, 4, increasing=True)) @ np.vander(t, 4, increasing=True).T
    rows = [(-1, o, w) for o, w in zip((-2, -1, 1, 2), (1 / 12, -8 / 12, 8 / 12, -1 / 12))]
    for place, centre in ((0, 2), (1, 2), (98, 97), (99, 97)):
        u = place - centre
        rows += [(place, centre + o - place, float(solve[1, i] + 2 * u * solve[2, i] + 3 * u * u * solve[3, i])) for i, o in enumerate(t.tolist())]
    return ", ".join(f"({p}, {o}, {w!r}::DOUBLE)" for p, o, w in rows)


@query("derivative", f"WITH {SEC}, w(place, o, c) AS (VALUES {_edge_weights()}), l AS (SELECT *, idx - wave_section * 80 AS i FROM sec) SELECT a.record_id, a.wave_section, a.idx, round(sum(b.v * c), 6) + 0.0 AS y FROM l a JOIN w ON place = CASE WHEN a.i BETWEEN 2 AND 97 THEN -1 ELSE a.i END JOIN l b ON b.record_id = a.record_id AND b.wave_section = a.wave_section AND b.idx = a.idx + o GROUP BY ALL")
def q_derivative(spark, sf):
    return wf.smoothed(arrays(spark, sf), FS, "d1").select(*K, "idx", r6("y"))


@query("find_peaks", f"""WITH {SEC}, f AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS fresh FROM sec WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY idx)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY record_id, wave_section ORDER BY idx) AS run FROM f),
r AS (SELECT record_id, wave_section, run, min(idx) AS a, max(idx) AS b, any_value(v) AS v FROM g GROUP BY ALL), t AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM r WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY run)),
q AS (SELECT record_id, wave_section, quantile_cont(v, 0.35) AS low, 0.4 * (quantile_cont(v, 0.95) - quantile_cont(v, 0.05)) AS least FROM sec GROUP BY ALL),
p AS (SELECT t.record_id, t.wave_section, (a + b) // 2 AS r_idx, v, least FROM t JOIN q USING (record_id, wave_section) WHERE v > before AND v > after AND v >= low),
n AS (SELECT p.*, s.idx, s.v AS x FROM p JOIN sec s ON s.record_id = p.record_id AND s.wave_section = p.wave_section AND s.idx BETWEEN r_idx - 15 AND r_idx + 15),
e AS (SELECT record_id, wave_section, r_idx, coalesce(max(idx) FILTER (WHERE idx < r_idx AND x > v), -1) AS l, coalesce(min(idx) FILTER (WHERE idx > r_idx AND x > v), 9e18::BIGINT) AS h FROM n GROUP BY ALL),
m AS (SELECT n.record_id, n.wave_section, r_idx, v, least, v - greatest(min(x) FILTER (WHERE idx <= r_idx AND idx > l), min(x) FILTER (WHERE idx >= r_idx AND idx < h)) AS prominence FROM n JOIN e USING (record_id, wave_section, r_idx) GROUP BY n.record_id, n.wave_section, r_idx, v, least)
SELECT record_id, wave_section, r_idx, round(v, 6) AS height, round(prominence, 6) AS prominence FROM m WHERE prominence >= least""")
def q_find_peaks(spark, sf):
    return wf.find_peaks(arrays(spark, sf), FS, "systolic").select(*K, "r_idx", r6("height"), r6("prominence"))


_DFT = "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings), m AS (SELECT vec_id, n, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS x FROM e), f AS (SELECT vec_id, k, pow(sum(x * cos(2 * pi() * k * n / 64)), 2) + pow(sum(x * sin(2 * pi() * k * n / 64)), 2) AS p FROM m, range(33) AS r(k) GROUP BY ALL), w AS (SELECT vec_id, k, p * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM f), q AS (SELECT *, p / sum(p) OVER (PARTITION BY vec_id) AS s FROM w) "


@query("dft_band_ratio", _DFT + "SELECT 'v' || vec_id AS record_id, round(sum(s) FILTER (WHERE k BETWEEN 1 AND 30), 5) AS in_band FROM q GROUP BY ALL")
def q_band_ratio(spark, sf):
    return wf.spectra(vectors(spark, sf), 32.0).select("record_id", F.round("in_band", 5).alias("in_band"))


@query("spectral_entropy_norm", _DFT + "SELECT 'v' || vec_id AS record_id, round(-sum(CASE WHEN s > 0 THEN s * log2(s) END) / log2(33), 5) AS entropy_share FROM q GROUP BY ALL")
def q_entropy_norm(spark, sf):
    return wf.spectra(vectors(spark, sf), 32.0).select("record_id", F.round("entropy_share", 5).alias("entropy_share"))


@query("pre_sqi_spectra", f"""WITH {PSD}{LIN}, h AS (SELECT *, v - lag(v) OVER w AS d FROM sec WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY idx)), hh AS (SELECT *, d - lag(d) OVER w AS dd FROM h WINDOW w AS (PARTITION BY record_id, wave_section ORDER BY idx)), hj AS (SELECT record_id, wave_section, sqrt(var_pop(dd) / var_pop(d)) / sqrt(var_pop(d) / var_pop(v)) AS hjorth FROM hh GROUP BY ALL),
a AS (SELECT record_id, wave_section, sum(p) FILTER (WHERE k >= 1) / sum(p) AS in_band, any_value(t) AS t FROM psd JOIN (SELECT record_id, wave_section, sum(p) AS t FROM psd GROUP BY ALL) USING (record_id, wave_section) GROUP BY ALL),
b AS (SELECT psd.record_id, psd.wave_section, -sum(p / t * log2(p / t)) / log2(11) AS share FROM psd JOIN a USING (record_id, wave_section) WHERE p > 0 GROUP BY 1, 2),
c AS (SELECT record_id, wave_section, sum(p) FILTER (WHERE k = 10) / sum(p) FILTER (WHERE k >= 2) AS ratio, sum(p) AS t FROM lin GROUP BY ALL), d AS (SELECT lin.record_id, lin.wave_section, -sum(p / t * log2(p / t)) AS entropy FROM lin JOIN c USING (record_id, wave_section) WHERE p > 0 GROUP BY 1, 2)
SELECT record_id, wave_section, round(ratio, 6) AS ratio, round(entropy, 6) AS entropy, round(in_band, 6) AS in_band, round(share, 6) AS entropy_share, 0.0::DOUBLE AS slow, round(hjorth, 6) AS hjorth FROM a JOIN b USING (record_id, wave_section) JOIN c USING (record_id, wave_section) JOIN d USING (record_id, wave_section) JOIN hj USING (record_id, wave_section)""")
def q_spectra(spark, sf):
    return wf.spectra(arrays(spark, sf), FS).select(*K, *map(r6, ("ratio", "entropy", "in_band", "entropy_share", "slow", "hjorth")))


@query("top4_harmonics")
def q_harmonics(spark, sf):
    return wf.strongest_harmonics(arrays(spark, sf), FS).select(*K, "place", r6("f"), r6("p"))


@query("cwt_phase")
def q_phase(spark, sf):
    return wf.phase_variance(arrays(spark, sf), FS).select(*K, r6("variance"))


@query("phase_stream")
def q_phase_stream(spark, sf):
    return wf.phase_stream(arrays(spark, sf), FS).select(*K, "r_idx", r6("variance"))


@query("wasserstein_shift", f"WITH {PSD}, s AS (SELECT record_id, wave_section, p, row_number() OVER (PARTITION BY record_id, wave_section ORDER BY p) AS r FROM psd), d AS (SELECT a.record_id, a.wave_section, coalesce(avg(abs(a.p - b.p)), 0) AS distance FROM s a LEFT JOIN s b ON b.record_id = a.record_id AND b.wave_section = a.wave_section - 1 AND b.r = a.r GROUP BY ALL) SELECT record_id, wave_section, round(distance, 6) AS distance, (distance <= 0.001)::INT AS valid FROM d")
def q_shift(spark, sf):
    return wf.shift_of_spectra(arrays(spark, sf), FS).select(*K, r6("distance"), "valid")


@query("history_fold")
def q_fold(spark, sf):
    folded = ecg_folded(spark, sf)[2]
    return folded.select(*K, "start", "valid", "stale", "reason", F.size("r_idx").alias("peaks"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("valid_peaks"), F.size("fresh").alias("fresh"), r6("kurtosis"), r6("hjorth"), r6("spectral"), r6("spec_entropy"), r6("wdist"), r6("bad_b_rat"))


@query("pqrst")
def q_pqrst(spark, sf):
    return wf.extract_beats(*ecg_folded(spark, sf), ECG_FS).withColumn("isoelectric", F.round("isoelectric", 5))


@query("r_peaks", f"""WITH RECURSIVE {ECG_SQL}, q AS (SELECT record_id, wave_section, quantile_cont(v, 0.94) AS low, quantile_cont(v, 0.99) AS least FROM es GROUP BY ALL),
ranked AS (SELECT record_id, wave_section, p, v, least, row_number() OVER (PARTITION BY record_id, wave_section ORDER BY v DESC, p DESC) AS k FROM tops JOIN q USING (record_id, wave_section) WHERE v >= low),
walk AS (SELECT DISTINCT record_id, wave_section, 0::BIGINT AS k, []::BIGINT[] AS kept FROM ranked UNION ALL SELECT r.record_id, r.wave_section, r.k, CASE WHEN len(list_filter(w.kept, lambda x: abs(x - r.p) < 50)) > 0 THEN w.kept ELSE list_append(w.kept, r.p) END FROM walk w JOIN ranked r ON r.record_id = w.record_id AND r.wave_section = w.wave_section AND r.k = w.k + 1),
kept AS (SELECT record_id, wave_section, unnest(arg_max(kept, k)) AS p FROM walk GROUP BY record_id, wave_section), k AS (SELECT * FROM kept JOIN ranked USING (record_id, wave_section, p)),
near AS (SELECT k.*, s.idx, s.v AS x FROM k JOIN es s ON s.record_id = k.record_id AND s.wave_section = k.wave_section),
ends AS (SELECT record_id, wave_section, p, coalesce(max(idx) FILTER (WHERE idx < p AND x > v), -1) AS l, coalesce(min(idx) FILTER (WHERE idx > p AND x > v), 9e18::BIGINT) AS h FROM near GROUP BY record_id, wave_section, p),
prom AS (SELECT near.record_id, near.wave_section, p, v, least, v - greatest(min(x) FILTER (WHERE idx <= p AND idx > l), min(x) FILTER (WHERE idx >= p AND idx < h)) AS prominence FROM near JOIN ends USING (record_id, wave_section, p) GROUP BY near.record_id, near.wave_section, p, v, least)
SELECT record_id, wave_section, p AS r_idx, round(v, 6) AS height, round(prominence, 6) AS prominence FROM prom WHERE prominence >= least""")
def q_r_peaks(spark, sf):
    return wf.find_peaks(ecg_sections(spark, sf)[0], ECG_FS, "r").select(*K, "r_idx", r6("height"), r6("prominence"))


@query("ecg_section_stats")
def q_ecg_stats(spark, sf):
    """Heart rate of the accepted sections from neighbouring valid peaks, and means of their beats' intervals."""
    waves, meds, folded = ecg_folded(spark, sf)
    peaks = folded.where("valid = 1").select(*K, F.posexplode("r_idx").alias("i", "r_idx"), "mask").select(*K, "r_idx", F.col("mask")[F.col("i")].alias("valid"))
    rates = st.hrv(st.adjacent_rr(peaks, ECG_FS, *K), *K).select(*K, "HR", "SDNN", "RMSSD")
    return rates.join(st.interval_means(wf.extract_beats(waves, meds, folded, ECG_FS), *K), list(K), "left")


def pressure(spark, sf) -> DataFrame:
    """Sections of 30 s of pressure (mmHg), coronary and carotid flow that the events stand for, on the clock of the ECG; from 100 s to 165 s of
    the cycle the pressure is noise."""
    e = measured(spark, sf).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(PER_EVENT - 1))))
    rows = e.select("record_id", (F.col("idx") * PER_EVENT + F.col("_j")).alias("idx"), "v", (F.col("n") * PER_EVENT).alias("n"))
    t, i = F.col("idx") / ECG_FS, F.col("idx")
    place, phase = F.pmod(t + _offset(), F.lit(CYCLE)), F.pmod(t, F.lit(BEAT_S))
    rise = F.when(phase < 0.12, F.pow(F.sin(math.pi / 2 * phase / 0.12), F.lit(2.0))).otherwise(F.exp(-(phase - 0.12) * 3))
    bump = lambda at, width: F.exp(-F.pow((phase - at) / width, F.lit(2.0)))
    noise = F.sin(0.37 * (i * (i % 1009) % 8191))
    wave = F.when((place >= 100) & (place < 165), 80 + 20 * noise).otherwise(75 + (40 + 0.02 * F.col("v")) * rise + 5 * bump(0.4, 0.04) + 1.5 * F.sin(2 * math.pi * 0.1 * t) + 0.05 * noise)
    lad, carotid = 0.4 + 0.6 * bump(0.5, 0.1) - 0.2 * bump(0.1, 0.05), 0.5 + 4 * rise - 0.7 * bump(0.36, 0.03)
    both = fr.section_join(rows.select("record_id", "idx", "n", F.round(wave, 6).alias("p"), F.round(lad, 6).alias("l"), F.round(carotid, 6).alias("c")), ECG_FS, 30.0, OVERLAP)
    found = both.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("idx", "p", "l", "c"))).alias("r"))
    part = lambda c: F.transform("r", lambda x: x[c])
    return found.select(*K, F.col("r")[0]["idx"].alias("start"), part("p").alias("wave"), part("l").alias("lad"), part("c").alias("carotid"))


@query("hemo_features")
def q_hemo(spark, sf):
    table = wf.pressure_table(pressure(spark, sf), ECG_FS)
    return table.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes])


@query("hemo_beats")
def q_hemo_beats(spark, sf):
    beats = wf.pressure_beats(pressure(spark, sf), ECG_FS)
    return beats.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in beats.dtypes])


@query("ecg_discords")
def q_ecg_discords(spark, sf):
    waves, _, folded = ecg_folded(spark, sf)
    return wf.section_discords(waves, folded.where("valid = 1").select(*K, "r_idx"), ECG_FS).select(*K, "m", "hr", r6("rmssd"), "at", F.round("score", 5).alias("score"))


@query("stft_shares", f"WITH {PSD}, x AS (SELECT record_id, wave_section, w, j, v * (0.5 - 0.5 * cos(2 * pi() * j / 20)) AS x FROM seg), m AS (SELECT record_id, wave_section, w, k, sqrt(pow(sum(x * cos(2 * pi() * k * j / 20)), 2) + pow(sum(x * sin(2 * pi() * k * j / 20)), 2)) AS m FROM x, range(11) AS r(k) GROUP BY record_id, wave_section, w, k), t AS (SELECT record_id, wave_section, k, sum(m) AS m FROM m GROUP BY record_id, wave_section, k) SELECT record_id, wave_section, k::INT AS k, round(m / sum(m) OVER (PARTITION BY record_id, wave_section), 6) AS share FROM t")
def q_stft(spark, sf):
    return wf.stft_shares(arrays(spark, sf), 20).select(*K, "k", r6("share"))


@query("phase_steps")
def q_phase_steps(spark, sf):
    waves = ecg_sections(spark, sf)[0]
    ends = waves.select(*K, (F.col("start") + F.size("wave")).alias("end_point"))
    return wf.step_filled(wf.phase_stream(waves, ECG_FS), ends).select(*K, "from_idx", "until", F.round("variance", 5).alias("variance"))


@query("welch", _DFT + "SELECT 'v' || vec_id AS record_id, k::INT AS k, (k * 0.5)::DOUBLE AS f, round(p / (32 * 24.0), 8) + 0.0 AS p FROM w")
def q_welch(spark, sf):
    return wf.power_density(vectors(spark, sf), 32.0).select("record_id", "k", "f", (F.round("p", 8) + 0.0).alias("p"))


@query("post_sqi")
def q_post_sqi(spark, sf):
    waves = ecg_sections(spark, sf)[0]
    peaks = wf.find_peaks(waves, ECG_FS, "r").groupBy(*K).agg(F.array_sort(F.collect_list("r_idx")).alias("r_idx"))
    return wf.beat_gates(waves, peaks, ECG_FS).select(*K, "valid", r6("bad_ratio"), "mp", "hjh", "stft", "noisy")


@query("average_beats", f"WITH {PEAKS} SELECT p.record_id, p.wave_section, s.idx - p.r_idx AS off, round(avg(s.v), 6) + 0.0 AS v FROM peaks p JOIN sec s ON s.record_id = p.record_id AND s.wave_section = p.wave_section AND s.idx BETWEEN p.r_idx - 3 AND p.r_idx + 5 GROUP BY ALL")
def q_average_beats(spark, sf):
    a = wf.average_beats(sectioned(spark, sf), peaks(spark, sf), 3, 5)
    return a.select(*K, F.posexplode("wave").alias("i", "v"), "start").select(*K, (F.col("i") + F.col("start")).alias("off"), r6("v"))


@query("template_beat")
def q_template(spark, sf):
    return wf.templates(wf.average_beats(sectioned(spark, sf), peaks(spark, sf), 20, 40), 60.0)


@query("top_frequencies", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings), f AS (SELECT vec_id, k, sqrt(pow(sum(x * cos(2 * pi() * k * n / 64)), 2) + pow(sum(x * sin(2 * pi() * k * n / 64)), 2)) AS p FROM e, range(1, 33) AS r(k) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS place FROM f) SELECT 'v' || vec_id AS record_id, place::INT AS place, (k * 0.5)::DOUBLE AS f, round(p, 4) AS p FROM t WHERE place <= 10")
def q_top_frequencies(spark, sf):
    return wf.top_frequencies(vectors(spark, sf), 32.0).select("record_id", "place", "f", F.round("p", 4).alias("p"))


@query("pick_lead", f"WITH {PSD}, i AS (SELECT record_id, wave_section, sum(p) FILTER (WHERE k >= 1) / sum(p) AS in_band FROM psd GROUP BY ALL), q AS (SELECT record_id AS channel, avg(in_band) AS in_band FROM i GROUP BY ALL), r AS (SELECT channel, in_band, (greatest(length(channel), 4) - levenshtein(lower(channel), 'view')) / greatest(length(channel), 4)::DOUBLE AS ratio FROM q), t AS (SELECT * FROM r ORDER BY ratio DESC, channel LIMIT 4) SELECT channel, round(ratio, 6) AS ratio, round(in_band, 6) AS in_band, row_number() OVER (ORDER BY in_band DESC, channel)::INT AS place FROM t")
def q_pick_lead(spark, sf):
    names = arrays(spark, sf).select(F.col("record_id").alias("name")).distinct()
    return wf.pick_lead(arrays(spark, sf), names, "view", FS).select("channel", r6("ratio"), r6("in_band"), "place")
