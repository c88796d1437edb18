"""Waveform operators: sections as rows with an array, kernels over them in Arrow batches, the ordered fold by recording.

A section's row holds its own samples only, so tasks stay small whatever a recording's length; what must go in
order (the quality fold) gets one compact row a section.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from pulseloom.functions import beats as be
from pulseloom.functions import kernels as kn
from pulseloom.functions import quality as qu
from pulseloom.operators import framing as fr

KEYS = "record_id string, wave_section int"


def section_arrays(samples: DataFrame, column: str = "v") -> DataFrame:
    """(record_id, wave_section, start, wave ARRAY) of rows (record_id, wave_section, idx, v)."""
    rows = F.array_sort(F.collect_list(F.struct("idx", column)))
    return samples.groupBy(*fr.KEYS).agg(rows.alias("_r")).select(*fr.KEYS, F.col("_r")[0]["idx"].alias("start"), F.transform("_r", lambda x: x[column].cast("double")).alias("wave"))


#: Rows of whole sections that go to a Python worker at once.
BATCH_ROWS = 200


def small_batches(spark) -> None:
    """Sections are large rows: bound the Arrow batches, of which a worker holds one at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by ``keys`` in as many tasks as a shuffle has: work that is long for its bytes is not to be put together into few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def per_section(sections: DataFrame, kernel, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """kernel(wave, start, *extra) -> list of rows (tuples) for each section; rows get the section's keys in front."""
    full = f"{KEYS}, {schema}"
    shape = to_arrow_schema(_parse_datatype_string(full))

    def run(batches):
        for batch in batches:
            waves, starts = batch.column(3), batch.column(2).to_pylist()
            others = [batch.column(4 + i).to_pylist() for i in range(len(extra))]
            out, times = [], []
            for i, start in enumerate(starts):
                got = kernel(waves[i].values.to_numpy(zero_copy_only=False).astype(float), start, *(o[i] for o in others))
                out += got
                times.append(len(got))
            at = pa.array(np.repeat(np.arange(len(starts)), times))
            columns = list(zip(*out)) if out else [()] * (len(shape) - 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t.type, from_pandas=True) for c, t in zip(columns, list(shape)[2:]))], schema=shape)

    small_batches(sections.sparkSession)
    return sections.select("record_id", "wave_section", "start", "wave", *extra).mapInArrow(run, full)


def per_sample(sections: DataFrame, kernel, name: str = "y") -> DataFrame:
    """(keys, idx, ``name``): kernel(wave) -> an array as long as the wave. Arrays come back whole and are taken apart in the JVM."""

    def run(batches):
        for batch in batches:
            values = [kernel(w.values.to_numpy(zero_copy_only=False).astype(float)) for w in batch.column(3)]
            ends = np.cumsum([0, *map(len, values)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0), *values])))], ["record_id", "wave_section", "start", name])

    small_batches(sections.sparkSession)
    whole = sections.select("record_id", "wave_section", "start", "wave").mapInArrow(run, f"{KEYS}, start long, {name} array<double>")
    return whole.select(*fr.KEYS, "start", F.posexplode(name).alias("_i", name)).select(*fr.KEYS, (F.col("start") + F.col("_i")).alias("idx"), name)


def frame_medians(v: np.ndarray, size: int = 41) -> np.ndarray:
    """The median of the centred frame of each sample, NaN where the frame is not whole."""
    out, half = np.full(len(v), np.nan), size // 2
    if len(v) >= size:
        out[half : len(v) - half] = np.median(np.lib.stride_tricks.sliding_window_view(v, size), axis=1)
    return out


def rolling_medians(samples: DataFrame, size: int = 41, block: int = fr.BLOCK) -> DataFrame:
    """(record_id, idx, v, n, rolling_med): framing.rolling_median for dense signals without gaps, by a kernel over each block of a recording.
    Recordings shorter than a frame have none."""

    def median(rows: pa.Table) -> pa.Table:
        idx, at, n = rows.column("idx").to_numpy(), rows.column("_at")[0].as_py(), rows.column("n")[0].as_py()
        order = np.argsort(idx)
        idx, v, half = idx[order], rows.column("v").to_numpy()[order].astype(float), size // 2
        out = frame_medians(v, size)
        if len(v) >= size:
            if idx[0] == 0:
                out[:half] = out[half]
            if idx[-1] == n - 1:
                out[len(v) - half - 1 :] = np.median(v[len(v) - size : len(v) - 1])
        own = idx // block == at
        many = int(own.sum())
        return pa.table([pa.array([rows.column("record_id")[0].as_py()] * many, pa.string()), pa.array(idx[own]), pa.array(v[own]), pa.array([n] * many, pa.int64()), pa.array(out[own], from_pandas=True)], ["record_id", "idx", "v", "n", "rolling_med"])

    spread = fr.in_blocks(samples, size, block).select("record_id", "idx", "v", "n", "_at")
    return spread.groupBy("record_id", "_at").applyInArrow(median, "record_id string, idx long, v double, n long, rolling_med double")


def find_peaks(sections: DataFrame, fs: float, kind: str = "r") -> DataFrame:
    """(keys, r_idx, height, prominence). Kinds: r (ECG), systolic (pressure), discord (ECG, looser), phase."""

    def kernel(x, start):
        pick = lambda q: float(np.percentile(x, q))
        rule = {
            "r": lambda: {"height": pick(94), "prominence": pick(99), "distance": int(0.2 * fs)},
            "discord": lambda: {"height": pick(90), "prominence": pick(95), "distance": int(0.3 * fs)},
            "phase": lambda: {"height": float(x.mean()), "distance": int(0.4 * fs)},
            "systolic": lambda: {"height": pick(35), "prominence": 0.4 * (pick(95) - pick(5)), "distance": int(0.2 * fs), "wlen": int(3 * fs)},
        }[kind]()
        at, height, prom = kn.find_peaks(x, **rule)
        return [(start + int(p), float(h), float(q)) for p, h, q in zip(at, height, prom)]

    return per_section(sections, kernel, "r_idx long, height double, prominence double")


def smoothed(sections: DataFrame, fs: float, how: str, **options) -> DataFrame:
    """(keys, idx, y): savgol, d1, d2, low, high, band or notch of each section."""

    def kernel(x):
        if how == "savgol":
            return kn.smooth(x, **options)
        return kn.derivative(x, fs, int(how[1])) if how in ("d1", "d2") else kn.filtered(x, fs, how, options.get("cut"))

    return per_sample(sections, kernel)


def spectra(sections: DataFrame, fs: float) -> DataFrame:
    """(keys, ratio, entropy, in_band, entropy_share, slow, kurtosis, hjorth): spectral measures of each section."""

    def kernel(x, start):
        g = kn.spectral_gate(x, fs)
        share, norm = kn.signal_quality(x, fs)
        return [(g["ratio"], g["entropy"], share, float(norm), kn.slow_power(x, fs), kn.hjorth(x))]

    return per_section(sections, kernel, "ratio double, entropy double, in_band double, entropy_share double, slow double, hjorth double")


def power_density(sections: DataFrame, fs: float, seconds: float = 2.0, detrend: str = "constant") -> DataFrame:
    """(keys, k, f, p): Welch's estimate over windows of ``seconds``."""

    def kernel(x, start):
        f, p = kn.welch(x, fs, min(len(x), int(seconds * fs)), detrend)
        return [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(f, p))]

    return per_section(sections, kernel, "k int, f double, p double")


def beat_gates(sections: DataFrame, peaks: DataFrame, fs: float) -> DataFrame:
    """(keys, valid, bad_ratio, mp, hjh, stft, noisy): second-stage gates of each section without history. peaks: (keys, r_idx ARRAY)."""

    def kernel(x, start, at):
        at = [p - start for p in at]
        ok, _, reasons, bad = qu.beat_gate(qu.start(), qu.beats_of(x, at, fs), 0, len(at))
        count = lambda r: sum(v == r for v in reasons)
        return [(int(ok), float(bad), count("MP"), count("HJH"), count("STFT"), sum(qu.noisy_beats(x, at, fs)[0]))]

    return per_section(sections.join(peaks.select(*fr.KEYS, "r_idx"), list(fr.KEYS)), kernel, "valid int, bad_ratio double, mp int, hjh int, stft int, noisy int", ("r_idx",))


def templates(sections: DataFrame, fs: float) -> DataFrame:
    """(keys, fiducials and intervals) of sections that hold one averaged beat each."""
    fields = (*be.ECG_FIELDS, *be.INTERVALS)
    return per_section(sections, lambda x, start: [[b[k] for k in fields]] if len(x) > 10 and (b := be.template(x, fs)) else [], ", ".join(f"{k} long" for k in fields))


def average_beats(samples: DataFrame, peaks: DataFrame, before: int, after: int) -> DataFrame:
    """(record_id, wave_section, start, wave): beats of a section laid over each other at R and averaged. Meets samples by section, not by range."""
    both = samples.join(peaks.select(*fr.KEYS, "r_idx"), list(fr.KEYS)).withColumn("off", F.col("idx") - F.col("r_idx")).where(F.col("off").between(-before, after))
    mean = both.groupBy(*fr.KEYS, "off").agg(F.avg("v").alias("v"))
    return section_arrays(mean.withColumnRenamed("off", "idx"))


def strongest_harmonics(sections: DataFrame, fs: float, most: int = 4) -> DataFrame:
    """(keys, place, f, p): the strongest peaks of the mean spectrum of single beats (systolic peaks)."""

    def kernel(x, start):
        at, _, _ = kn.find_peaks(x, height=np.percentile(x, 35), prominence=0.4 * (np.percentile(x, 95) - np.percentile(x, 5)), distance=int(0.2 * fs), wlen=int(3 * fs))
        return [(i + 1, f, p) for i, (f, p) in enumerate(kn.harmonics(x, at.tolist(), fs, most))]

    return per_section(sections, kernel, "place int, f double, p double")


def phase_variance(sections: DataFrame, fs: float, frequency: float = 2.0, kind: str = "morlet") -> DataFrame:
    """(keys, variance): spread over beats of the mean phase from 200 ms before to 400 ms after each peak."""

    def kernel(x, start):
        angle = kn.phase(x, fs, frequency, kind)
        at, _, _ = kn.find_peaks(x, height=float(x.mean()), distance=int(0.4 * fs))
        means = [np.angle(np.exp(1j * angle[p - int(0.2 * fs) : p + int(0.4 * fs)]).mean()) for p in at if p >= int(0.2 * fs) and p + int(0.4 * fs) <= len(x)]
        return [(kn.phase_variance(means) if means else None,)]

    return per_section(sections, kernel, "variance double")


def phase_stream(sections: DataFrame, fs: float, frequency: float = 20.0) -> DataFrame:
    """(keys, r_idx, variance): of ten beats around each one, spread of phase averaged over the middle of the beat; three beats at least, ten in all."""

    def kernel(x, start):
        angle = kn.phase(x, fs, min(frequency, fs / 4), "morlet")
        at, _, _ = kn.find_peaks(x, height=float(x.mean()), distance=int(0.4 * fs))
        half = 50 if fs >= 250 else max(1, int(0.2 * fs))
        at = at[(at >= half) & (at + half < len(x))]
        if len(at) < 10:
            return []
        turns = np.exp(1j * np.array([angle[p - half : p + half] for p in at]))
        return [(start + int(p), float((1 - np.abs(w.mean(0))).mean())) for i, p in enumerate(at) if len(w := turns[max(0, i - 5) : i + 5]) >= 3]

    return per_section(sections, kernel, "r_idx long, variance double")


def shift_of_spectra(sections: DataFrame, fs: float, limit: float = 0.001) -> DataFrame:
    """(keys, distance, valid): distance of each section's power values from those of the section before; the first has 0."""

    def kernel(x, start):
        return [(kn.welch(x, fs, min(len(x), int(2 * fs)))[1].tolist(),)]

    powers = per_section(sections, kernel, "power array<double>")
    before = powers.select("record_id", (F.col("wave_section") + 1).alias("wave_section"), F.col("power").alias("earlier"))
    both = powers.join(before, list(fr.KEYS), "left")

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0.0 if y is None else kn.sample_mover(x, y) for x, y in zip(a, b)])

    return both.select(*fr.KEYS, distance("power", "earlier").alias("distance")).withColumn("valid", (F.col("distance") <= limit).cast("int"))


# ---------------------------------------------------------------- ECG engine


QUALITY = f"{KEYS}, start long, wave array<double>, med array<double>, kurtosis double, hjorth double, ratio double, entropy double, f array<double>, band array<double>, peaks array<int>, prominence double, faults array<int>, of array<int>, far array<array<double>>, profile_med array<double>, profile_mad array<double>"
_MEASURES = ("kurtosis", "hjorth", "ratio", "entropy", "f", "band", "peaks", "prominence")


def with_medians(sections: DataFrame, medians: DataFrame) -> DataFrame:
    """Sections with the waves of ``medians`` as ``med``, unless they have that column."""
    return sections if "med" in sections.columns else sections.join(medians.select(*fr.KEYS, F.col("wave").alias("med")), list(fr.KEYS))


def quality_rows(sections: DataFrame, medians: DataFrame, fs: float) -> DataFrame:
    """What each section brings to the fold, worked out side by side: measures, peaks, its beats' profile distances and faults, and its
    samples. medians: sections of the rolling median (not read where sections have ``med``). The profile is only taken of turbulent sections that no measure of their own
    rejects; the fold takes that of the few others that follow a long silence."""
    both = with_medians(sections, medians)

    def kernel(x, start, med):
        own = qu.features(x, med, fs)
        early = sum(p < len(x) // 2 for p in own["peaks"])
        beats = qu.beats_of(x, own["peaks"], fs, early + 1) if own["hjorth"] > 2 and not qu.first_gate(own, True) and len(own["peaks"]) <= 100 else None
        return [(start, x, med, *(own[k] for k in _MEASURES), *((beats[k] for k in ("faults", "of", "far", "med", "mad")) if beats else (None,) * 5))]

    return per_section(both, kernel, QUALITY[len(KEYS) + 2 :], ("med",))


FOLDED = f"{KEYS}, start long, valid int, stale boolean, reason string, r_idx array<long>, mask array<int>, fresh array<long>, prominence double, kurtosis double, hjorth double, spectral double, spec_entropy double, wdist double, bad_b_rat double"


def folded_step(state: dict, row: dict, fs: float) -> tuple[dict, tuple]:
    """One row of quality_rows through the gates: the new state and the row of FOLDED."""
    plain = lambda v: v.tolist() if isinstance(v, np.ndarray) and v.dtype != object else list(map(plain, v)) if isinstance(v, np.ndarray) else v
    own = {k: plain(row[k]) for k in _MEASURES}
    beats = None if row["far"] is None else {k: plain(row[c]) for k, c in (("faults", "faults"), ("of", "of"), ("far", "far"), ("med", "profile_med"), ("mad", "profile_mad"))}
    state, out = qu.step(state, {"start": row["start"], "wave": row["wave"], "med": row["med"], "features": own, "beats": beats}, fs)
    return state, (row["record_id"], row["wave_section"], row["start"], out["valid"], out["stale"], " | ".join(out["reasons"]), [row["start"] + p for p in out["peaks"]], out["mask"], out["new"], own["prominence"], own["kurtosis"], own["hjorth"], own["ratio"], own["entropy"], out["wdist"], out["bad_ratio"])


def history_fold(rows: DataFrame, fs: float) -> DataFrame:
    """The gates of all sections in order, recording by recording: valid, reason, peaks with mask and those not stored before.

    Sections come sorted and in small batches; a task holds one batch and the state of the recording that it is in.
    """
    shape = to_arrow_schema(_parse_datatype_string(FOLDED))

    def run(batches):
        record, state = None, qu.start()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["record_id"] != record or record is None:
                    record, state = row["record_id"], qu.start()
                state, got = folded_step(state, row, fs)
                out.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), shape)] if out else [pa.array([], t.type) for t in shape], schema=shape)

    small_batches(rows.sparkSession)
    return dealt(rows, "record_id").sortWithinPartitions("record_id", "wave_section").mapInArrow(run, FOLDED)


BEAT = ", ".join(f"{k} long" for k in be.ECG_FIELDS) + ", " + ", ".join(f"{k} int" for k in be.INTERVALS) + ", valid_qrs boolean, isoelectric double"


def extract_beats(sections: DataFrame, medians: DataFrame, folded: DataFrame, fs: float) -> DataFrame:
    """Beats of the valid sections with fiducials (sample numbers of the recording) and intervals in ms; nulls where not found.

    A section's last peak has its P and Q there and opens the next section, where its S and T are: P and Q are handed on to it.
    """
    # the waves are never sent to all tasks, however small their plan believes them: both sides of the joins are shuffled once and used again
    both = with_medians(sections, medians).hint("merge").join(folded.where("valid = 1").select(*fr.KEYS, "r_idx", "prominence"), list(fr.KEYS))

    def last(x, start, med, peaks, prominence):
        if len(peaks) < 2:
            return []
        beat = be.pqrst(x, med, [p - start for p in peaks[-2:]], fs, prominence)[0][1]
        return [(peaks[-1], None if beat["p_peak"] is None else start + beat["p_peak"], None if beat["q_peak"] is None else start + beat["q_peak"])]

    tails = per_section(both, last, "last_r long, last_p long, last_q long", ("med", "r_idx", "prominence"))
    handed = both.join(tails.withColumn("wave_section", F.col("wave_section") + 1), list(fr.KEYS), "left")

    def kernel(x, start, med, peaks, prominence, r, p, q):
        known = r is not None and len(peaks) > 0 and r == peaks[0]
        carried = {k: v - start for k, v in (("p_peak", p), ("q_peak", q)) if known and v is not None and v >= start}
        found, level = be.pqrst(x, med, [i - start for i in peaks], fs, prominence, carried)
        return [[None if b[k] is None else start + b[k] for k in be.ECG_FIELDS] + [b[k] for k in be.INTERVALS] + [b["valid_qrs"], level] for b in found]

    return per_section(handed, kernel, BEAT, ("med", "r_idx", "prominence", "last_r", "last_p", "last_q"))


# ---------------------------------------------------------------- pressure

HEMO = ", ".join(f"{k} long" if k in ("onset", "sbp_id", "dbp_id", "notch_id") else f"{k} double" for k in be.HEMO_FIELDS)


def _systolic(x, fs: float) -> np.ndarray:
    return kn.find_peaks(x, height=np.percentile(x, 35), prominence=0.4 * (np.percentile(x, 95) - np.percentile(x, 5)), distance=int(0.2 * fs), wlen=int(3 * fs))[0]


def pressure_beats(sections: DataFrame, fs: float) -> DataFrame:
    """Features of each pressure beat of sections (wave: pressure, lad, carotid); notch_id counts from the systolic peak."""

    def kernel(x, start, lad, carotid):
        at = _systolic(x, fs)
        if not 3 <= len(at) <= 60:
            return []
        rows = [be.pressure_beat(x, lad, carotid, at, i, fs) for i in range(len(at) - 1)]
        return [[start + r[k] if k in ("onset", "sbp_id", "dbp_id") else r[k] for k in be.HEMO_FIELDS] for r in rows if r]

    return per_section(sections, kernel, HEMO, ("lad", "carotid"))


#: Least share of power in the band and greatest entropy of a pressure section.
PRESSURE_BAND, PRESSURE_ENTROPY = 0.90, 0.45


def pressure_table(sections: DataFrame, fs: float) -> DataFrame:
    """One row for each section of (wave: pressure, lad, carotid): signal quality, whether it is invalid, slow power, heart rate, spread of the
    beats' phase by two wavelets, and the means of all beat features. Only sections that pass the quality gate are measured further, and
    of those only such with 3 to 60 systolic peaks."""
    measures = spectra(sections, fs).select(*fr.KEYS, F.col("in_band").alias("sqi_power"), F.col("entropy_share").alias("sqi_entropy"), F.col("slow").alias("mayer_pow"))
    gated = measures.withColumn("invalid", ((F.col("sqi_power") < PRESSURE_BAND) | (F.col("sqi_entropy") > PRESSURE_ENTROPY)).cast("int"))
    good = sections.join(gated.where("invalid = 0").select(*fr.KEYS), list(fr.KEYS), "left_semi")

    def kernel(x, start):
        at = _systolic(x, fs)
        if not 3 <= len(at) <= 60:
            return []
        rate = int(np.mean(np.round(60 / (np.diff(at) / fs), 2)))
        spread = []
        for kind in ("morlet", "cgau1"):
            angle = kn.phase(x, fs, 2.0, kind)
            means = [np.angle(np.exp(1j * angle[p - int(0.2 * fs) : p + int(0.4 * fs)]).mean()) for p in at[:-1] if p >= int(0.2 * fs) and p + int(0.4 * fs) <= len(x)]
            spread.append(kn.phase_variance(means) if means else None)
        return [(rate, *spread)]

    rates = per_section(good, kernel, "HR int, var_mor double, var_cgau double")
    return gated.join(rates, list(fr.KEYS), "left").join(pressure_sections(pressure_beats(good, fs)), list(fr.KEYS), "left")


def pressure_sections(beats: DataFrame) -> DataFrame:
    """Means of the beats' features, nulls left out."""
    return beats.groupBy(*fr.KEYS).agg(F.count("*").alias("beats"), *[F.avg(k).alias(k) for k in be.HEMO_FIELDS if k not in ("onset", "sbp_id", "dbp_id", "notch_id")])


# ---------------------------------------------------------------- matrix profiles


def profiles(sections: DataFrame, m: int, strict: bool = False) -> DataFrame:
    """(keys, i, distance, nn): the matrix profile of each section; strict: of flat windows as SQL has it."""

    def kernel(x, start):
        d, near = kn.matrix_profile(x, m, strict)
        return [(i, float(v), int(k)) for i, (v, k) in enumerate(zip(d, near)) if k >= 0 or strict]

    found = per_section(sections, kernel, "i int, distance double, nn int")
    return found.withColumn("distance", F.coalesce("distance", F.lit(float("nan")))) if strict else found


def section_discords(sections: DataFrame, peaks: DataFrame, fs: float) -> DataFrame:
    """(keys, m, hr, rmssd, at, score): the window farthest from its nearest neighbour, windows as long as the section's mean RR. peaks: (keys, r_idx ARRAY)."""

    def kernel(x, start, at):
        gaps = np.diff(at)
        if len(gaps) < 2 or not 3 < (m := int(gaps.mean())) <= len(x) // 2:
            return []
        d, near = kn.matrix_profile(x, m)
        if not (near >= 0).any():
            return []
        k = int(np.where(near >= 0, d, -1).argmax())
        rr = 1000.0 * gaps / fs
        return [(m, int((60.0 / (gaps / fs)).mean()), float(np.sqrt((np.diff(rr) ** 2).mean())), start + k, float(d[k]))]

    return per_section(sections.join(peaks.select(*fr.KEYS, "r_idx"), list(fr.KEYS)), kernel, "m int, hr int, rmssd double, at long, score double", ("r_idx",))


def stft_shares(sections: DataFrame, size: int = 256) -> DataFrame:
    """(keys, k, share): magnitudes of Hann windows half over each other, summed over time, as shares."""
    return per_section(sections, lambda x, start: [(k, float(v)) for k, v in enumerate(kn.stft_share(x, size))], "k int, share double")


def step_filled(points: DataFrame, ends: DataFrame) -> DataFrame:
    """(keys, from_idx, until, variance): each beat's value holds from its peak until the next one's, the last until its section ends (ends: keys, end_point)."""
    w = Window.partitionBy(*fr.KEYS).orderBy("r_idx")
    return points.join(ends, list(fr.KEYS)).select(*fr.KEYS, F.col("r_idx").alias("from_idx"), F.coalesce(F.lead("r_idx").over(w), F.col("end_point")).alias("until"), "variance")


def regime_changes(sections: DataFrame, m: int, count: int) -> DataFrame:
    """(keys, place, at): positions where few neighbours lie across."""

    def kernel(x, start):
        near = kn.matrix_profile(x, m)[1]
        return [(i + 1, start + k) for i, k in enumerate(kn.regimes(kn.arc_curve(near, m), m, count))] if len(near) else []

    return per_section(sections, kernel, "place int, at long")


def pattern_matches(sections: DataFrame, query: list[float], deviations: float = 4.0, strict: bool = False) -> DataFrame:
    """(keys, at, distance): where a pattern recurs in each section; strict: by the rule of the queries' SQL."""

    def kernel(x, start):
        return [(start + k, d) for k, d in kn.matches(query, x, deviations, strict)] if len(x) >= len(query) else []

    return per_section(sections, kernel, "at long, distance double")


def pick_lead(sections: DataFrame, names: DataFrame, target: str, fs: float, most: int = 3) -> DataFrame:
    """(channel, ratio, in_band, place): of the channels named most like ``target`` (one more than ``most``), best signal first.

    sections: as section_arrays gives, record_id being the channel.
    """
    from pulseloom.operators.relational import rank_names

    near = rank_names(names, target, most + 1).select(F.col("name").alias("channel"), "ratio")
    quality = spectra(sections, fs).groupBy(F.col("record_id").alias("channel")).agg(F.avg("in_band").alias("in_band"))
    ranked = quality.join(F.broadcast(near), "channel").orderBy(F.desc("in_band"), "channel")
    return ranked.select("channel", "ratio", "in_band", (F.row_number().over(_whole("in_band", "channel"))).alias("place"))


def _whole(score: str, tie: str):
    return Window.orderBy(F.desc(score), tie)


def top_frequencies(sections: DataFrame, fs: float, most: int = 10) -> DataFrame:
    """(keys, place, f, p): the strongest bins of each section's spectrum, ties to the lower."""

    def kernel(x, start):
        power, f = np.abs(np.fft.rfft(x - x.mean())), np.fft.rfftfreq(len(x), 1 / fs)
        order = np.lexsort((f, -power))[:most]
        return [(i + 1, float(f[k]), float(power[k])) for i, k in enumerate(order)]

    return per_section(sections, kernel, "place int, f double, p double")
