"""Fiducial points and intervals of ECG beats within one section, and features of pressure beats. Missing values are None."""

from __future__ import annotations

import numpy as np

from pulseloom.functions import kernels as kn

ECG_FIELDS = ("r_peak", "p_peak", "q_peak", "s_peak", "t_peak", "p_onset", "q_onset", "j_point", "t_onset", "t_offset")
INTERVALS = ("PR", "QRS", "ST", "QT", "QTc", "TpTe")


def turning_points(x) -> np.ndarray:
    """Positions where the sign of the step turns upwards; the first is held against the last."""
    s = np.sign(np.diff(x))
    turn = np.roll(s, 1) - s
    return np.flatnonzero((turn == -2) | (turn == -1))


def curvature(x) -> np.ndarray:
    return np.gradient(np.gradient(x)) if len(x) > 2 else np.zeros(len(x))


def _tallest(x, floor: float) -> int | None:
    at, height, _ = kn.find_peaks(x, height=floor)
    return int(at[height.argmax()]) if len(at) else None


def _ms(a, b, fs) -> int | None:
    return None if a is None or b is None else int(1000 * (a - b) / fs)


def corrected_qt(qt, rr) -> int:
    return int(qt / (rr / 1000) ** 0.5) if qt and rr and qt > 0 and rr > 0 else 0


def s_point(x, r: int, stop: int) -> int | None:
    """The point after R farthest from the chord over the first third, on a tenfold finer spline."""
    part = x[r:stop]
    if not len(part):
        return None
    if len(part) <= 3:
        return r + int(part.argmin())
    fine = np.linspace(0, len(part) - 1, 10 * len(part))
    return r + round(int(kn.chord_distance(fine, kn.spline(np.arange(len(part)), part, fine)).argmax()) / 10)


def pqrst(x, med, r_peaks, fs: float, prominence: float, carried: dict | None = None) -> tuple[list[dict], float | None]:
    """(beats, isoelectric level) of a section: positions are relative to it. carried: P and Q of a first beat known from the section before."""
    x, med = np.asarray(x, float), np.asarray(med, float)
    beats = [dict.fromkeys(ECG_FIELDS + INTERVALS) | {"r_peak": int(r), "prev": None} for r in r_peaks]
    if beats and carried:
        beats[0] |= {k: carried.get(k) for k in ("p_peak", "q_peak")}
    for beat, after in zip(beats, beats[1:]):
        r0, r1 = beat["r_peak"], after["r_peak"]
        turns = turning_points(x[r0 : r1 + 1])
        if not len(turns) or np.std(x[r0 + turns[0] : r0 + turns[-1]] if turns[-1] > turns[0] else [0.0]) >= 0.30 * prominence:
            continue
        q = after["q_peak"] = r0 + int(turns[-1])
        third = r0 + (r1 - r0) // 3
        beat["s_peak"] = s_point(x, r0, third)
        low = r0 + int(x[r0:third].argmin()) if third > r0 else r0
        beat["low"] = low if x[low] < med[low] and low - r0 in turns[:6] else r0 + int(turns.min())
        level = x[beat["low"] : q] - med[beat["low"] : q]
        if len(level) > 2:
            floor, half = np.percentile(level, 60), len(level) // 2
            if (t := _tallest(level[:half], floor)) is not None:
                beat["t_peak"] = beat["low"] + t
            if (p := _tallest(level[half:], floor)) is not None:
                after["p_peak"] = beat["low"] + half + p
    level = isoelectric(x, beats)
    for i, beat in enumerate(beats):
        if all(beat[k] is not None for k in ECG_FIELDS[:5]):
            _onsets(x, med, beat, fs)
        start, turn = beat["q_onset"], beat["j_point"] if beat["j_point"] is not None else beat["s_peak"]
        beat |= {"PR": _ms(start, beat["p_onset"], fs), "QRS": _ms(turn, start, fs), "ST": _ms(beat["t_onset"], turn, fs), "QT": _ms(beat["t_offset"], start, fs), "TpTe": _ms(beat["t_offset"], beat["t_peak"], fs)}
        if beat["QT"] and i + 1 < len(beats):
            beat["QTc"] = corrected_qt(beat["QT"], _ms(beats[i + 1]["r_peak"], beat["r_peak"], fs))
        beat["valid_qrs"] = all(beat[k] is not None for k in ECG_FIELDS[:5])
    return beats, level


def isoelectric(x, beats) -> float | None:
    """Mean level between the end of T and the start of P (greatest curvature in either half of T to P), over beats."""
    levels = []
    for beat, after in zip(beats, beats[1:]):
        if beat["t_peak"] is None or after["p_peak"] is None or after["p_peak"] - beat["t_peak"] < 8:
            continue
        part = x[beat["t_peak"] : after["p_peak"]]
        c, half = curvature(part), len(part) // 2
        a, b = int(c[:half].argmax()), half + int(c[half:].argmax())
        if b > a:
            levels.append(part[a:b].mean())
    return round(float(np.mean(levels)), 6) if levels else None


def _onsets(x, med, beat: dict, fs: float) -> None:
    p, q, s, t = (beat[k] for k in ("p_peak", "q_peak", "s_peak", "t_peak"))
    width = max((s - q) * 2, 4) if s > q else int(0.1 * fs)
    low = max(0, p + 1 - 2 * width)
    if p + 1 - low > 3:
        beat["p_onset"] = low + int(curvature(x[low : p + 1]).argmax())
    late = p + int((q - p) * 0.3)
    if q - late > 3:
        bend = np.abs(curvature(x[late:q]))
        beat["q_onset"] = late + int(np.flatnonzero(bend >= bend.mean())[0]) + 1
    if len(x) - t > 3:
        beat["t_offset"] = t + int(curvature(x[t : t + 2 * width]).argmax())
    if t - s > 5:
        below = np.flatnonzero(x[s:t] < med[s:t])
        if len(below):
            end = below[0] + 1
            while end < t - s and x[s + end] < med[s + end]:
                end += 1
            run = x[s + below[0] : s + end]
            bend = kn.knee(run) if len(run) > 5 else None
            if bend is not None:
                beat["j_point"] = s + int(below[0]) + bend + 1
            start = beat["j_point"] if beat["j_point"] is not None else s + int(end)
            if t - start > 3:
                beat["t_onset"] = start + int(curvature(x[start:t]).argmax())


def template(x, fs: float) -> dict:
    """Measurement of one averaged beat."""
    x = np.asarray(x, float)
    at, height, prom = kn.find_peaks(x, height=np.percentile(x, 97), prominence=np.percentile(x, 99) - np.median(x), distance=0.2 * fs)
    if not len(at):
        return dict.fromkeys(ECG_FIELDS + INTERVALS)
    r = int(at[height.argmax()])
    left, right = turning_points(x[: r + 1]), turning_points(x[r:])
    out = dict.fromkeys(ECG_FIELDS + INTERVALS) | {"r_peak": r, "q_peak": int(left[-1]) if len(left) else None, "s_peak": r + int(right[1 if len(right) > 1 and right[0] == 0 else 0]) if len(right) else None}
    floor = np.percentile(x, 60)
    if out["q_peak"] and (p := _tallest(x[: out["q_peak"]], np.percentile(x, 40))) is not None:
        out["p_peak"] = p
    if out["s_peak"] is not None and (t := _tallest(x[out["s_peak"] :], floor)) is not None:
        out["t_peak"] = out["s_peak"] + t
    if all(out[k] is not None for k in ECG_FIELDS[:5]):
        _onsets(x, np.full(len(x), np.median(x)), out, fs)
        flat = np.flatnonzero(np.abs(np.diff(x[out["s_peak"] : out["t_peak"]])) <= 0.005)
        if len(flat):
            out["j_point"] = out["s_peak"] + int(flat[0])
        turn = out["j_point"] if out["j_point"] is not None else out["s_peak"]
        out |= {"PR": _ms(out["q_onset"], out["p_onset"], fs), "QRS": _ms(turn, out["q_onset"], fs), "ST": _ms(out["t_onset"], turn, fs), "QT": _ms(out["t_offset"], out["q_onset"], fs), "TpTe": _ms(out["t_offset"], out["t_peak"], fs)}
    return out


# ---------------------------------------------------------------- pressure beats

HEMO_FIELDS = (
    "onset", "sbp_id", "dbp_id", "notch_id", "SBP", "DBP", "notch", "true_MAP", "ap_MAP", "shock_gap", "dni", "sys_sl", "sys_sl_len", "dia_sl", "dia_sl_ref", "ri", "pul_wid", "p1", "p2", "p3", "p1_p2", "p1_p3", "aix",
    "lad_mean", "cvr", "dcr", "lad_pi", "lad_acc_sl", "flow_div", "lad_dia_pk", "lad_sys_pk", "lad_ds_rat", "lad_dia_net", "lad_dia_neg", "retro_flow",
)
#: Least mean flow and least pulse for which ratios are formed.
FLOW, PULSE = 0.15, 0.1


def _area(x, fs) -> float:
    return float(np.trapezoid(x, dx=1 / fs)) if len(x) > 1 else 0.0


def foot(x, peak: int, fs: float) -> int | None:
    """Where the upstroke before a peak starts: back from the steepest point to a twentieth of its slope."""
    start = max(0, peak - int(0.3 * fs))
    if peak - start <= 30:
        return None
    slope = kn.derivative(x[start:peak], fs, 1)
    top = int(slope.argmax())
    flat = np.flatnonzero(slope[: top + 1] <= 0.05 * slope[top])
    return start + (int(flat[-1]) if len(flat) else 0)


def _shoulders(x, fs) -> tuple[float, float]:
    """First and second systolic pressures: two peaks, else a shoulder before or after the main one, else that one twice."""
    tops, _, _ = kn.find_peaks(x)
    if len(tops) >= 2:
        return float(x[tops[0]]), float(x[tops[1:]].max())
    slope, main = kn.derivative(x, fs, 1), int(x.argmax())
    early, late = kn.find_peaks(-slope[:main])[0], kn.find_peaks(slope[main:])[0]
    if len(early):
        return float(x[early[-1]]), float(x[main])
    return float(x[main]), float(x[main + late[0]] if len(late) else x[main])


def _diastolic_peak(x) -> float:
    if len(x) <= 5:
        return float(x.max())
    tops, height, _ = kn.find_peaks(x)
    if len(tops):
        return float(height.max())
    bend = kn.knee(x, bool(x[0] <= x[-1]))
    return float(x.max() if bend is None else x[bend])


def pressure_beat(pressure, flow, carotid, peaks, i: int, fs: float) -> dict | None:
    """Features of beat i of the systolic peaks; None where it has no foot, or its points are out of order. Slopes are per second."""
    p, lad, car = (np.asarray(v, float) for v in (pressure, flow, carotid))
    top, after = int(peaks[i]), int(peaks[i + 1])
    onset, end = foot(p, top, fs), foot(p, after, fs)
    if onset is None or end is None or not onset < top < end:
        return None
    f = dict.fromkeys(HEMO_FIELDS) | {"onset": onset, "sbp_id": top, "dbp_id": end, "SBP": float(p[top]), "DBP": float(p[end])}
    pulse, beat, flows = f["SBP"] - f["DBP"], slice(onset, end), lad[onset:end]
    f |= {"sys_sl": (f["SBP"] - float(p[onset])) / ((top - onset) / fs), "sys_sl_len": (top - onset) / fs, "true_MAP": _area(p[beat], fs) / ((end - onset) / fs), "ap_MAP": f["DBP"] + pulse / 3}
    f["shock_gap"] = f["true_MAP"] - f["ap_MAP"]
    vessel = car[onset:after]
    if len(vessel) and vessel.max():
        f["ri"] = float((vessel.max() - vessel[-1]) / vessel.max())
    mean = f["lad_mean"] = float(flows.mean())
    if abs(mean) > FLOW:
        f |= {"flow_div": float(car[beat].mean()) / mean, "cvr": f["true_MAP"] / mean, "lad_pi": float(np.ptp(flows)) / mean}
    rest, tail = int(0.05 * fs), max(int(0.05 * fs), (end - top) // 4)
    if end - top <= rest + tail + 3:
        return f
    bend = kn.derivative(p[top:end], fs, 2)[rest : end - top - tail]
    f["notch_id"] = rest + int(bend.argmax())
    cut = top + f["notch_id"]
    f["notch"] = float(p[cut])
    if pulse > PULSE:
        f["dni"] = (f["SBP"] - f["notch"]) / pulse
    f["pul_wid"] = kn.half_width(np.arange(onset, end) / fs, p[beat])
    fall, t = p[cut:end], np.arange(end - cut) / fs
    if len(fall) > 2 and np.ptp(fall) > 0:
        f |= {"dia_sl": float(np.polyfit(t, fall, 1)[0]), "dia_sl_ref": float(np.polyfit(fall, t, 1)[0])}
    f["p1"], f["p2"] = _shoulders(p[onset:cut], fs)
    f["p3"] = _diastolic_peak(fall)
    f |= {"p1_p2": f["p1"] / f["p2"] if f["p2"] else None, "p1_p3": f["p1"] / f["p3"] if f["p3"] else None, "aix": (f["p2"] - f["DBP"]) / (f["p1"] - f["DBP"]) if f["p1"] - f["DBP"] > PULSE else None}
    systole, diastole = lad[onset:cut], lad[cut:end]
    f |= {"lad_sys_pk": float(systole.max()), "lad_dia_pk": float(diastole.max()), "lad_dia_net": _area(diastole, fs), "lad_dia_neg": abs(_area(np.minimum(diastole, 0), fs)), "retro_flow": abs(_area(np.minimum(car[cut:end], 0), fs))}
    if abs(f["lad_sys_pk"]) > FLOW:
        f["lad_ds_rat"] = f["lad_dia_pk"] / f["lad_sys_pk"]
    if abs(diastole.mean()) > FLOW:
        f["dcr"] = f["DBP"] / float(diastole.mean())
    if (k := int(diastole.argmax())) > int(0.02 * fs):
        f["lad_acc_sl"] = (f["lad_dia_pk"] - float(diastole[0])) / (k / fs)
    return f
