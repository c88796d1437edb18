"""The ordered part of the ECG engine: gates that depend on what was accepted before, as one step from state to state.

Batch and stream both call ``step(state, section)``. What a section brings by itself (``features``, ``beats_of``) is worked out side by
side before; the state holds what was accepted: a few spectra, peaks, the rolling median between the oldest and newest
key that may still count, and the end of the last section's wave. ``packed`` and ``unpacked`` turn it into text and back.
"""

from __future__ import annotations

import base64
import json

import numpy as np

from pulseloom.functions import kernels as kn

KEEP, STORED, HISTORY = 6, 20, 400
#: Seconds: the run of valid peaks that counts as history, its greatest age, the wave before a section that slopes may reach into.
RUN, AGE, LEAD = 10, 60, 4
#: Gates of the first stage: kurtosis below, Hjorth above, QRS share below, entropy above, shift from here on.
KURTOSIS, HJORTH, QRS, ENTROPY, SHIFT = 4.0, 3.0, 0.25, 6.5, 3.0
#: Bounds against history (low, high) by generation of the engine: separation, height, slope, and whether they are around the median or the mean.
LIMITS = {
    "v4": {"sep": (0.4, 4.0), "height": (0.4, 4.0), "slope": (0.1, 5.0), "centre": np.median},
    "v3.1": {"sep": (0.5, 2.0), "height": (0.51, 3.0), "slope": (0.2, 3.0), "centre": np.mean},
    "v3": {"sep": (0.5, 2.0), "height": (0.51, 3.0), "slope": (0.3, 3.0), "centre": np.mean},
}


def start() -> dict:
    return {"bands": [], "med": [], "mad": [], "peaks": [], "low": 0, "thresh": 1.0, "past_at": 0, "past": np.zeros(0), "lead_at": 0, "lead": np.zeros(0)}


def packed(state: dict) -> str:
    return json.dumps({k: base64.b64encode(v.tobytes()).decode() if isinstance(v, np.ndarray) else v for k, v in state.items()})


def unpacked(text: str) -> dict:
    return {k: np.frombuffer(base64.b64decode(v), float) if k in ("past", "lead") else v for k, v in json.loads(text).items()}


def _joined(at: int, held: np.ndarray, begin: int, new: np.ndarray, keep: int) -> tuple[int, np.ndarray]:
    """The samples held from ``at`` on, continued by those from ``begin`` on (a gap is held as NaN), the last ``keep`` of them."""
    if not len(held) or begin < at or begin - at - len(held) > keep:
        at, held = begin, np.zeros(0)
    head = held[: begin - at]
    out = np.concatenate([head, np.full(begin - at - len(head), np.nan), new])
    cut = max(0, len(out) - keep)
    return at + cut, out[cut:]


def features(x, med, fs: float) -> dict:
    """What a section contributes on its own: measures, QRS band and R peaks with heights and prominences."""
    x = np.asarray(x, float)
    gate = kn.spectral_gate(x, fs)
    sd = x.std()
    kurt = float((((x - x.mean()) / sd) ** 4).mean() - 3) if sd else -3.0
    at, _, prom = kn.find_peaks(x, height=np.percentile(x, 94), prominence=np.percentile(x, 99), distance=int(0.2 * fs))
    return {"kurtosis": kurt, "hjorth": kn.hjorth(x), "ratio": gate["ratio"], "entropy": gate["entropy"], "f": gate["f"].tolist(), "band": gate["band"].tolist(), "peaks": at.tolist(), "prominence": float(prom.mean()) if len(prom) else 1.0}


def shift(state: dict, own: dict) -> tuple[float, bool]:
    """(distance of the QRS band from the median of the last accepted ones, stable); a stable band joins them."""
    band = np.asarray(own["band"])
    if not len(band):
        return 0.0, True
    if not state["bands"]:
        state["bands"].append(own["band"])
        return 0.0, True
    usual = np.median([b for b in state["bands"] if len(b) == len(band)] or [band], axis=0)
    far = kn.earth_mover(np.asarray(own["f"]), usual, band) if usual.sum() > 0 else 0.0
    if far < SHIFT:
        state["bands"] = [*state["bands"], own["band"]][-KEEP:]
    return far, far < SHIFT


def first_gate(own: dict, stable: bool) -> list[str]:
    tests = (("Low Kurtosis", own["kurtosis"] < KURTOSIS), ("High Hjorth Complexity", own["hjorth"] > HJORTH), ("Low QRS Power", own["ratio"] < QRS), ("High Spec Entropy", own["entropy"] > ENTROPY), ("Shift in W-Dist", not stable))
    return [name for name, failed in tests if failed]


def beats_of(x, peaks, fs: float, starts: int = 1) -> dict | None:
    """What the beats of a section bring to the gate: {faults, of, far, med, mad}, or None with fewer than four peaks or no profile.

    faults: whether a beat is too complex (1) or followed by noise (2). The profile's window follows from the peaks that are new, and of a
    section that overlaps another the first ones are not: of[k] says which profile is that of the peaks from the k-th on, for k < ``starts``.
    Of each profile: far, the greatest distance near each beat (0 where the wave is flat), med and mad.
    """
    x, peaks = np.asarray(x, float), np.asarray(peaks, int)
    if len(peaks) < 4:
        return None
    faults, offset = [], int(0.1 * fs)
    for a, b in zip(peaks[:-1], peaks[1:]):
        gap, beat, fault = x[a + offset : b - offset], x[max(0, a - offset) : a + offset], 0
        if len(beat) > 4 and kn.hjorth(beat) > 4.5:
            fault = 1
        elif len(gap) > int(0.2 * fs):
            power = np.abs(np.fft.rfft(gap * np.hanning(len(gap))))
            fault = 2 if power.sum() > 0 and power[np.fft.rfftfreq(len(gap), 1 / fs) > 15].sum() / power.sum() > 0.5 else 0
        faults.append(fault)
    sizes = [max(int(0.3 * fs), int(np.median(np.diff(peaks[k:] // 2)))) for k in range(min(starts, len(peaks) - 3))]
    kinds, far, meds, mads = sorted(set(sizes)), [], [], []
    for m in kinds:
        dist, _ = kn.matrix_profile(x, m)
        if not len(dist):
            return None
        near = [(max(0, a - m // 2), min(len(dist), a + m // 2)) for a in peaks[:-1].tolist()]
        far.append([float(dist[a:b].max()) if a < b and np.ptp(x[a : b + m]) >= 0.2 else 0.0 for a, b in near])
        meds.append(float(np.median(dist)))
        mads.append(float(np.median(np.abs(dist - meds[-1]))))
    return {"faults": faults, "of": [kinds.index(m) for m in sizes], "far": far, "med": meds, "mad": mads}


def beat_gate(state: dict, beats: dict | None, first: int, count: int) -> tuple[bool, list[int], list[str | None], float]:
    """(section valid, mask, reason of each beat, share of bad beats) of the ``count`` peaks from the ``first`` on, by profile distance against
    history, local complexity and noise."""
    if beats is None or count < 4:
        return False, [0] * count, [], 1.0
    kind = beats["of"][first]
    med, mad = beats["med"][kind], beats["mad"][kind]
    if not state["med"]:
        state["med"], state["mad"] = [med], [mad]
    limit = max(float(np.median(state["med"])) + 5.5 * max(float(np.median(state["mad"])), 0.4), 7.0)
    reasons = ["MP" if far > limit else (None, "HJH", "STFT")[fault] for far, fault in zip(beats["far"][kind][first:], beats["faults"][first:])]
    bad = sum(r is not None for r in reasons) / len(reasons)
    if bad <= 0.25:
        state["med"], state["mad"] = [*state["med"], med][-KEEP:], [*state["mad"], mad][-KEEP:]
    return bad <= 0.25, [*(int(r is None) for r in reasons), 0], reasons, bad


def lookback(peaks: list, samples: float) -> list:
    """Newest run of valid (position, valid, height) that spans more than ``samples`` before the oldest one of all; oldest first."""
    run: list = []
    for i, p in enumerate(reversed(peaks)):
        if i + 1 == len(peaks):
            return []
        run = [*run, p] if p[1] else []
        if run and run[0][0] - run[-1][0] > samples:
            return run[::-1]
    return []


def _wander(state: dict, keys: list, med: np.ndarray) -> np.ndarray:
    """Which samples of the rolling median leave its own 20 to 80 % range by more than 1.5 times the range that it had between the keys.

    A range as small as the smallest so far is widened, the more the more often in a row that happens.
    """
    then = state["past"][max(0, keys[0][0] - state["past_at"]) : max(0, keys[-1][0] - state["past_at"])]
    then = then[~np.isnan(then)]
    spread = raw = max(float(np.ptp(np.quantile(then, [0.2, 0.8]))) if len(then) else 0.0, 0.05)
    if spread <= state["thresh"] + 0.001:
        state["low"] = min(state["low"] + 1, 20)
        spread *= min(1.5 ** max(state["low"] - 3, 0), 15.0)
        state["thresh"] = min(state["thresh"], raw)
    else:
        state["thresh"], state["low"] = spread, 0
    low, high = np.quantile(med, [0.2, 0.8])
    return (med > high + 1.5 * spread) | (med < low - 1.5 * spread)


def _slope(long: np.ndarray, top: int, reach: int) -> float:
    """Slope of the upstroke that ends at ``top``: from the last turning point of the lightly smoothed wave within ``reach``."""
    first = max(0, top - reach)
    part = long[first : top + 1]
    if len(part) > 7:
        part = np.convolve(part, np.hanning(7) / np.hanning(7).sum(), "same")
    steps = np.sign(np.diff(part))
    turns = np.flatnonzero(np.isin(np.roll(steps, 1) - steps, (-2, -1)))
    base = first + (int(turns[-1]) if len(turns) else 0)
    return float(np.polyfit(np.arange(base, top), long[base:top], 1)[0]) if top - base > 3 else 0.0


def history_gate(state: dict, section: dict, peaks: list[int], mask: list[int], keys: list, fs: float, limits: str = "v4") -> tuple[bool, list[int], list[str]]:
    """(valid, mask, reasons) of a section's new peaks against the last valid run: distances, heights, wander of the rolling median,
    upstroke slopes. section: {start, wave, med}; mask: the peaks that passed so far, of which the distances are taken.
    """
    x, med, peaks = np.asarray(section["wave"], float), np.asarray(section["med"], float), np.asarray(peaks, int)
    bound, ok, reasons = LIMITS[limits], np.array(mask, int), []
    centre = bound["centre"]
    usual = float(centre(np.diff([k[0] for k in keys])))
    passed = np.flatnonzero(ok)
    gaps = np.diff(peaks[passed])
    short = np.flatnonzero(gaps < bound["sep"][0] * usual)
    ok[passed[short]] = ok[passed[short + 1]] = 0
    reasons += ["short_sep"] * bool(len(short)) + ["long_sep"] * bool((gaps > bound["sep"][1] * usual).any())
    share = (x[peaks] - med[peaks]) / float(centre([k[2] for k in keys]))
    off = (share < bound["height"][0]) | (share > bound["height"][1])
    ok[off] = 0
    reasons += ["height"] * bool(off.any())
    out = np.concatenate([[0], np.cumsum(_wander(state, keys, med))])
    wild = np.append(out[peaks[1:]] > out[peaks[:-1]], False)
    ok[wild] = 0
    reasons += ["roll_med"] * bool(wild.sum() > round(0.5 * (len(peaks) - 1)))
    if len(peaks) > 2:
        before = max(0, min(len(state["lead"]), section["start"] - state["lead_at"]))
        before = before if state["lead_at"] + before == section["start"] else 0
        long = np.concatenate([state["lead"][:before], x])
        slopes = np.array([_slope(long, before + int(p), int(0.75 * usual)) for p in peaks])
        steep = (slopes < bound["slope"][0] * centre(slopes)) | (slopes > bound["slope"][1] * centre(slopes))
        ok[steep] = 0
        reasons += ["slope"] * bool(steep.any())
    return not reasons, ok.tolist(), reasons


def step(state: dict, section: dict, fs: float, limits: str = "v4") -> tuple[dict, dict]:
    """One section: {start, wave, med, features, beats}; beats may be None and are then worked out if history asks for them. Returns the new state and {valid, reasons, peaks, mask, new, stale, wdist, bad_ratio}.

    Of the peaks that the section shares with the last stored ones, the newest opens its new peaks and is judged again. New peaks of
    a section that fails against history are stored as not valid; those of one that fails before are not stored.
    """
    state = {k: list(v) if isinstance(v, list) else v for k, v in state.items()}
    own, first = section["features"], int(section["start"])
    far, stable = shift(state, own)
    out = {"valid": 0, "reasons": first_gate(own, stable), "peaks": [], "mask": [], "new": [], "stale": None, "wdist": far, "bad_ratio": None}
    if not out["reasons"] and not 4 <= len(own["peaks"]) <= 100:
        out["reasons"] = ["no_sig"]
    if not out["reasons"]:
        known = {p[0] for p in state["peaks"][-STORED:]}
        k = max((i for i, p in enumerate(own["peaks"]) if first + p in known), default=0)
        peaks = list(own["peaks"][k:])
        if k or first + peaks[0] in known:
            state["peaks"] = [p for p in state["peaks"] if p[0] < first + peaks[0]]
        keys = lookback(state["peaks"], RUN * fs)
        stale = not keys or (first - keys[-1][0]) / fs > AGE
        good, mask = True, [1] * len(peaks)
        if stale or own["hjorth"] > 2 or far > 2:
            beats = section["beats"]
            if beats is None or k >= len(beats["of"]):  # history asks for what the section's own measures did not
                beats = beats_of(section["wave"], own["peaks"], fs, k + 1)
            good, mask, _, out["bad_ratio"] = beat_gate(state, beats, k, len(peaks))
            out["reasons"] += [] if good else ["Bad Beat"]
        stored = good
        if good and not stale:
            good, mask, why = history_gate(state, section, peaks, mask, keys, fs, limits)
            out["reasons"] += why
        out |= {"valid": int(good), "peaks": peaks, "mask": mask if good else [0] * len(mask), "stale": stale}
        if stored:
            fresh = [[first + p, m, float(section["wave"][p] - section["med"][p])] for p, m in zip(peaks, out["mask"])]
            out["new"] = [p[0] for p in fresh if p[0] not in known]
            state["peaks"] = [*state["peaks"], *fresh][-HISTORY:]
    state["past_at"], state["past"] = _joined(state["past_at"], state["past"], first, np.asarray(section["med"], float), int((RUN + AGE + 2 * LEAD) * fs) + len(section["med"]))
    state["lead_at"], state["lead"] = _joined(state["lead_at"], state["lead"], first, np.asarray(section["wave"], float), int(LEAD * fs) + len(section["wave"]))
    return state, out


def noisy_beats(x, peaks, fs: float) -> tuple[list[int], bool]:
    """Older gate: beats with two or more bins above 18 Hz over the mean of the bins below, and whether fewer than a quarter are such."""
    bad = []
    for a, b in zip(peaks[:-1], peaks[1:]):
        part = np.asarray(x[a:b], float)
        power, f = np.abs(np.fft.rfft(part - part.mean())), np.fft.rfftfreq(len(part), 1 / fs)
        low = power[(f > 0) & (f <= 18)]
        bad.append(int(len(low) > 0 and (power[f > 18] > low.mean()).sum() >= 2))
    return bad, not bad or sum(bad) / len(bad) < 0.25
