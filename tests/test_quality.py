"""The ordered quality engine against a slow version that looks at the whole recording, on a signal with clean, low, noisy and wandering stretches."""

import numpy as np
import pytest

from pulseloom.functions import kernels as kn
from pulseloom.functions import quality as qu

FS, SIZE, STEP = 250.0, 2500, 2000


def signal(seed=0, seconds=420):
    """A beat every 0.8 s; low from 120 s, noise from 140 to 215 s, a stretch of doubled rate, a jump of the baseline near the end."""
    r = np.random.default_rng(seed)
    t = np.arange(int(seconds * FS)) / FS
    x = 0.02 * np.sin(2 * np.pi * 0.25 * t) + 0.004 * r.normal(size=len(t))
    at, beats = 0.3, []
    while at < seconds - 0.5:
        beats.append(at)
        at += (0.3 if 300 < at < 303 else 0.8) * (1 + 0.02 * np.sin(at))
    for b in beats:
        size = 0.3 if 120 <= b < 140 else 1 + 0.1 * np.sin(b)
        for shift, width, height in ((-0.1, 0.02, 0.12), (-0.025, 0.008, -0.12), (0, 0.009, 1.1), (0.03, 0.01, -0.2), (0.22, 0.035, 0.3)):
            a, z = max(0, int((b + shift - 0.2) * FS)), int((b + shift + 0.2) * FS)
            x[a:z] += size * height * np.exp(-(((t[a:z] - b - shift) / width) ** 2) / 2)
    x[(t >= 140) & (t < 215)] = 0.4 * r.normal(size=int(((t >= 140) & (t < 215)).sum()))
    x[t >= 380] += 0.6 * np.sin(2 * np.pi * 0.4 * t[t >= 380])
    return x


def rolling(x, size=41):
    half = size // 2
    out = np.empty(len(x))
    out[half : len(x) - half] = np.median(np.lib.stride_tricks.sliding_window_view(x, size), axis=1)
    out[:half] = out[half]
    out[len(x) - half - 1 :] = np.median(x[len(x) - size : len(x) - 1])
    return out


def slow(x, med):
    """Section by section on the whole recording's arrays, peak by peak."""
    state, stored, mp_med, mp_mad, low, thresh, out = qu.start(), [], [], [], 0, 1.0, []
    for begin in range(0, len(x) - SIZE + 1, STEP):
        end = begin + SIZE
        own = qu.features(x[begin:end], med[begin:end], FS)
        far, stable = qu.shift(state, own)
        why = qu.first_gate(own, stable)
        if why or not 4 <= len(own["peaks"]) <= 100:
            out.append((0, why or ["no_sig"], [], []))
            continue
        peaks = [begin + p for p in own["peaks"]]
        shared = [p for p in peaks if p in [q for q, _ in stored[-20:]]]
        if shared:
            peaks = [p for p in peaks if p >= max(shared)]
            while stored and stored[-1][0] >= max(shared):
                stored.pop()
        keys = []
        for i in range(len(stored) - 1, 0, -1):  # the oldest one never counts
            keys = [stored[i][0], *keys] if stored[i][1] else []
            if keys and keys[-1] - keys[0] > 10 * FS:
                break
        else:
            keys = []
        stale = not keys or (begin - keys[-1]) / FS > 60
        ok, why = [1] * len(peaks), []
        if stale or own["hjorth"] > 2 or far > 2:
            if len(peaks) < 4:
                out.append((0, ["Bad Beat"], peaks, [0] * len(peaks)))
                continue
            local = [p - begin for p in peaks]
            m = max(75, int(np.median([b // 2 - a // 2 for a, b in zip(local, local[1:])])))
            dist = kn.matrix_profile(x[begin:end], m)[0]
            center, scatter = np.median(dist), np.median(np.abs(dist - np.median(dist)))
            if not mp_med:
                mp_med.append(center), mp_mad.append(scatter)
            limit, bad = max(7, np.median(mp_med[-6:]) + 5.5 * max(0.4, np.median(mp_mad[-6:]))), 0
            ok = [0] * len(peaks)
            for i, (a, b) in enumerate(zip(local, local[1:])):
                lo, hi = max(0, a - m // 2), min(len(dist), a + m // 2)
                near = dist[lo:hi].max() if lo < hi and np.ptp(x[begin + lo : begin + hi + m]) >= 0.2 else 0
                around = x[max(begin, begin + a - 25) : min(end, begin + a + 25)]
                gap = x[begin + a + 25 : begin + b - 25]
                noise = 0
                if len(gap) > 50:
                    f = np.abs(np.fft.rfft(gap * np.hanning(len(gap))))
                    noise = f[np.fft.rfftfreq(len(gap), 1 / FS) > 15].sum() / f.sum()
                if near > limit or len(around) > 4 and kn.hjorth(around) > 4.5 or noise > 0.5:
                    bad += 1
                else:
                    ok[i] = 1
            if bad / (len(peaks) - 1) > 0.25:
                out.append((0, ["Bad Beat"], peaks, [0] * len(peaks)))
                continue
            mp_med.append(center), mp_mad.append(scatter)
        if not stale:
            usual = np.median(np.diff(keys))
            alive = [i for i in range(len(peaks)) if ok[i]]
            gaps = [peaks[b] - peaks[a] for a, b in zip(alive, alive[1:])]
            if any(g < 0.4 * usual for g in gaps):
                why.append("short_sep")
            for (a, b), g in zip(list(zip(alive, alive[1:])), gaps):
                if g < 0.4 * usual:
                    ok[a] = ok[b] = 0
            if any(g > 4 * usual for g in gaps):
                why.append("long_sep")
            tall = np.median([x[k] - med[k] for k in keys])
            odd = [i for i, p in enumerate(peaks) if not 0.4 * tall <= x[p] - med[p] <= 4 * tall]
            why += ["height"] * bool(odd)
            raw = spread = max(0.05, np.subtract(*np.quantile(med[keys[0] : keys[-1]], [0.8, 0.2])))
            if spread <= thresh + 0.001:
                low = min(low + 1, 20)
                if low > 3:
                    spread *= min(1.5 ** (low - 3), 15)
                thresh = min(thresh, raw)
            else:
                thresh, low = spread, 0
            top, floor = np.quantile(med[begin:end], 0.8) + 1.5 * spread, np.quantile(med[begin:end], 0.2) - 1.5 * spread
            wild = [i for i in range(len(peaks) - 1) if any(v > top or v < floor for v in med[peaks[i] : peaks[i + 1]])]
            why += ["roll_med"] * (len(wild) > round(0.5 * (len(peaks) - 1)))
            slopes = []
            for p in peaks:
                a = max(0, p - int(0.75 * usual))
                part = x[a : p + 1]
                if len(part) > 7:
                    part = np.convolve(part, np.hanning(7) / np.hanning(7).sum(), "same")
                sign = np.sign(np.diff(part))
                turns = [i for i in range(len(sign)) if sign[i - 1] - sign[i] in (-2, -1)]
                base = a + (turns[-1] if turns else 0)
                slopes.append(np.polyfit(np.arange(base, p), x[base:p], 1)[0] if p - base > 3 else 0.0)
            steep = [i for i, s in enumerate(slopes) if len(peaks) > 2 and not 0.1 * np.median(slopes) <= s <= 5 * np.median(slopes)]
            why += ["slope"] * bool(steep)
            for i in {*odd, *wild, *steep}:
                ok[i] = 0
        good = not why
        ok = ok if good else [0] * len(ok)
        stored += list(zip(peaks, ok))
        out.append((int(good), why, peaks, ok))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_engine_equals_the_slow_version(seed):
    x = signal(seed)
    med = rolling(x)
    state, got = qu.start(), []
    for begin in range(0, len(x) - SIZE + 1, STEP):
        part, m = x[begin : begin + SIZE], med[begin : begin + SIZE]
        own = qu.features(part, m, FS)
        early = sum(p < SIZE // 2 for p in own["peaks"])
        beats = qu.beats_of(part, own["peaks"], FS, early + 1) if not qu.first_gate(own, True) else None
        state, out = qu.step(state, {"start": begin, "wave": part, "med": m, "features": own, "beats": beats}, FS)
        got.append((out["valid"], out["reasons"], [begin + p for p in out["peaks"]], out["mask"]))
        state = qu.unpacked(qu.packed(state))
    want = slow(x, med)
    for i, (a, b) in enumerate(zip(got, want)):
        assert a == b, i
    reasons = {r for _, why, _, _ in want for r in why}
    assert {"height", "short_sep", "roll_med", "Low Kurtosis"} <= reasons and sum(v for v, *_ in want) > 10
    assert len(state["past"]) <= (qu.RUN + qu.AGE + 2 * qu.LEAD) * FS + SIZE and len(state["peaks"]) <= qu.HISTORY


def test_wander_is_held_against_the_history():
    """A section that wanders does not widen its own bounds: the range between the keys decides."""
    past = np.tile([0.0, 0.1], 2000)
    state = qu.start() | {"past_at": 0, "past": past, "thresh": 0.01}
    keys = [[0, 1, 1.0], [4000, 1, 1.0]]
    med = np.linspace(0, 4, 2500)
    assert qu._wander(state, keys, med).mean() > 0.2
    state = qu.start() | {"past_at": 0, "past": np.linspace(0, 8, 4000), "thresh": 0.01}
    assert not qu._wander(state, keys, med).any()
