"""Kernels and gates against closed forms and brute force; the reference's own acceptance cases."""

import numpy as np
import pytest

from pulseloom.functions import beats as be
from pulseloom.functions import kernels as kn
from pulseloom.functions import quality as qu

FS = 1000.0
T = np.arange(2000) / FS
NOISE = np.random.default_rng(42).normal(size=2000)


def ecg(seconds=10.0, fs=250.0, rate=1.2, noise=0.0, seed=0):
    """Sum of Gaussians; returns the signal and its R positions."""
    t = np.arange(int(seconds * fs)) / fs
    x = np.zeros(len(t))
    centres = np.arange(0.5, seconds, 1 / rate)
    for c in centres:
        for shift, height, width in ((-0.17, 0.15, 0.02), (-0.035, -0.12, 0.008), (0, 1.2, 0.011), (0.03, -0.25, 0.009), (0.25, 0.3, 0.04)):
            x += height * np.exp(-((t - c - shift) ** 2) / (2 * width**2))
    return x + np.random.default_rng(seed).normal(0, noise, len(t)), np.round(centres * fs).astype(int)


def test_hjorth_of_noise_is_above_that_of_a_sine():
    sine = np.sin(2 * np.pi * 10 * T)
    assert kn.hjorth(NOISE) > kn.hjorth(sine) and kn.hjorth(sine) < 1.5
    assert kn.hjorth(np.ones(50)) == 0


def test_band_ratio_and_entropy():
    ten, thirty = kn.spectral_gate(np.sin(2 * np.pi * 10 * T), FS), kn.spectral_gate(np.sin(2 * np.pi * 30 * T), FS)
    assert ten["ratio"] > 0.9 and thirty["ratio"] < 0.1 and ten["entropy"] < 2
    assert kn.spectral_gate(NOISE, FS)["entropy"] > 5


def test_flat_line_fails_on_kurtosis():
    flat = np.random.default_rng(42).normal(0, 1e-4, 2000)
    own = qu.features(flat, np.zeros(2000), FS)
    assert "Low Kurtosis" in qu.first_gate(own, True)


def test_lookback():
    peaks = [[p, int(p != 6000), 1.0] for p in range(1000, 10000, 1000)]
    assert [p[0] for p in qu.lookback(peaks, 1999)] == [7000, 8000, 9000]
    assert qu.lookback(peaks, 1e6) == []


@pytest.mark.parametrize("qt,rr,want", [(400, 1000, 400), (300, 500, 424), (400, 0, 0), (None, 900, 0)])
def test_corrected_qt(qt, rr, want):
    assert be.corrected_qt(qt, rr) == want


def test_find_peaks_rules():
    x = np.array([0, 2, 1, 3, 0, 1, 1, 1, 0, 5, 0.0])
    assert kn.find_peaks(x)[0].tolist() == [1, 3, 6, 9]
    assert kn.find_peaks(x, height=2.5)[0].tolist() == [3, 9]
    assert kn.find_peaks(x, distance=4)[0].tolist() == [1, 5, 9] or kn.find_peaks(x, distance=4)[0].tolist() == [3, 9]
    assert kn.find_peaks(x)[2].tolist() == [1, 3, 1, 5]
    assert kn.find_peaks(x, prominence=2)[0].tolist() == [3, 9]


def test_savgol_keeps_cubics_and_their_slopes():
    y = T**3 - 2 * T
    assert np.abs(kn.savgol(y, 15, 3) - y).max() < 1e-12
    assert np.abs(kn.savgol(y, 15, 3, 1) * FS - (3 * T**2 - 2)).max() < 1e-9
    assert len(kn.smooth([1.0, 2.0])) == 2


def test_filters():
    slow, fast, hum = np.sin(2 * np.pi * 5 * T), np.sin(2 * np.pi * 200 * T), np.sin(2 * np.pi * 60 * T)
    assert np.abs(kn.filtered(slow + fast, FS, "low", 40) - slow)[200:-200].max() < 1e-2
    assert np.abs(kn.filtered(slow + fast, FS, "high", 100) - fast)[200:-200].max() < 2e-2
    assert np.abs(kn.filtered(slow + hum, FS, "notch", 60) - slow)[800:-800].max() < 2e-2
    b, a = kn.butterworth(4, 40, FS, "low")
    w = np.exp(-2j * np.pi * 40 / FS * np.arange(5))
    assert abs(abs((b * w).sum() / (a * w).sum()) - 2**-0.5) < 1e-9


def test_welch_power_of_a_sine():
    f, p = kn.welch(np.sin(2 * np.pi * 10 * T), FS, 1000)
    assert f[p.argmax()] == 10 and abs(p.sum() * (f[1] - f[0]) - 0.5) < 1e-2


def test_distances_of_distributions():
    f = np.arange(5.0)
    assert kn.earth_mover(f, np.eye(5)[0], np.eye(5)[3]) == pytest.approx(3)
    assert kn.sample_mover([0, 1], [2, 3]) == pytest.approx(2)


def test_spline_knee_width():
    x = np.linspace(0, 3, 9)
    at = np.linspace(0, 3, 40)
    assert np.abs(kn.spline(x, x**3 - x, at) - (at**3 - at)).max() < 1e-12
    assert 20 <= kn.knee(1 - np.exp(-np.linspace(0, 8, 100))) <= 32
    assert kn.half_width(np.arange(201), np.maximum(0, 100 - abs(np.arange(201) - 100.0))) == pytest.approx(100)


def test_matrix_profile_against_brute_force():
    x = np.random.default_rng(1).normal(size=200).cumsum()
    x[140:165] = x[30:55]
    d, near = kn.matrix_profile(x, 20)
    z = np.array([(w - w.mean()) / w.std() for w in np.lib.stride_tricks.sliding_window_view(x, 20)])
    full = np.linalg.norm(z[:, None] - z[None], axis=2)
    full[np.abs(np.subtract.outer(np.arange(len(z)), np.arange(len(z)))) <= 5] = np.inf
    assert np.abs(d - full.min(1)).max() < 1e-5 and near[142] == 32
    assert kn.matches(x[30:55], x)[0][0] == 30


def test_flat_windows_have_defined_distances():
    x = np.concatenate([np.zeros(40), np.sin(np.arange(60.0))])
    d, _ = kn.matrix_profile(x, 10)
    assert np.isfinite(d).all() and d[0] == 0


def test_regime_change_is_found():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.sin(np.arange(1000) / 5), np.sign(np.sin(np.arange(1000) / 9)) + 0.01 * rng.normal(size=1000)])
    near = kn.matrix_profile(x, 60)[1]
    assert abs(kn.regimes(kn.arc_curve(near, 60), 60, 2)[0] - 1000) < 80


def test_beats_of_a_synthetic_ecg():
    x, r = ecg()
    med = np.full(len(x), np.median(x))
    at, _, prom = kn.find_peaks(x, height=np.percentile(x, 94), prominence=0.5, distance=50)
    assert np.abs(at - r[: len(at)]).max() <= 1
    beats, level = be.pqrst(x, med, at, 250.0, float(prom.mean()))
    inner = [b for b in beats[1:-1] if b["valid_qrs"]]
    assert len(inner) >= len(beats) - 4
    for b in inner:
        assert abs(b["t_peak"] - b["r_peak"] - 62) <= 4 and abs(b["r_peak"] - b["p_peak"] - 42) <= 4
        assert b["p_onset"] <= b["p_peak"] < b["q_peak"] < b["r_peak"] < b["s_peak"] < b["t_peak"] < b["t_offset"]
        assert 60 <= b["PR"] <= 300 and 200 <= b["QT"] <= 600 and b["QTc"] > b["QT"] * 0.9


def test_fold_accepts_a_clean_ecg_and_rejects_noise():
    x, _ = ecg(60.0, noise=0.005)
    state, valid = qu.start(), []
    for i in range(5):
        part = x[i * 2000 : i * 2000 + 2500]
        med = np.full(len(part), np.median(part))
        own = qu.features(part, med, 250.0)
        state, out = qu.step(state, {"start": i * 2000, "wave": part, "med": med, "features": own, "beats": qu.beats_of(part, own["peaks"], 250.0, 5)}, 250.0)
        valid.append(out["valid"])
        state = qu.unpacked(qu.packed(state))
    assert sum(valid) >= 3, valid
    noise = np.random.default_rng(3).normal(size=2500)
    _, out = qu.step(state, {"start": 20000, "wave": noise, "med": np.zeros(2500), "features": qu.features(noise, noise * 0, 250.0), "beats": None}, 250.0)
    assert not out["valid"] and out["reasons"]


def test_pressure_beat():
    fs, n = 250.0, 250
    t = np.arange(n) / n
    one = 80 + 40 * np.where(t < 0.15, np.sin(np.pi / 2 * t / 0.15) ** 2, np.exp(-(t - 0.15) * 3)) + 4 * np.exp(-((t - 0.45) ** 2) / 0.001)
    p = np.tile(one, 6)
    at, _, _ = kn.find_peaks(p, height=np.percentile(p, 35), prominence=0.4 * np.ptp(p), distance=50)
    beat = be.pressure_beat(p, np.full(len(p), 2.0), np.full(len(p), 5.0), at, 2, fs)
    assert beat["onset"] < beat["sbp_id"] < beat["dbp_id"] and 115 < beat["SBP"] <= 121 and 80 <= beat["DBP"] < 90
    assert 0 < beat["dni"] < 1 and beat["flow_div"] == pytest.approx(2.5) and beat["ap_MAP"] < beat["SBP"]


def test_template_and_phase():
    x, _ = ecg(0.9)
    assert abs(be.template(x, 250.0)["r_peak"] - 125) <= 1
    assert kn.phase_variance(kn.phase(np.sin(2 * np.pi * 10 * T), FS, 10)[500:1500:100]) < 1e-3


def test_windows_that_are_each_others_nearest_are_equally_far():
    rng = np.random.default_rng(3)
    for _ in range(20):
        d, near = kn.matrix_profile(np.round(rng.normal(50, 30, 100), 2), 10, strict=True)
        for i, k in enumerate(near):
            assert near[k] != i or d[k] == d[i]


def test_equal_windows_are_equal_matches():
    bump = [0.0, 1.0, 3.0, 6.0, 3.0, 1.0, 0.0, -1.0, 0.0, 0.0]
    x = np.concatenate([np.round(np.random.default_rng(4).normal(0, 9, 50), 2), *[[7.3] * 6 + [2.1] * 14] * 3])
    profile = kn.distance_profile(bump, x)
    assert profile[50:60].tolist() == profile[70:80].tolist() == profile[90:100].tolist()


def test_flat_windows_by_the_rule_of_sql():
    x = np.concatenate([np.round(np.random.default_rng(5).normal(0, 9, 40), 2), [3.0] * 12, [1.0, 2.0, 5.0]])
    d, _ = kn.matrix_profile(x, 10, strict=True)
    assert np.flatnonzero(np.isnan(d)).tolist() == [40, 41, 42]
    found = [k for k, _ in kn.matches(x[:10], x, strict=True)]
    profile = kn.distance_profile(x[:10], x, strict=True)
    near = lambda k: [profile[o] for o in range(max(0, k - 3), min(len(profile), k + 4)) if not np.isnan(profile[o])]
    assert found[0] == 0 and sorted(found) == [k for k in range(len(profile)) if profile[k] == min(near(k), default=0)]
