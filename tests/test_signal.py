import math

import numpy as np
import pytest

from cadenza.functions import kernels as k
from cadenza.functions.signal import find_peaks

SR = 16000


def tone(hz, s=10.0, sr=SR):
    return 0.4 * np.sin(2 * np.pi * hz * np.arange(int(s * sr)) / sr)


def test_phase_residual_of_a_steady_tone():
    # The tone's bin turns as expected; its two neighbours, of half the weight, lead and lag by a quarter turn.
    f = k.phase_family(tone(1000.0, 3), SR)
    assert f["F_phase_residual_cvar_all"] == pytest.approx(0.5, abs=1e-6)
    noise = k.phase_family(np.random.default_rng(0).normal(size=3 * SR), SR)
    assert noise["F_phase_residual_cvar_all"] > 0.3


def test_silence_and_short_are_missing():
    assert all(math.isnan(v) for v in k.phase_family(np.zeros(SR), SR).values())
    assert all(math.isnan(v) for v in k.phase_family(tone(100, 0.01), SR).values())
    assert k.stereo_frames(np.zeros(100), np.zeros(100), 44100) == []


def test_stereo_known_cases():
    x = np.random.default_rng(1).normal(size=44100)
    same = k.stereo_family(x, x, 44100)
    assert same["SC_500_2000hz_side_energy_fraction_median"] == pytest.approx(0, abs=1e-12) and same["SC_500_2000hz_signed_real_coherence_median"] == pytest.approx(1)
    anti = k.stereo_family(x, -x, 44100)
    assert anti["SC_500_2000hz_side_energy_fraction_median"] == pytest.approx(1)
    half = k.stereo_family(x, x / 2, 44100)
    assert half["SC_80_500hz_abs_iid_db_median"] == pytest.approx(20 * math.log10(2), abs=1e-6)
    assert math.isnan(k.stereo_family(x, 0 * x, 44100)["SC_80_500hz_abs_iid_db_median"])


def test_bicoherence_of_coupled_and_free_phases():
    rng = np.random.default_rng(2)
    n, size = 247, 1024
    p = rng.uniform(0, 2 * np.pi, (n, 3))
    s = np.zeros((n, size // 2 + 1), complex)
    s[:, 32], s[:, 48] = np.exp(1j * p[:, 0]), np.exp(1j * p[:, 1])
    s[:, 80] = np.exp(1j * (p[:, 0] + p[:, 1]))
    assert k.bicoherence(s, (32, 48))[0] == pytest.approx(1)
    s[:, 80] = np.exp(1j * p[:, 2])
    assert k.bicoherence(s, (32, 48))[0] < 0.05
    assert math.isnan(k.bicoherence(0 * s, (32, 48))[0])
    assert len(k.triads()) == 228 and len(k.bicoherence_pools(np.zeros(70_000))) == 228


def test_chroma_names_the_pitch_and_recurrence_finds_the_period():
    b, ok = k.chroma_blocks(tone(440.0), SR)
    assert ok.all() and set(b.argmax(1)) == {9}
    h = k.harmony_family(b, ok)
    assert h["H_pc_path_step_median"] == 0 and h["H_chroma_path_change_median"] < 1e-6
    notes = [262, 330, 392, 294, 349, 440, 494, 311, 415, 466]
    x = np.concatenate([tone(f, 1.0) for f in notes * 5])
    assert k.recurrence_family(*k.chroma_blocks(x, SR))["M_best_lag_sec"] == 10


def test_resample_keeps_a_tone():
    y = k.resample(tone(440.0, 1.0, 16000), 44100, 16000)
    assert len(y) == 44100
    want = tone(440.0, 1.0, 44100)
    assert np.abs(y[2000:-2000] - want[2000:-2000]).max() < 5e-3
    assert k.centre_crop(10, 7) == 1 and k.centre_crop(5, 7) == -1


def test_peaks_order_of_filters():
    x = np.array([0, 1, 0, 3, 0, 2, 2, 0, 0.5, 0.0])
    assert find_peaks(x).tolist() == [1, 3, 5, 8]
    assert find_peaks(x, 0.9).tolist() == [1, 3, 5]
    assert find_peaks(x, 0.9, 3).tolist() == [3]
    assert find_peaks(x, prominence=1.5).tolist() == [3, 5]


def test_small_kernels():
    assert np.allclose(k.dct_matrix(8) @ k.dct_matrix(8).T, np.eye(8))
    assert k.envelope(np.cos(2 * np.pi * 8 * np.arange(256) / 256)) == pytest.approx(np.ones(256))
    rate, extent, r2 = k.vibrato_windows(t := np.arange(100) / 100, 50 * np.sin(2 * np.pi * 5.5 * t) + 3 * t)
    assert rate == pytest.approx(5.5, abs=0.11) and extent == pytest.approx(50, rel=0.1) and r2 > 0.9
    a = np.random.default_rng(5).normal(size=500)
    assert k.best_lag(a, np.r_[np.zeros(17), a])[0] == 17
    assert k.template_search(a, a[120:180])[0] == 120
    assert k.dynamics_family(np.arange(7.0))["dynamics_iqr"] != k.dynamics_family(np.arange(7.0))["dynamics_iqr"]
    assert k.dynamics_family(np.arange(8.0))["dynamics_adjacent_change"] == 1.0
