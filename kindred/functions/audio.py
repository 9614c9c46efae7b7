"""Chroma of sound: how much of each of the twelve notes a frame of samples holds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples a frame, samples a second, lowest and highest frequency.
FRAME, RATE, LOWEST, HIGHEST = 4096, 11025, 27.5, 3520.0


def chroma(samples: Column, rate: int = RATE, size: int = FRAME) -> Column:
    """Twelve energies of unit length (all zero for silence) of a frame of ``size`` samples; null for a frame of another size."""
    pitch = np.arange(size // 2 + 1) * rate / size
    heard = np.flatnonzero((pitch >= LOWEST) & (pitch <= HIGHEST))
    note = np.floor(12 * np.log2(pitch[heard] / LOWEST)).astype(int) % 12
    to_note = (note[:, None] == np.arange(12)).astype(float)

    def run(frames: pd.Series) -> pd.Series:
        ok = [f is not None and len(f) == size for f in frames]
        out: list = [None] * len(frames)
        for i, f in enumerate(frames):
            if ok[i]:
                energy = (np.abs(np.fft.rfft(np.asarray(f, float) * np.hanning(size))[heard]) ** 2) @ to_note
                square = float(energy @ energy)
                out[i] = energy / square**0.5 if square >= 1e-10 else np.zeros(12)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")(samples)


#: Samples from one frame to the next, weights of five frames in a row, pairs of notes compared for each of the 32 bits.
HOP, TAPS = 1365, (0.25, 0.5, 1.0, 0.5, 0.25)
NOTE_PAIRS = [(i, (i + up) % 12) for up, n in ((1, 12), (3, 12), (6, 8)) for i in range(n)]


def second_codes(samples: np.ndarray) -> list[int]:
    """One 32-bit code a second of mono 16-bit samples: of each bit what most frames of the second say."""
    pitch = np.arange(FRAME // 2 + 1) * RATE / FRAME
    heard = np.flatnonzero((pitch >= LOWEST) & (pitch <= HIGHEST))
    to_note = (np.floor(12 * np.log2(pitch[heard] / LOWEST)).astype(int)[:, None] % 12 == np.arange(12)).astype(float)
    if len(samples) < FRAME + HOP * (len(TAPS) - 1):
        return []
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    notes, step = [], 256  # so many frames at once, whatever the length
    for i in range(0, len(frames), step):
        energy = (np.abs(np.fft.rfft(frames[i : i + step] / 32768 * np.hanning(FRAME))[:, heard]) ** 2) @ to_note
        length = np.sqrt((energy**2).sum(1, keepdims=True))
        notes.append(np.where(length**2 >= 1e-10, energy / np.maximum(length, 1e-300), 0))
    smooth = np.lib.stride_tricks.sliding_window_view(np.concatenate(notes), len(TAPS), axis=0) @ (np.array(TAPS) / sum(TAPS))
    smooth[(smooth**2).sum(1) < 1e-10] = 0
    a, b = np.array(NOTE_PAIRS).T
    bits = smooth[:, a] > smooth[:, b]
    second = (np.arange(len(bits)) + len(TAPS) - 1) * HOP // RATE
    n = np.bincount(second)
    on = np.stack([np.bincount(second, weights=bits[:, k], minlength=len(n)) for k in range(bits.shape[1])], 1)
    return ((2 * on > n[:, None]) * (1 << np.arange(32, dtype=np.int64))).sum(1).tolist()


def _sound_codes(samples: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else second_codes(np.asarray(s, float)) for s in samples], dtype=object)


def sound_codes(samples: Column) -> Column:
    """Codes of a recording at 11025 samples a second, one a second; empty for less than five frames, null for null.

    Missing samples count as silence.
    """
    return F.pandas_udf(_sound_codes, "array<long>")(F.transform(samples, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))))
