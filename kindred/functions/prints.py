"""Fingerprints worked out in numpy over Arrow batches: perceptual hashes, gray frames of colour ones, hashes of file ends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE, KEPT = 32, 8
CHUNK = 64 << 10
#: Packet lengths of transport streams and the byte that each packet begins with.
PACKETS, SYNC = (188, 192, 204), 0x47


def _cosines() -> np.ndarray:
    k, i = np.arange(1, KEPT + 1)[:, None], np.arange(SIDE)[None]
    return np.cos((2 * i + 1) * k * np.pi / (2 * SIDE)).astype(np.float32)


def hashes_of(frames: np.ndarray) -> np.ndarray:
    """Hashes of gray frames (n x 1024): which of the 8 x 8 lowest frequencies (without the mean) are above their median."""
    c = _cosines()
    # frequency v down and u across: bit v * 8 + u
    part = np.einsum("nyx,ux->nuy", frames.reshape(-1, SIDE, SIDE).astype(np.float32), c)
    own = np.einsum("nuy,vy->nvu", part, c).reshape(-1, KEPT * KEPT)
    middle = np.sort(own, 1)[:, 31:33].sum(1) * np.float32(0.5)
    return ((own > middle[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def _perceptual_hash(frames: pd.Series) -> pd.Series:
    good = frames.map(lambda f: f is not None and len(f) == SIDE * SIDE and all(x is not None for x in f)).to_numpy(bool)
    out = pd.Series([None] * len(frames), dtype="Int64")
    if good.any():
        out[good] = hashes_of(np.stack(frames[good].to_list()))
    return out


def perceptual_hash(frames: Column) -> Column:
    """64-bit hash of a 32 x 32 gray frame; null for a frame of another size."""
    return F.pandas_udf(_perceptual_hash, "long")(frames)


def gray_of(rgb: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Gray frames (n x side * side) of square RGB frames (n x size * size * 3), block means of the luma, rounded."""
    size = round((rgb.shape[1] / 3) ** 0.5)
    block = size // side
    luma = rgb.reshape(-1, size, size, 3).astype(np.int64) @ np.array([299, 587, 114])
    total = luma[:, : side * block, : side * block].reshape(-1, side, block, side, block).sum((2, 4))
    return ((total + block * block * 500) // (block * block * 1000)).reshape(len(rgb), -1)


def _gray_frame(rgb: pd.Series) -> pd.Series:
    return rgb.map(lambda b: None if b is None or len(b) != 224 * 224 * 3 else gray_of(np.frombuffer(b, np.uint8)[None])[0].tolist())


def gray_frame(rgb: Column) -> Column:
    """32 x 32 gray frame of a 224 x 224 RGB frame as bytes; null for one of another size."""
    return F.pandas_udf(_gray_frame, "array<int>")(rgb)


def ends_hash(content: bytes) -> str | None:
    if len(content) < CHUNK:
        return None
    total = len(content) + sum(int(np.frombuffer(part, "<u8").sum(dtype=np.uint64)) for part in (content[:CHUNK], content[-CHUNK:]))
    return f"{total % (1 << 64):016x}"


def _file_ends_hash(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else ends_hash(bytes(c)))


def file_ends_hash(content: Column) -> Column:
    """Size and the sums of the first and last 64 KiB as 64-bit numbers, in hex; null for smaller files."""
    return F.pandas_udf(_file_ends_hash, "string")(content)


def is_text(head: bytes) -> bool:
    data = np.frombuffer(head, np.uint8)
    if not len(data) or (data == 0).any():
        return False
    sync = data == SYNC
    return not any((sync[: -2 * n] & sync[n:-n] & sync[2 * n :]).any() for n in PACKETS if len(data) > 2 * n)


def _text_not_video(head: pd.Series) -> pd.Series:
    return head.map(lambda h: None if h is None else is_text(bytes(h)))


def text_not_video(head: Column) -> Column:
    """Are a file's first bytes text: no zero byte, and no three packets of a transport stream in a row, from any byte."""
    return F.pandas_udf(_text_not_video, "boolean")(head)


def sampled_hash(content: bytes, whole: int = 256 << 20, sample: int = 4 << 20, places: int = 9) -> str:
    """SHA-256 of the content; above ``whole`` bytes of its size and evenly spread samples."""
    import hashlib

    if len(content) <= whole:
        return hashlib.sha256(content).hexdigest()
    h = hashlib.sha256(len(content).to_bytes(8, "little"))
    for i in range(places):
        at = (len(content) - sample) * i // (places - 1)
        h.update(content[at : at + sample])
    return h.hexdigest()


def _content_hash(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else sampled_hash(bytes(c)))



def content_hash(content: Column) -> Column:
    return F.pandas_udf(_content_hash, "string")(content)