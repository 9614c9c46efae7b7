"""Closer looks at pairs of decoded frames: blocks, colours, detail. Frames are bytes or integer arrays, row by row.

Each is an Arrow-batched function of two columns; a frame that is null or of another size gives null. A batch is
worked off frame by frame, so the memory above the batch is that of one pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sides of close looks; the largest block and colour difference and the least share of detail of copies.
SIDES = (512, 256, 128, 64)
BLOCK_LIMIT, COLOR_LIMIT, DETAIL_KEPT = 5.0, 6.0, 0.7


def _array(frame, size: int) -> np.ndarray | None:
    if frame is None:
        return None
    out = np.frombuffer(frame, np.uint8) if isinstance(frame, (bytes, bytearray)) else np.asarray(frame)
    return out.astype(np.int64) if len(out) == size else None


def _of_pairs(size: int, measure):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = ((_array(x, size), _array(y, size)) for x, y in zip(a, b, strict=True))
        return pd.Series([None if x is None or y is None else float(measure(x, y)) for x, y in pairs], dtype="float64")

    return F.pandas_udf(run, "double")


def _cells(values: np.ndarray, grid: int) -> np.ndarray:
    side = len(values)
    return values.reshape(grid, side // grid, grid, side // grid, *values.shape[2:]).sum(axis=(1, 3))


def block_difference(a: Column, b: Column, side: int, grid: int = 32) -> Column:
    """The largest mean difference of any of grid x grid blocks, both frames softened by a 3 x 3 box with repeated edges."""
    if side % grid:
        raise ValueError(f"{side} is not a multiple of {grid}")

    def measure(x: np.ndarray, y: np.ndarray) -> float:
        soft = np.pad((x - y).reshape(side, side), 1, mode="edge")  # the box is linear: soften the difference once
        soft = soft[:-2] + soft[1:-1] + soft[2:]
        soft = soft[:, :-2] + soft[:, 1:-1] + soft[:, 2:]
        return _cells(np.abs(soft), grid).max() / (9.0 * (side // grid) ** 2)

    return _of_pairs(side * side, measure)(a, b)


def color_difference(a: Column, b: Column, side: int, grid: int = 8) -> Column:
    """The largest move of a cell's mean colour (blue or red, each without brightness) between two frames of 24-bit BGR."""
    if side % grid:
        raise ValueError(f"{side} is not a multiple of {grid}")

    def measure(x: np.ndarray, y: np.ndarray) -> float:
        moved = _cells((x - y).reshape(side, side, 3), grid) / float((side // grid) ** 2)
        gray = moved @ np.array([0.114, 0.587, 0.299])
        return np.abs(moved[..., [0, 2]] - gray[..., None]).max()

    return _of_pairs(side * side * 3, measure)(a, b)


def detail(frame: Column, side: int) -> Column:
    """The mean step to the next pixel to the right and to the next one down."""

    def run(frames: pd.Series) -> pd.Series:
        out = []
        for f in frames:
            x = _array(f, side * side)
            x = None if x is None else x.reshape(side, side)
            out.append(None if x is None else float((np.abs(np.diff(x, axis=1))[:-1].sum() + np.abs(np.diff(x, axis=0))[:, :-1].sum()) / (side - 1) ** 2))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")(frame)


def detail_kept(a: Column, b: Column) -> Column:
    """How much of the sharper frame's detail the softer one has; 1 if neither has any."""
    return F.when(F.greatest(a, b) <= 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b))


def look_side(*sizes: Column) -> Column:
    """The largest side that all widths and heights reach, 0 if none; null if a size is unknown."""
    least = F.array_min(F.array(*sizes))
    side = F.coalesce(*[F.when(least >= s, s) for s in SIDES], F.lit(0))
    unknown = sizes[0].isNull()
    for s in sizes[1:]:
        unknown = unknown | s.isNull()
    return F.when(~unknown, side)


def _softened(frame: np.ndarray) -> np.ndarray:
    out = np.pad(frame, 1, mode="edge")
    out = (out[:, :-2] + out[:, 1:-1] + out[:, 2:]) / np.float32(3)
    return (out[:-2] + out[1:-1] + out[2:]) / np.float32(3)


def _around(cells: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of each cell; zero beyond the edge."""
    high, wide = cells.shape
    out = np.pad(cells, 1)
    return [out[1 + y : 1 + y + high, 1 + x : 1 + x + wide] for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x]


def difference_mask(a: np.ndarray, b: np.ndarray, sensitivity: float = 0.5) -> np.ndarray:
    """Where two gray frames (height x width) differ in structure, 90 to 230 by how much; 0 elsewhere.

    Brightness and contrast are levelled, both frames and their difference softened; a cell needs two neighbours over the limit.
    """

    def level(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        off = x - np.float32(x.mean(dtype=np.float64))
        spread = np.float32(np.sqrt((off.astype(np.float64) ** 2).mean()))
        return _softened(off / spread if spread >= 1e-4 else np.zeros_like(x))

    limit = np.float32(1.8 - 1.55 * min(max(sensitivity, 0.0), 1.0))
    off = _softened(np.abs(level(a) - level(b)))
    over = off >= limit
    over &= sum(n.astype(int) for n in _around(over)) >= 2
    return np.where(over, 90 + (140 * np.minimum(1, (off - limit) / max(limit, np.float32(1e-3)) / 2)).astype(int), 0)


def mask_boxes(mask: np.ndarray, gap: int = 3, least: int = 4) -> list[tuple[int, int, int, int, int]]:
    """(cells, left, top, right, bottom) of the connected parts of a mask of ``least`` cells or more; boxes ``gap`` or less apart are one."""
    label = np.where(mask > 0, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = np.where(mask > 0, np.maximum.reduce([label, *_around(label)]), 0)
        new = np.where(new > 0, np.append(0, new.ravel())[new], 0)  # a part's label may have grown elsewhere
        if (new == label).all():
            break
        label = new
    boxes = []
    for part in np.unique(label[label > 0]):
        y, x = np.nonzero(label == part)
        if len(y) >= least:
            boxes.append((len(y), x.min(), y.min(), x.max(), y.max()))
    done: list = []
    while boxes:
        n, l, t, r, b = boxes.pop()  # noqa: E741
        near = next((o for o in boxes + done if max(l, o[1]) - min(r, o[3]) - 1 <= gap and max(t, o[2]) - min(b, o[4]) - 1 <= gap), None)
        if near is None:
            done.append((n, l, t, r, b))
        else:
            (boxes if near in boxes else done).remove(near)
            boxes.append((n + near[0], min(l, near[1]), min(t, near[2]), max(r, near[3]), max(b, near[4])))
    return [tuple(map(int, box)) for box in sorted(done, key=lambda o: (-o[0], o[2], o[1]))]


def difference_regions(a: Column, b: Column, width: int, height: int, sensitivity: float = 0.5, most: int = 12, margin: int = 2) -> Column:
    """Boxes (x, y, width, height as shares of the frame) around the ``most`` largest differences of two gray frames, largest first.

    Empty if there are none; null if a frame is null or of another size.
    """

    def regions(x: np.ndarray, y: np.ndarray) -> list[dict[str, float]]:
        out = []
        for _, l, t, r, b in mask_boxes(difference_mask(x.reshape(height, width), y.reshape(height, width), sensitivity))[:most]:  # noqa: E741
            l, t, r, b = max(0, l - margin), max(0, t - margin), min(width - 1, r + margin), min(height - 1, b + margin)  # noqa: E741
            out.append({"x": l / width, "y": t / height, "width": (r - l + 1) / width, "height": (b - t + 1) / height})
        return out

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = ((_array(x, width * height), _array(y, width * height)) for x, y in zip(a, b, strict=True))
        return pd.Series([None if x is None or y is None else regions(x, y) for x, y in pairs], dtype=object)

    return F.pandas_udf(run, "array<struct<x: double, y: double, width: double, height: double>>")(a, b)
