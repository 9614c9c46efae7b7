"""Column expressions on what a probe says of media: choice of streams, languages, quality figures, places of samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import names

#: Codecs of embedded pictures, ranks of HDR formats, extensions.
STILL_CODECS = ["mjpeg", "png", "bmp", "gif", "webp", "tiff"]
HDR_RANK = {"Dolby Vision": 4, "HDR10+": 3, "HDR10": 2, "HLG": 1}
ANIMATED = ["gif", "webp", "apng", "heics"]
TRANSPORT = ["ts", "m2t", "m2ts", "mts"]


def _of_kind(stream: Column, kind: str) -> Column:
    return F.coalesce(F.lower(stream["kind"]) == kind, F.lit(False))


def _numbered(streams: Column) -> Column:
    return F.transform(streams, lambda s, i: F.struct(i.alias("place"), s.alias("s")))


def video_stream(streams: Column) -> Column:
    """Place of the video stream of most pixels (ties: the first); covers only if there is nothing else; null without one.

    A cover is an attached picture, or a still-picture codec beside a moving one.
    """
    still = lambda s: F.coalesce(F.lower(s["codec"]).isin(STILL_CODECS), F.lit(False))
    attached = lambda s: F.coalesce(s["attached"], F.lit(False))
    moving = F.exists(streams, lambda s: _of_kind(s, "video") & ~attached(s) & ~still(s))
    films = F.filter(_numbered(streams), lambda x: _of_kind(x["s"], "video"))
    order = F.transform(films, lambda x: F.struct((attached(x["s"]) | (moving & still(x["s"]))).alias("cover"), (-x["s"]["width"].cast("long") * x["s"]["height"]).alias("pixels"), x["place"].alias("place")))
    return F.array_min(order)["place"]


def audio_stream(streams: Column) -> Column:
    """Place of the audio stream of most channels (ties: the first); null without one."""
    sound = F.filter(_numbered(streams), lambda x: _of_kind(x["s"], "audio"))
    return F.array_min(F.transform(sound, lambda x: F.struct((-x["s"]["channels"]).alias("channels"), x["place"].alias("place"))))["place"]


def languages(streams: Column, kind: str, untagged_too: bool) -> Column:
    """The tracks' languages in order, "?" for one without; empty if none has one, unless ``untagged_too``."""
    codes = F.transform(F.filter(streams, lambda s: _of_kind(s, kind)), lambda s: F.coalesce(names.language_code(s["language"]), F.lit("")))
    told = F.array_join(F.transform(codes, lambda c: F.when(c == "", "?").otherwise(c)), ", ")
    return told if untagged_too else F.when(F.exists(codes, lambda c: c != ""), told).otherwise("")


def merged_languages(cached: Column, probed: Column) -> Column:
    """Languages of cached streams that have none: of the probed stream of the same index (of the same place, without an index), else empty."""
    of_index = lambda i: F.get(F.filter(probed, lambda p: p["index"] == i), F.lit(0))["language"]
    return F.transform(cached, lambda s, i: F.coalesce(s["language"], F.when(s["index"].isNotNull(), of_index(s["index"])).otherwise(F.get(probed, i)["language"]), F.lit("")))


def bits_per_pixel(kilobits: Column, width: Column, height: Column, rate: Column) -> Column:
    """0 if anything is unknown."""
    known = (kilobits > 0) & (rate > 0) & (width > 0) & (height > 0)
    return F.when(known, kilobits * 1000.0 / (width.cast("double") * height * rate)).otherwise(0.0)


def frame_size(text: Column) -> Column:
    """Width plus height of "1920x1080"; 0 if it is no size."""
    return F.coalesce(F.regexp_extract(text, r"^(\d+)x(\d+)$", 1).try_cast("int") + F.regexp_extract(text, r"^(\d+)x(\d+)$", 2).try_cast("int"), F.lit(0))


def hdr_rank(label: Column) -> Column:
    rank = F.lit(0)
    for name, n in sorted(HDR_RANK.items(), key=lambda x: len(x[0])):  # the longest name that begins the label counts
        rank = F.when(F.startswith(label, F.lit(name)), n).otherwise(rank)
    return F.coalesce(rank, F.lit(0))


def positions(n: int) -> list[float]:
    """Where n samples lie in a recording, added up in single precision."""
    step, at, out = np.float32(1.0) / np.float32(n + 1), np.float32(0), []
    for _ in range(n):
        at = np.float32(at + step)
        out.append(float(at))
    return out


def sample_second(duration: Column, cap: float, position: float) -> Column:
    """The second that a position means, of at most ``cap`` seconds (0: no cap)."""
    return (F.least(duration, F.lit(float(cap))) if cap > 0 else duration) * position


def dense_interval(duration: Column) -> Column:
    """Seconds between the frames of a dense row: a sixtieth of the duration between 5 and 15, at most 400 frames."""
    return F.greatest(F.greatest(F.lit(5.0), F.least(F.lit(15.0), duration / 60)), duration / 400)


def bytes_text(size: Column) -> Column:
    """1536 gives 1.5 KB."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for n, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**n, F.concat(F.format_string("%.1f", F.round(size / float(1024**n), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def max_cell(a: Column, b: Column) -> Column:
    """Largest difference of two frames in one place."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def clamped(frame: Column, low: int = 0x20, high: int = 0xF0) -> Column:
    """(frame, ignored): dark and bright places drawn to the bounds, and how many there are."""
    return F.struct(F.transform(frame, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))).alias("frame"), F.size(F.filter(frame, lambda x: (x <= low) | (x >= high))).alias("ignored"))


def _pixels(rgb: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(rgb) / 3).cast("int") - 1), lambda i: F.slice(rgb, i * 3 + 1, 3))


def rgb_bright_enough(rgb: Column, percent: int = 80) -> Column:
    """Usable if less than ``percent`` of the pixels are dark in all three colours."""
    dark = F.size(F.filter(_pixels(rgb), lambda p: F.array_max(p) <= 0x20))
    return F.when(F.size(rgb) >= 3, dark * 100 / F.floor(F.size(rgb) / 3) < percent).otherwise(F.lit(False))


def colorfulness(rgb: Column) -> Column:
    """Mean distance of the pixels from gray: the length of blue and red less the luma."""

    def length(p: Column) -> Column:
        y = p[0] * 0.299 + p[1] * 0.587 + p[2] * 0.114
        return F.sqrt((p[2] - y) * (p[2] - y) + (p[0] - y) * (p[0] - y))

    return F.when(F.size(rgb) >= 3, F.aggregate(F.transform(_pixels(rgb), length), F.lit(0.0), lambda s, x: s + x) / F.floor(F.size(rgb) / 3)).otherwise(0.0)


def keeps_colors(a: Column, b: Column, gray_below: float = 3.0, least: float = 0.5) -> Column:
    """Both are gray, or the less colourful one keeps ``least`` of the other's colourfulness (both given)."""
    most = F.greatest(a, b)
    return (most < gray_below) | (F.least(a, b) / most >= least)


def chroma_code(chroma: Column) -> Column:
    """32 bits of twelve notes: is a note stronger than its neighbour, than that three up, than that six up (the first eight)."""
    pairs = [(i, (i + 1) % 12) for i in range(12)] + [(i, (i + 3) % 12) for i in range(12)] + [(i, (i + 6) % 12) for i in range(8)]
    return sum((F.when(chroma[x] > chroma[y], F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")) for n, (x, y) in enumerate(pairs)), F.lit(0).cast("long"))
