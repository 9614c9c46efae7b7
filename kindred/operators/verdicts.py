"""Verdicts on pairs of items that were sampled at several positions: gray frames, perceptual hashes, embeddings, or all of them.

An item has, per position, a frame (array of bytes), a 64-bit hash and an embedding (int8 components, null where there is
none). All verdicts are columns on ``a_`` and ``b_`` sides of a pair, so they run inside whatever join makes the pairs.
Limits are worked out in single precision, as the thresholds are stated in it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import signal
from kindred.operators import clustering, similarity


@dataclass(frozen=True)
class Settings:
    """percent: least similarity of frames and hashes; ai_percent: least mean cosine; quorum: share of positions whose hashes must pass."""

    percent: float = 96.0
    ai_percent: float = 95.0
    quorum: float = 0.6
    use_hashes: bool = False
    combine: bool = False
    use_ai: bool = True
    ignore_dark: bool = False
    ignore_bright: bool = False

    @property
    def most_difference(self) -> float:
        return float(np.float32(1) - np.float32(self.percent) / np.float32(100))

    @property
    def most_bits(self) -> int:
        """How many of 64 bits may differ."""
        return math.floor(float((np.float32(1) - np.float32(self.percent) / np.float32(100)) * np.float32(64)))

    def required(self, n: int) -> int:
        """How many of n positions must pass."""
        return max(1, math.ceil(float(np.float32(n) * np.float32(min(max(self.quorum, 0.01), 1.0)))))


def usable(frames: Column, size: int, positions: int) -> Column:
    """Every position has a frame of the right size; else the item is not compared."""
    return (F.size(frames) == positions) & F.forall(frames, lambda f: f.isNotNull() & (F.size(f) == size))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def gray_difference(a: Column, b: Column, s: Settings) -> Column:
    """Difference of two frames; null if no pixel is left to compare."""
    if s.ignore_dark or s.ignore_bright:
        return signal.gray_difference_ignoring(a, b, s.ignore_dark, s.ignore_bright)
    return signal.gray_difference(a, b)


def gray_positions(a: Column, b: Column, s: Settings) -> Column:
    """Mean difference over all positions where it is within the limit, else null."""
    each = F.zip_with(a, b, lambda x, y: gray_difference(x, y, s))
    mean = _total(each) / F.size(a)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (_total(each) <= F.lit(s.most_difference) * F.size(a)), mean)


def hash_similarity(a: Column, b: Column) -> Column:
    """1 - bits / 64."""
    return 1 - signal.hamming(a, b) / F.lit(64.0)


def hash_quorum(a: Column, b: Column, positions: int, s: Settings) -> Column:
    """Mean dissimilarity over all positions if enough of them pass, else null."""
    bits = F.zip_with(a, b, lambda x, y: signal.hamming(x, y))
    passed = F.size(F.filter(bits, lambda x: x <= s.most_bits))
    mean = F.aggregate(bits, F.lit(0), lambda t, x: t + x) / F.lit(64.0) / F.size(bits)
    return F.when((F.size(a) == positions) & (F.size(b) == positions) & (passed >= s.required(positions)), mean)


def ai_similarity(a: Column, b: Column) -> Column:
    """Mean cosine over the positions that both have; -1 (no opinion) if these are under half of them."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), signal.cosine_int8(x, y))), lambda c: c.isNotNull())
    n = F.least(F.size(a), F.size(b))
    need = F.greatest(F.lit(1), F.floor((n + 1) / 2))
    return F.when(F.size(both) >= need, _total(both) / F.size(both)).otherwise(F.lit(-1.0))


@dataclass(frozen=True)
class Verdict:
    """Columns: difference (null: no match), by_gray, by_hash, by_ai."""

    difference: Column
    by_gray: Column
    by_hash: Column
    by_ai: Column

    def columns(self, prefix: str = "") -> list[Column]:
        return [self.difference.alias(f"{prefix}difference"), *(F.coalesce(c, F.lit(False)).alias(f"{prefix}{n}") for c, n in ((self.by_gray, "by_gray"), (self.by_hash, "by_hash"), (self.by_ai, "by_ai")))]


def classic(a: dict[str, Column], b: dict[str, Column], image: Column, positions: int, s: Settings) -> Verdict:
    """Images by their one frame; else by frames, by hashes, or by whichever of both matches (the smaller difference).

    a and b have frames and hashes. Which of the two matched is told in the combined mode only.
    """
    gray_one = gray_difference(a["frames"][0], b["frames"][0], s)
    picture = F.when(gray_one <= s.most_difference, gray_one)
    gray, hashes = gray_positions(a["frames"], b["frames"], s), hash_quorum(a["hashes"], b["hashes"], positions, s)
    film = F.least(gray, hashes) if s.combine else hashes if s.use_hashes else gray  # least passes over nulls
    told = F.lit(s.combine)
    return Verdict(F.when(image, picture).otherwise(film), told & F.when(image, picture.isNotNull()).otherwise(gray.isNotNull()), told & ~image & hashes.isNotNull(), F.lit(False))


def union(a: dict[str, Column], b: dict[str, Column], image: Column, positions: int, s: Settings) -> Verdict:
    """The classic verdict, or else that of the embeddings."""
    first = classic(a, b, image, positions, s)
    if not s.use_ai:
        return first
    cosine = ai_similarity(a["vectors"], b["vectors"])
    by_ai = first.difference.isNull() & (cosine >= float(np.float32(s.ai_percent) / np.float32(100)))
    return Verdict(F.when(first.difference.isNotNull(), first.difference).when(by_ai, 1 - cosine), first.by_gray, first.by_hash, by_ai)


def with_flips(a: dict[str, Column], b: dict[str, Column], image: Column, positions: int, side: int, s: Settings) -> tuple[Verdict, Column]:
    """The better of the verdict as it is and of the classic one with a's frames mirrored; whether it is the mirrored one.

    ``a["mirrored_hashes"]`` are the hashes of its mirrored frames. The embeddings have no part in the mirrored verdict, and
    where that one is better their flag goes.
    """
    plain = union(a, b, image, positions, s)
    mirrored = classic(a | {"frames": F.transform(a["frames"], lambda f: signal.flipped(f, side)), "hashes": a["mirrored_hashes"]}, b, image, positions, s)
    flipped = mirrored.difference.isNotNull() & (plain.difference.isNull() | (mirrored.difference < plain.difference))
    pick = lambda x, y: F.when(flipped, y).otherwise(x)
    return Verdict(F.least(plain.difference, mirrored.difference), pick(plain.by_gray, mirrored.by_gray), pick(plain.by_hash, mirrored.by_hash), ~flipped & plain.by_ai), flipped


def pairs(items: DataFrame, positions: int, side: int, s: Settings, flips: bool = False) -> DataFrame:
    """(a_key, b_key, difference, by_gray, by_hash, by_ai) of all items that match; with ``flips`` also ``flipped``.

    items: key, image, frames, hashes and vectors (unit vectors, null where there is none) at ``positions``, and with flips and hashes
    mirrored_hashes. Frames meet whole, all positions of an item at once, and so do embeddings that crowd, so a pair is a row only if it
    matches, with its value; hashes, and embeddings where single positions tell most items apart, meet by lossless joins of positions.
    With flips, each item stands in these joins a second time, mirrored, and meets the plain ones of larger keys; the smaller difference
    of the two verdicts counts.
    """
    # read several times below, so its lineage is cut
    mirrored = [F.col("mirrored_hashes")] if flips and "mirrored_hashes" in items.columns else [F.lit(None).cast("array<bigint>").alias("mirrored_hashes")]
    items = clustering.written(items.where(usable(F.col("frames"), side * side, positions) & F.col("image").isNotNull()).select("key", "image", "frames", "hashes", "vectors", *mirrored), "items")
    own_key = lambda m: F.struct("key", F.lit(m).alias("mirrored")).alias("key")
    turn = lambda c: F.transform(c, lambda f: signal.flipped(f, side))
    none = F.lit(None).cast("double")
    # a pair that hashes match is no row of those of frames, and one that either matches none of those of embeddings: so no pair is a row
    # twice, and results, which may grow with the square of the items, are not brought together
    parted = not (flips or s.ignore_dark or s.ignore_bright or (s.use_hashes and not s.combine))

    def told(found: DataFrame, value: Column, name: str, image: bool | Column, gray: Column | None = None) -> DataFrame:
        """Keys are structs that begin with the item's key, so a_key is the smaller item's; of the two only that may be mirrored."""
        m = F.col("a_key.mirrored")
        each = {"gray": F.when(~m, value) if name == "gray" else none if gray is None else gray, "hash": F.when(~m, value) if name == "hash" else none, "ai": value if name == "ai" else none}
        each |= {"mirrored_gray": F.when(m, value) if name == "gray" else none, "mirrored_hash": F.when(m, value) if name == "hash" else none}
        found = found.where("a_key.key <> b_key.key and not b_key.mirrored")
        return found.select(F.col("a_key.key").alias("a_key"), F.col("b_key.key").alias("b_key"), F.lit(image).alias("image"), *[v.cast("double").alias(c) for c, v in each.items()])

    found = []
    for image in (True, False):
        if not image and s.use_hashes and not s.combine:
            continue
        rows = items.where(F.col("image") if image else ~F.col("image"))
        whole = (lambda c: c[0]) if image else F.flatten
        frames = rows.select(own_key(False), whole(F.col("frames")).alias("value"))
        if flips:
            frames = frames.unionByName(rows.select(own_key(True), whole(turn(F.col("frames"))).alias("value")))
        # the limit of one frame is tested on the value, as it is stated on it
        limit = s.most_difference * (1 + 1e-9) + 1e-12 if image else s.most_difference
        if parted and s.combine and not image:
            coded = rows.select(own_key(False), F.flatten("frames").alias("value"), "hashes")
            near = similarity.gray_and_codes(coded, "key", "value", "hashes", side * side * positions, limit, positions, s.most_bits, s.required(positions))
        else:
            near = similarity.gray_pairs(frames, "key", "value", side, limit, s.ignore_dark, s.ignore_bright, 1 if image else positions)
        found.append(told(near.where(F.col("difference") <= s.most_difference) if image else near, F.col("difference"), "gray", image))
    if s.use_hashes or s.combine:
        films = items.where("not image")
        hashes = films.select(own_key(False), F.col("hashes").alias("h"), *([F.col("frames").alias("f")] if parted else []))
        if flips:
            hashes = hashes.unionByName(films.select(own_key(True), F.col("mirrored_hashes").alias("h")))
        codes = hashes.select("key", F.posexplode("h").alias("place", "value")).select(F.struct("key.key", "key.mirrored", "place").alias("key"), "value")
        met = similarity.hamming_pairs(codes, "key", "value", s.most_bits).where("a_key.place = b_key.place and a_key.key <> b_key.key and not b_key.mirrored")
        met = met.select(*[F.struct(F.col(f"{x}_key.key").alias("key"), F.col(f"{x}_key.mirrored").alias("mirrored")).alias(f"{x}_key") for x in "ab"]).distinct()
        for x in "ab":
            met = met.join(hashes.select(*[F.col(c).alias(f"{x}_{c}") for c in hashes.columns]), f"{x}_key")
        met = met.withColumn("mean", hash_quorum(F.col("a_h"), F.col("b_h"), positions, s)).where("mean is not null")
        found.append(told(met, F.col("mean"), "hash", False, gray_positions(F.col("a_f"), F.col("b_f"), s) if parted else None))
    if s.use_ai:
        least = float(np.float32(s.ai_percent) / np.float32(100))
        vectors = items.select(F.struct("key", F.lit(False).alias("mirrored")).alias("key"), "image", "vectors", F.when(F.col("image"), F.col("frames")[0]).otherwise(F.flatten("frames")).alias("frames"), "hashes")
        single = vectors.select("key", "image", F.posexplode("vectors").alias("place", "value")).select(F.struct("key", "place", "image").alias("key"), "value")
        if similarity.cosines_told_apart(single, "key", "value", least - 1e-6):
            met = similarity.cosine_pairs(single, "key", "value", least - 1e-6).where("a_key.place = b_key.place and a_key.image = b_key.image")
            met = met.select(F.col("a_key.key").alias("a_key"), F.col("b_key.key").alias("b_key")).distinct()
            own = items.select("key", "image", F.transform("vectors", signal.quantised).alias("vectors"), *(["frames", "hashes"] if parted else []))
            for x in "ab":
                columns = [F.col(c).alias(f"{x}_{c}") for c in own.columns if c != "key"]
                met = met.join(own.select(F.struct("key", F.lit(False).alias("mirrored")).alias(f"{x}_key"), *columns), f"{x}_key")
            met = met.withColumn("cosine", ai_similarity(F.col("a_vectors"), F.col("b_vectors"))).where(F.col("cosine") >= least)
            if parted:
                sides = [{c: F.col(f"{x}_{c}") for c in ("frames", "hashes")} for x in "ab"]
                met = met.where(classic(*sides, F.col("a_image"), positions, s).difference.isNull())
            met = met.select("a_key", "b_key", F.col("a_image").alias("image"), "cosine")
            found.append(told(met, F.col("cosine"), "ai", F.col("image")))
        else:
            for image in (True, False):
                own, coded = vectors.where(F.col("image") == image), s.combine and not image
                if parted and coded:
                    own = own.withColumn("frames", F.concat(F.col("frames").cast("array<long>"), similarity.worded(F.col("hashes"), positions)))
                unless = ("frames", s.most_difference, 1 if image else positions, (s.most_bits, s.required(positions), positions) if coded else None) if parted else None
                near = similarity.mean_cosine_pairs(own, "key", "vectors", "image", least, unless=unless)
                found.append(told(near, F.col("cosine"), "ai", image))
    met = reduce(DataFrame.unionByName, found)
    if (len(found) > 2 or flips) and not parted:
        met = met.groupBy("a_key", "b_key", "image").agg(*[F.max(c).alias(c) for c in ("gray", "hash", "ai", "mirrored_gray", "mirrored_hash")])
    combined = F.lit(s.combine)

    def verdict(gray: Column, hashes: Column, ai: Column | None) -> Verdict:
        film = F.least(gray, hashes) if s.combine else hashes if s.use_hashes else gray
        first = F.when(F.col("image"), gray).otherwise(film)
        by_ai = first.isNull() & ai.isNotNull() if ai is not None else F.lit(False)
        out = F.when(first.isNotNull(), first).when(by_ai, 1 - ai) if ai is not None else first
        return Verdict(out, combined & gray.isNotNull(), combined & ~F.col("image") & hashes.isNotNull(), by_ai)

    plain = verdict(F.col("gray"), F.col("hash"), F.col("ai") if s.use_ai else None)
    if not flips:
        return met.select("a_key", "b_key", *plain.columns()).where("difference is not null")
    other = verdict(F.col("mirrored_gray"), F.col("mirrored_hash"), None)
    flipped = other.difference.isNotNull() & (plain.difference.isNull() | (other.difference < plain.difference))
    pick = lambda x, y: F.when(flipped, y).otherwise(x)
    v = Verdict(F.least(plain.difference, other.difference), pick(plain.by_gray, other.by_gray), pick(plain.by_hash, other.by_hash), ~flipped & plain.by_ai)
    return met.select("a_key", "b_key", *v.columns(), F.coalesce(flipped, F.lit(False)).alias("flipped")).where("difference is not null")


def hard_link(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """One file under two names: equal size, duration, volume and inode."""
    return (a["size"] == b["size"]) & a["duration"].eqNullSafe(b["duration"]) & (a["volume"] == b["volume"]) & (a["inode"] == b["inode"])


def sample_times(source: Column, clip: Column, prints: Column, offset: Column) -> Column:
    """Where in the overlap of a clip (at ``offset`` in its source, all in seconds) frames are looked at: one, two or three places.

    ``prints`` is the length of the clip's sound, 0 if unknown; places within a tenth of a second of either's end are left out.
    """
    window = F.least(clip, source - offset, F.when(prints > 0, prints))
    at = F.when(window >= 9, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).when(window >= 3, F.array(F.lit(0.33), F.lit(0.66))).otherwise(F.array(F.lit(0.5)))
    times = F.filter(F.transform(at, lambda f: window * f), lambda t: (t < clip - 0.1) & (offset + t < source - 0.1))
    return F.when(window > 0, times).otherwise(F.array().cast("array<double>"))


def visual_gate(overlap: Column, similarities: Column, least: float = 0.85) -> Column:
    """Do the frames agree: no without an overlap, yes where no frames are, else by their mean similarity."""
    there = F.filter(similarities, lambda x: x.isNotNull())
    return F.when(overlap <= 0, F.lit(False)).when(F.size(there) == 0, F.lit(True)).otherwise(_total(there) / F.size(there) >= least)


def sign_bound(dimensions: int, cosine: float, sigmas: float = 4.6) -> int:
    """How many sign bits of ``dimensions`` two vectors of at least that cosine differ in, but for so many standard deviations."""
    p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    return math.ceil(dimensions * p + sigmas * math.sqrt(dimensions * p * (1 - p)))


def explained(pairs: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """The pairs with each gate as a column and ``stopped_by``, the first one that does not let them through."""
    told = {name: F.coalesce(gate, F.lit(False)) for name, gate in gates.items()}
    return pairs.withColumns(told).withColumn("stopped_by", F.coalesce(*[F.when(~F.col(name), F.lit(name)) for name in told]))
