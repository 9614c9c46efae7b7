"""Clips within longer recordings: fingerprints slid along a recording, and frames that agree on one offset."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators import similarity
from kindred.operators.clustering import written

#: Fixed value: how many seconds of a candidate are looked at before its recordings are fetched.
AHEAD = 4


def _ahead(codes: str) -> Column:
    """For each second its code and those of the next ones."""
    return F.transform(codes, lambda x, i: F.slice(codes, i + 1, AHEAD))


_OF_BYTE = np.bitwise_count(np.arange(256, dtype=np.uint8))


def _met_in_cell(key: tuple, t: pa.Table, most: list[int]) -> pa.Table:
    """(source, clip, offset) of a cell's seconds that start ``AHEAD`` alike ones; most[i]: how many bits of i + 1 seconds may differ.

    The cell's number tells the half of the code and the upper byte that its sources have there; clips differ in few bits of it. Sources
    of one lower byte meet the clips that in both bytes differ in no more than half the bits that a second may, code by code.
    """
    half, upper = divmod(key[0].as_py() & 511, 256)
    at = t["at"].to_numpy().astype(np.int64)
    words = np.stack([t["now"].to_numpy(), t["then"].to_numpy()], 1).view(np.uint64)
    code = np.stack([words[:, 0] >> np.uint64(32), words[:, 0], words[:, 1] >> np.uint64(32), words[:, 1]], 1).astype(np.uint32)
    own = np.asarray(t["source"].is_valid())
    value = (code[:, 0] >> np.uint32(16 * half)) & np.uint32(0xFFFF)
    low = (value & np.uint32(0xFF)).astype(np.uint8)
    left = most[0] // 2 - _OF_BYTE[((value >> np.uint32(8)).astype(np.uint8)) ^ np.uint8(upper)].astype(np.int64)
    sources, clips = np.flatnonzero(own), np.flatnonzero(~own)
    sources = sources[np.argsort(low[sources], kind="stable")]
    ends = np.searchsorted(low[sources], np.arange(257))
    length = t["n"].to_numpy().astype(np.int64)
    found = [(np.zeros(0, np.int64),) * 2]
    for byte in np.flatnonzero(np.diff(ends)):
        x = sources[ends[byte] : ends[byte + 1]]
        y = clips[_OF_BYTE[low[clips] ^ np.uint8(byte)] <= left[clips]]
        step = max(1, (1 << 18) // max(1, len(y)))
        for lo in range(0, len(x) if len(y) else 0, step):
            i, j = np.nonzero(np.bitwise_count(code[x[lo : lo + step], 0][:, None] ^ code[y, 0]) <= most[0])
            i, j = x[lo + i], y[j]
            offset = at[i] - at[j]
            near = (offset >= 0) & (offset <= length[i] - length[j])
            total = np.zeros(len(i), np.int64)
            for k in range(AHEAD):
                total += np.bitwise_count(code[i, k] ^ code[j, k])
                near &= (length[j] - at[j] <= k) | (total <= most[k])
            found.append((i[near], j[near]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table({"source": t["source"].take(pa.array(i)), "clip": t["clip"].take(pa.array(j)), "offset": pa.array(at[i] - at[j])})


def _chunks_of(places: DataFrame, room: int) -> list[int]:
    """In how many chunks of about ``room`` rows each of the 512 cells is dealt."""
    out = [1] * 512
    for r in places.groupBy("cell").count().collect():
        out[r["cell"]] = -(-r["count"] // room)
    return out


def clips_within(sources: DataFrame, clips: DataFrame, key: str, codes: str, least: float, room: int = 1_000_000) -> DataFrame:
    """(source, clip, similarity, offset): the best place of each clip in each source, if ``least`` alike; ties to the first place.

    codes is an array of 32-bit codes (as long), one a second. Where the mean similarity is ``least``, there is a second from which on every
    stretch of the clip is that alike on the whole (the one before which most bits beyond the mean differ). One half of its code differs
    in no more than half the bits that a second may, so sources are dealt into cells by the upper byte of each half, clips also into those
    few bits away; cells of many rows in chunks of about ``room``. A task judges its seconds in numpy, together with the three after them, so
    only what they find is a row and has its recordings fetched and compared whole. How many codes are compared still
    grows with sources times clips. Silent rows (all codes zero), empty ones, a row with itself and sources shorter than the clip give nothing.
    """
    most = [int((1 - least) * 32 * seconds + 1e-9) for seconds in range(1, AHEAD + 1)]
    rows = [d.select(F.col(key).alias(k), F.col(codes).alias(f"{k}_codes")).where(F.exists(f"{k}_codes", lambda x: x != 0)) for d, k in ((sources, "source"), (clips, "clip"))]
    flips = [f for f in range(256) if _OF_BYTE[f] <= most[0] // 2]
    places = []
    for d, k in zip(rows, ("source", "clip"), strict=True):
        second = d.select(k, F.size(f"{k}_codes").alias("n"), F.posexplode(_ahead(f"{k}_codes")).alias("at", "next"))
        bits = lambda i: F.coalesce(F.get("next", F.lit(i)), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF))
        cells = [(F.lit(256 * half) + F.shiftrightunsigned(bits(0), 16 * half + 8).bitwiseAND(F.lit(255)).bitwiseXOR(F.lit(f))).cast("int") for half in (0, 1) for f in (flips if k == "clip" else [0])]
        word = lambda i: F.shiftleft(bits(i), 32).bitwiseOR(bits(i + 1))
        places.append(second.select(k, "n", "at", word(0).alias("now"), word(2).alias("then"), F.explode(F.array(*cells)).alias("cell")))
    # chunk p of a cell's sources meets chunk q of its clips
    counts = [_chunks_of(p, room) for p in places]
    of = lambda n: F.get(F.array(*[F.lit(x) for x in n]), F.col("cell")) if max(n) > 1 else F.lit(1)
    dealt = []
    for p, k, mine, others in zip(places, ("source", "clip"), counts, reversed(counts), strict=True):
        p = p.select("*", F.pmod(F.xxhash64(k, "at"), of(mine)).alias("me"), F.explode(F.sequence(F.lit(0), of(others) - 1)).alias("you"))
        a, b = ("me", "you") if k == "source" else ("you", "me")
        dealt.append(p.select(k, "n", "at", "now", "then", (F.col("cell") + F.shiftleft(F.col(a).cast("long"), 9) + F.shiftleft(F.col(b).cast("long"), 36)).alias("cell")))
    both = dealt[0].unionByName(dealt[1], allowMissingColumns=True)
    kind = {k: d.schema[k].dataType.simpleString() for k, d in zip(("source", "clip"), rows, strict=True)}
    # as many tasks as asked for: the rows are few bytes, their comparison is the work
    both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell")
    met = both.groupBy("cell").applyInArrow(lambda key, t: _met_in_cell(key, t, most), f"source {kind['source']}, clip {kind['clip']}, offset long")
    met = written(met.where(F.col("source") != F.col("clip")).select("source", "clip", F.col("offset").cast("int").alias("offset")).distinct(), "met")
    found = met.join(rows[0], "source").join(rows[1], "clip")
    own = F.slice("source_codes", F.col("offset") + 1, F.size("clip_codes"))
    bits = F.aggregate(F.zip_with("clip_codes", own, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    scored = found.select("source", "clip", "offset", (1 - bits / (F.size("clip_codes") * 32)).alias("similarity")).where(F.col("similarity") >= least)
    best = scored.groupBy("source", "clip").agg(F.max(F.struct("similarity", (-F.col("offset")).alias("back"))).alias("best"))
    return best.select("source", "clip", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("offset"))


def dense_matches(frames: DataFrame, file: str, at: str, vector: str, least: float, hits: int = 4, tolerance: float = 30.0) -> DataFrame:
    """(source, clip, similarity, offset, n): files whose frames match at one offset in time.

    frames: a row per file and second, null vectors (dark or repeated frames) match nothing. Of two files the one of
    more rows is the source (ties: the smaller). At least ``hits`` frame matches must lie within ``tolerance`` of the upper
    median of all their offsets; the similarity is their mean cosine. The median comes from a sorted window, so no
    pair of files is held in memory.
    """
    rows = frames.select(F.struct(F.col(file).alias("file"), F.col(at).cast("double").alias("at")).alias("key"), F.col(vector).alias("vector"))
    lengths = frames.groupBy(F.col(file).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    met = similarity.cosine_pairs(rows, "key", "vector", least).where("a_key.file != b_key.file")
    for side in "ab":
        met = met.join(lengths.select(F.col("file").alias(f"{side}_file"), F.col("n").alias(f"{side}_n")), F.col(f"{side}_key.file") == F.col(f"{side}_file"))
    a_first = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_file") < F.col("b_file")))
    pick = lambda x, y: F.when(a_first, x).otherwise(y)
    gap = F.col("a_key.at") - F.col("b_key.at")
    met = met.select(pick(F.col("a_file"), F.col("b_file")).alias("source"), pick(F.col("b_file"), F.col("a_file")).alias("clip"), pick(gap, -gap).alias("gap"), "cosine")
    pair = Window.partitionBy("source", "clip")
    ranked = met.withColumns({"place": F.row_number().over(pair.orderBy("gap", "cosine")), "of": F.count(F.lit(1)).over(pair)})
    middle = F.max(F.when(F.col("place") == F.floor(F.col("of") / 2) + 1, F.col("gap"))).over(pair)
    near = ranked.withColumn("middle", middle).where(F.abs(F.col("gap") - F.col("middle")) <= tolerance)
    out = near.groupBy("source", "clip").agg(F.avg("cosine").alias("similarity"), F.greatest(F.lit(0.0), F.rint(F.first("middle"))).cast("long").alias("offset"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= hits)
