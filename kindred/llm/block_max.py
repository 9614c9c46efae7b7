"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

Documents are dealt into shards of about ``shard``; a shard holds, for each term, posting blocks of ``block`` postings:
variable-byte gaps and frequencies, and beside them, uncompressed, the first and last document and the largest impact.
Within a shard a search never walks posting by posting. The pointers of all lists move together, shallowly, from block end to block
end; between two ends the sum of the current blocks' maxima is the bound of every document there. Stretches whose bound is below the
threshold (the k-th best score so far) are skipped before anything is decompressed; the others are scored in full, those of
the highest bounds first, which raises the threshold for the rest.

A search takes two rounds: some shards first, then all others with the thresholds that the first have given. Items are
dealt to shards in batches, so a task holds a shard and a batch. Terms that no item asks for are left out of
the index by a filter of fixed size; what it lets through by chance is never looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import forget, written

#: The bytes of terms, which are ASCII letters and digits and all that is not ASCII.
_TERM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def terms(data: np.ndarray, offsets: np.ndarray) -> ta.Spans:
    """Spans of the terms of all texts, A-Z lower-cased."""
    n = len(offsets) - 1
    data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return ta.Spans(data, start, end, doc, np.searchsorted(doc, np.arange(n + 1)))


def strings(spans: ta.Spans, at: np.ndarray) -> pa.Array:
    size = spans.end[at] - spans.start[at]
    offsets = np.concatenate([[0], np.cumsum(size)])
    chars = spans.data[np.arange(offsets[-1]) + np.repeat(spans.start[at] - offsets[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(chars))).cast(pa.string())


def counted(batches: Iterator[pa.RecordBatch], asked: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (no, id, n, term, tf): a row without a term for each text that has terms, and one for each asked term in it.

    ``no`` tells the rows of a table apart once they are written.
    """
    no = TaskContext.get().partitionId() << 33
    for batch in batches:
        data, offsets = ta.flat(batch.column(1))
        for lo, hi in ta.slices(offsets):
            spans = terms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            hashes = spans.hashes()
            n = np.diff(spans.first)
            at = np.arange(len(hashes)) if asked is None else np.flatnonzero(_holds(asked, hashes))
            order = at[np.lexsort((hashes[at], spans.doc[at]))]
            new = np.ones(len(order), bool)
            new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (spans.doc[order][1:] != spans.doc[order][:-1])
            first = np.flatnonzero(new)
            own, head = spans.doc[order[first]], np.flatnonzero(n)
            doc = np.concatenate([head, own])
            found = pa.concat_arrays([pa.nulls(len(head), pa.string()), strings(spans, order[first])])
            tf = np.concatenate([np.zeros(len(head), np.int64), np.diff(np.append(first, len(order)))])
            ids = batch.column(0).slice(lo, hi - lo).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([pa.array(no + doc), ids, pa.array(n[doc]), found, pa.array(tf)], names=["no", "id", "n", "term", "tf"])
            no += hi - lo


COUNTED = "no long, id long, n long, term string, tf long"


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for i in range(4):
        yield ta.mix(hashes + np.uint64(i)) % np.uint64(bits)


def _holds(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for p in _probes(hashes, len(words) * 64):
        out &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def asked_filter(queries: DataFrame, bits: int) -> np.ndarray:
    """The terms of all queries as a Bloom filter of ``bits`` bits, whatever their number: fuller ones let more through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            data, offsets = ta.flat(batch.column(0))
            spans = ta.Spans(data, offsets[:-1], offsets[1:], np.arange(len(offsets) - 1), np.arange(len(offsets)))
            for p in _probes(spans.hashes(), bits):
                np.bitwise_or.at(words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["at", "bits"])

    found = queries.select("term").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of 0 or more in 7-bit groups, low ones first, the last one of a value without the high bit; and the bytes of each."""
    size = 1 + sum((values >= 1 << (7 * k)).astype(np.int64) for k in range(1, 9))
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[start[own] + k] = ((values[own] >> (7 * k)) & 127) | np.where(size[own] > k + 1, 128, 0)
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    start = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(data)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), start) if len(last) else last


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


INDEX = "shard int, term string, first array<int>, last array<int>, most array<int>, n array<int>, bytes array<int>, postings binary, ids array<long>, m array<long>"


def _lists(values: np.ndarray | pa.Array, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def indexed(shard: int, rows: pa.Table, total: int, length: int, block: int) -> pa.Table:
    """The index rows of a shard: one for its documents (their ids and lengths' weights m, in order of the ids), one for each term."""
    rows = rows.sort_by([("id", "ascending"), ("no", "ascending")])  # rows without an id come last
    no, n = np.asarray(rows["no"]), np.asarray(rows["n"])
    new = np.ones(len(no), bool)
    new[1:] = no[1:] != no[:-1]
    local, at = np.cumsum(new) - 1, np.flatnonzero(new)
    sizes, back = np.unique(n[at], return_inverse=True)
    m = np.array([25 + 75 * int(x) * total // length for x in sizes], np.int64)[back]
    code = rows["term"].combine_chunks().dictionary_encode()
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    own = np.flatnonzero(np.asarray(code.indices.is_valid()))
    term = np.asarray(code.indices.fill_null(-1))[own]
    order = np.lexsort((local[own], term))
    term, doc, tf = term[order], local[own][order], np.asarray(rows["tf"])[own][order]

    head = np.ones(len(term), bool)
    head[1:] = term[1:] != term[:-1]
    begins = np.flatnonzero(head)
    within = np.arange(len(term)) - np.repeat(begins, np.diff(np.append(begins, len(term))))
    starts = np.flatnonzero(within % block == 0)
    gap = np.diff(doc, prepend=0)
    gap[starts] = 0
    data, size = packed(np.stack([gap, tf], 1).ravel())
    ends = np.append(starts[1:], len(term)) if len(starts) else starts
    nbytes = np.add.reduceat(size, 2 * starts) if len(starts) else starts
    most = np.maximum.reduceat(impact(tf, m[doc]), starts) if len(starts) else starts
    cuts = np.searchsorted(starts, np.append(begins, len(term)))  # blocks of each term
    at_byte = np.concatenate([[0], np.cumsum(nbytes)])[cuts]
    k = len(begins)
    column = lambda v: pa.concat_arrays([_lists(pa.array(v.astype(np.int32)), cuts), pa.array([[]], pa.list_(pa.int32()))])
    names = code.dictionary.take(pa.array(term[begins])) if k else pa.array([], pa.string())
    postings = [data[a:b].tobytes() for a, b in zip(at_byte[:-1], at_byte[1:], strict=True)]
    nothing = pa.array([[]] * k, pa.list_(pa.int64()))
    documents = lambda v: pa.concat_arrays([nothing, _lists(v, np.array([0, len(at)]))])
    columns = [
        pa.array(np.full(k + 1, shard, np.int32)), pa.concat_arrays([names.cast(pa.string()), pa.nulls(1, pa.string())]), column(doc[starts]), column(doc[ends - 1]), column(most), column(ends - starts), column(nbytes),
        pa.array([*postings, b""], pa.binary()), documents(rows["id"].combine_chunks().take(pa.array(at))), documents(m),
    ]
    return pa.Table.from_arrays(columns, names=["shard", "term", "first", "last", "most", "n", "bytes", "postings", "ids", "m"])


class Shard:
    """The index rows of a shard, and those of its blocks that have been decompressed."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        col = lambda c: rows[c].chunk(0) if rows[c].num_chunks else rows[c].combine_chunks()
        flat = lambda c: np.asarray(col(c).flatten()).astype(np.int64)
        size = np.asarray(pa.compute.list_value_length(col("first"))).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(size)])
        self.of = {t: (int(cuts[i]), int(cuts[i + 1])) for i, t in enumerate(rows["term"].to_pylist()) if t is not None}
        self.first, self.last, self.most = flat("first"), flat("last"), flat("most")
        self.ids, self.m = col("ids").flatten(), flat("m")
        self.post = np.concatenate([[0], np.cumsum(flat("n"))])
        self.byte = np.concatenate([[0], np.cumsum(flat("bytes"))])
        self.data = np.frombuffer(b"".join(rows["postings"].to_pylist()), np.uint8)
        self.open = np.zeros(len(self.first), bool)
        self.doc, self.impact = np.zeros(self.post[-1], np.int32), np.zeros(self.post[-1], np.int64)

    def _spread(self, cuts: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        n = cuts[blocks + 1] - cuts[blocks]
        return np.arange(n.sum()) + np.repeat(cuts[blocks] - (np.cumsum(n) - n), n)

    def decompress(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.open[blocks]]
        if len(blocks):
            gap, tf = unpacked(self.data[self._spread(self.byte, blocks)]).reshape(-1, 2).T
            n = self.post[blocks + 1] - self.post[blocks]
            total = np.cumsum(gap)
            doc = total + np.repeat(self.first[blocks] - total[np.cumsum(n) - n], n)
            at = self._spread(self.post, blocks)
            self.doc[at], self.impact[at] = doc, impact(tf, self.m[doc])
            self.open[blocks] = True

    def top(self, asked: list[str], weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Local numbers and scores of the k best documents of at least ``least``, equal scores by number."""
        spans = [(*self.of[t], w) for t, w in zip(asked, weights, strict=True) if t in self.of and w > 0]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = np.concatenate([np.arange(lo, hi) for lo, hi, _ in spans])
        weight = np.repeat([w for *_, w in spans], [hi - lo for lo, hi, _ in spans])
        first, after = self.first[blocks], self.last[blocks] + 1
        # between two edges no pointer moves, so the blocks there bound all documents
        edges = np.unique(np.concatenate([first, after]))
        lo, hi = np.searchsorted(edges, first), np.searchsorted(edges, after)
        move = np.zeros(len(edges), np.int64)
        np.add.at(move, lo, weight * self.most[blocks])
        np.subtract.at(move, hi, weight * self.most[blocks])
        bound = np.cumsum(move)[:-1]
        order = np.argsort(-bound, kind="stable")
        width = np.cumsum(np.diff(edges)[order])
        found, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least, done, reach = max(1, least), 0, 64
        while True:
            # the stretches that may still hold one of the best, in turns of twice as many documents
            end = min(int(np.searchsorted(-bound[order], -least, "right")), max(done + 1, int(np.searchsorted(width, (width[done - 1] if done else 0) + reach, "right"))))
            if end <= done:
                return found, score
            chosen = np.zeros(len(edges), bool)
            chosen[order[done:end]] = True
            before = np.concatenate([[0], np.cumsum(chosen)])
            met = np.flatnonzero(before[hi] > before[lo])
            self.decompress(blocks[met])
            at = self._spread(self.post, blocks[met])
            n = self.post[blocks[met] + 1] - self.post[blocks[met]]
            doc = self.doc[at]
            inside = chosen[np.searchsorted(edges, doc, "right") - 1]
            total = np.zeros(len(self.m), np.int64)
            np.add.at(total, doc[inside], (np.repeat(weight[met], n) * self.impact[at])[inside])
            new = np.flatnonzero(total >= least)
            found, score = np.concatenate([found, new]), np.concatenate([score, total[new]])
            best = np.lexsort((found, -score))[:k]
            found, score = found[best], score[best]
            if len(found) == k:
                least = int(score[-1])
            done, reach = end, 2 * reach


class BlockMax:
    """The ``k`` best documents for each item; see the module's text.

    Every row of documents that has a term is a document of its own, also where doc_ids repeat; null texts have no
    terms. Rows without a doc_id are counted and ranked, after equal scores with one. Every row of items is asked, also
    where item_ids repeat; null texts and terms that no document holds find nothing. Terms of one text are
    told apart by 64-bit hashes, over all texts by themselves. Empty tables give no rows; other columns are
    ignored. ``filter_bits`` is the size of the filter of asked terms, ``items`` the most items that a task asks at once.
    """

    def __init__(self, k: int = 10, shard: int = 4096, block: int = 128, items: int = 4096, filter_bits: int = 1 << 22, first: int = 16):
        self.k, self.shard, self.block, self.items, self.filter_bits, self.first = k, shard, block, items, filter_bits, first

    def build(self, docs: DataFrame, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int, int] | None:
        """The written index, (term, df), the number of documents and of shards. ``asked`` (term) limits it to those terms."""
        words = None if asked is None else asked_filter(asked, self.filter_bits)
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
        postings = written(rows.mapInArrow(lambda batches: counted(batches, words), COUNTED), "postings")
        total, length = postings.where("term is null").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not total:
            forget(postings)
            return None
        shards, block = -(-total // self.shard), self.block
        build = lambda key, t: indexed(key[0].as_py(), t, total, length, block)
        dealt = postings.withColumn("shard", F.pmod(F.xxhash64("no"), F.lit(shards)).cast("int"))
        index = written(dealt.groupBy("shard").applyInArrow(build, INDEX), "index")
        df = written(postings.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
        forget(postings)
        return index, df, total, shards

    def _met(self, index: DataFrame, queries: DataFrame, batches: int, lo: int, hi: int) -> DataFrame:
        """(no, item_id, doc_id, score): the best of each of the shards from ``lo`` to ``hi``."""
        k = self.k

        def judge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            no, item, ids, scores = [], [], [], []
            shard = Shard(left) if left.num_rows and right.num_rows else None
            for i in range(right.num_rows if shard else 0):
                found, score = shard.top(right["terms"][i].as_py(), np.asarray(right["weights"][i].values), k, right["least"][i].as_py())
                no.append(np.full(len(found), right["no"][i].as_py()))
                item += [right["item_id"][i].as_py()] * len(found)
                ids.append(shard.ids.take(pa.array(found)))
                scores.append(score)
            none = np.zeros(0, np.int64)
            return pa.table({"no": pa.array(np.concatenate([none, *no])), "item_id": pa.array(item, pa.int64()), "doc_id": pa.concat_arrays([pa.array([], pa.int64()), *ids]), "score": pa.array(np.concatenate([none, *scores]))})

        shards = index.where((F.col("shard") >= lo) & (F.col("shard") < hi)).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
        dealt = queries.withColumn("shard", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
        return shards.groupBy("shard", "batch").cogroup(dealt.groupBy("shard", "batch")).applyInArrow(judge, "no long, item_id long, doc_id long, score long")

    def search(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        """item_id, rank, doc_id, score for the rows of items (item_id, text) over those of docs (doc_id, text)."""
        rows = items.select(F.col("item_id").cast("long").alias("id"), F.col("text").alias("text"))
        asked = written(rows.mapInArrow(lambda batches: counted(batches, None), COUNTED).where("term is not null"), "asked")
        built = self.build(docs, asked)
        if built is None:
            forget(asked)
            return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        index, df, total, shards = built
        weight = F.floor(F.lit(1000.0) * F.log((2.0 * F.lit(total) + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
        known = asked.join(df, "term").withColumn("weight", F.col("tf") * weight)
        known = known.groupBy("no").agg(F.first("id").alias("item_id"), F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("of"))
        queries = written(known.select("no", "item_id", F.col("of.term").alias("terms"), F.col("of.weight").alias("weights")), "queries")
        batches = max(1, -(-queries.count() // self.items))
        queries_ = queries.withColumn("batch", F.pmod(F.xxhash64("no"), F.lit(batches)).cast("int"))
        rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = lambda found: found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= self.k)
        some = -(-shards // self.first)
        first = written(ranked(self._met(index, queries_.withColumn("least", F.lit(1).cast("long")), batches, 0, some)), "first")
        best = first
        if some < shards:
            kth = first.where(F.col("rank") == self.k).select(F.col("no").alias("_no"), F.col("score").alias("least"))
            more = queries_.join(kth, F.col("no") == F.col("_no"), "left").select(*queries_.columns, F.coalesce("least", F.lit(1)).alias("least"))
            best = written(ranked(self._met(index, more, batches, some, shards).unionByName(first.drop("rank"))), "best")
            forget(first)
        forget(asked, index, df, queries)
        return best.select("item_id", "rank", "doc_id", "score")
