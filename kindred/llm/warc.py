"""WARC archives with Zstandard: writer and reader, one frame per record, the dictionary in front.

An archive begins with a skippable frame whose content is the dictionary (plain or compressed itself); then
each record is one frame. The writer rolls over to a new archive after about ``ARCHIVE`` bytes, so that a
reader's task holds one bounded archive. Files are written whole under a name that depends on the
partition only: a task that runs again puts the same file in place.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

ARCHIVE, SAMPLE, DICTIONARY = 16 << 20, 200, 64 << 10
#: The skippable frame's magic, the version line, the profile of a revisit by payload.
MAGIC, VERSION = 0x184D2A5D, b"WARC/1.1"
FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = uuid.UUID("5f0c4a5e-6d0e-4a51-9a53-0f2d6f8b7c11")


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_ID, name)}>"


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version, headers, Content-Length, block, two line ends. Line ends in values become spaces."""
    lines = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; raises WarcError if anything is amiss."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    if not mark:
        raise WarcError("no end of headers")
    lines = head.decode("utf-8").split("\r\n")
    if not re.fullmatch(r"WARC/\d+\.\d+", lines[0]):
        raise WarcError(f"no version line: {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise WarcError(f"no header: {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    if not re.fullmatch(r"[0-9]+", headers["content-length"]) or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {headers['content-length']} but {len(rest) - 4} bytes")
    block = rest[:-4]
    if headers["warc-type"] != "revisit" and (digest := headers.get("warc-block-digest")) and digest != "sha1:" + hashlib.sha1(block).hexdigest():
        raise WarcError("the block's digest differs")
    return headers, block


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained on the first records of an archive; with too few, their raw bytes serve."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY] or b"\r\n\r\n"


class Writer:
    """One archive in memory: ``add`` records, ``done`` gives the bytes."""

    def __init__(self, samples: list[bytes], level: int = 3):
        words = _dictionary(samples)
        body = zstandard.ZstdCompressor(level=level).compress(words)
        self.parts = [struct.pack("<II", MAGIC, len(body)) + body]
        self.size = len(self.parts[0])
        self._compress = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True).compress

    def add(self, record: bytes) -> None:
        self.parts.append(self._compress(record))
        self.size += len(self.parts[-1])

    def done(self) -> bytes:
        return b"".join(self.parts)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one frame at a time."""
    at, words = 0, None
    view = memoryview(archive)
    if len(archive) >= 8:
        magic, size = struct.unpack_from("<II", archive)
        if magic == MAGIC:
            if 8 + size > len(archive):
                raise WarcError("the dictionary's frame is cut off")
            words = bytes(view[8 : 8 + size])
            if words[:4] == struct.pack("<I", FRAME):
                words = zstandard.ZstdDecompressor().decompress(words, max_output_size=1 << 27)
            at = 8 + size
    kind = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
    decompressor = zstandard.ZstdDecompressor(**kind)
    while at < len(archive):
        if len(archive) - at >= 8 and struct.unpack_from("<I", archive, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]  # other skippable frames say nothing
            continue
        end = frame_end(view, at)
        try:
            data = decompressor.decompressobj().decompress(view[at:end]) if zstandard.frame_content_size(view[at : at + 18]) < 0 else decompressor.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"no frame at {at}: {e}") from e
        yield parsed(data)
        at = end


def frame_end(view: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends: its header, its blocks up to the last, its checksum."""
    try:
        header = view[at : at + 18]
        end = at + zstandard.frame_header_size(header)
        last = False
        while not last:
            word = int.from_bytes(view[end : end + 3], "little")
            last, kind, size = bool(word & 1), word >> 1 & 3, word >> 3
            if kind == 3 or end + 3 > len(view):
                raise WarcError(f"the frame at {at} is cut off")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * zstandard.get_frame_parameters(header).has_checksum
    except zstandard.ZstdError as e:
        raise WarcError(f"no frame at {at}: {e}") from e
    if end > len(view):
        raise WarcError(f"the frame at {at} is cut off")
    return end


def page_records(page: dict) -> list[tuple[str, str]]:
    """Headers of a page's record."""
    name = "null" if page["page_id"] is None else str(page["page_id"])
    out = [("WARC-Type", page["record_type"]), ("WARC-Record-ID", record_id(f"{page['copy']}/{name}")), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", page["url"] or ""), ("Content-Type", "text/html"), ("WARC-Payload-Digest", "sha1:" + page["payload_digest"])]
    out += [("X-Page-Id", name), ("X-Payload-Length", str(page["payload_bytes"]))]
    if page["record_type"] == "revisit":
        return out + [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(f"0/{page['refers_to']}")), ("X-Refers-To-Page-Id", str(page["refers_to"]))]
    return [*out, ("WARC-Block-Digest", "sha1:" + page["payload_digest"])]


def planned(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The pages with payload_bytes, payload_digest, record_type, refers_to and copy.

    Of payloads that are equal and have ``least`` bytes or more, that with the largest page_id is the response and the
    others revisit it. Null html is empty; smaller payloads and pages without an id are responses. Of repeated
    rows of the largest page_id all are responses; other columns are ignored, an empty table gives no rows. Only ids
    and digests are grouped: the revisits are written as a table of numbers, so its size is known where it meets
    the payloads, and they are shuffled only if it is too large to be sent to all tasks.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    several = large.groupBy("payload_digest").agg(F.max("page_id").alias("_last"), F.min("page_id").alias("_first")).where("_first != _last").select(F.col("payload_digest").alias("_digest"), "_last")
    revisits = large.join(several, (F.col("payload_digest") == F.col("_digest")) & (F.col("page_id") != F.col("_last")))
    revisits = written(revisits.select(F.col("page_id").alias("_page"), "_digest", "_last").distinct(), "revisits")
    joined = rows.join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    other = F.col("_last").isNotNull()
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(other, "revisit").otherwise("response").alias("record_type"), F.col("_last").alias("refers_to"), F.lit(0).alias("copy"))


def write_archives(planned_pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives into ``folder`` (a URI that pyarrow's file systems know); per archive its name and record count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, top = fs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        writer, count, number, first, held = None, 0, 0, [], 0

        def close(writer: Writer, count: int, number: int) -> pa.RecordBatch:
            # each attempt has its own names, so a late or speculative one cannot replace what the list names
            name = f"part-{part:06d}-{attempt}-{number:04d}.warc.zst"
            # written under a hidden name, then moved: readers never see half a file
            with system.open_output_stream(f"{top}/.{name}", compression=None) as out:
                out.write(writer.done())
            system.move(f"{top}/.{name}", f"{top}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([writer.size], pa.int64())], names=["archive", "n_records", "n_bytes"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for page in batch.slice(lo, 64).to_pylist():
                    record = record_bytes(page_records(page), b"" if page["record_type"] == "revisit" else page["payload"])
                    if writer is None:
                        first.append(record)
                        held += len(record)
                        if len(first) < SAMPLE and held < ARCHIVE:
                            continue
                        writer, count = Writer(first), len(first)
                        for r in first:
                            writer.add(r)
                        first, held = [], 0
                    else:
                        writer.add(record)
                        count += 1
                    if writer.size >= ARCHIVE:
                        yield close(writer, count, number)
                        writer, number = None, number + 1
        if first:
            writer, count = Writer(first), len(first)
            for r in first:
                writer.add(r)
        if writer is not None:
            yield close(writer, count, number)

    return planned_pages.mapInArrow(run, "archive string, n_records long, n_bytes long")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _rows_of(archive: bytes) -> Iterator[pa.RecordBatch]:
    """The checked records of one archive, a few MB at a time."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    rows, size = [], 0
    for h, block in records(archive):
        number = lambda k: int(h[k]) if re.fullmatch(r"-?[0-9]+", h.get(k, "")) else None  # noqa: B023, E731
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
        revisit = h["warc-type"] == "revisit"
        if not revisit and digest != hashlib.sha1(block).hexdigest():
            raise WarcError("the payload's digest differs")
        rows.append((number("x-page-id"), h.get("warc-target-uri"), number("x-payload-length") if revisit else len(block), digest, h["warc-type"], number("x-refers-to-page-id"), None if revisit else block))
        size += len(block)
        if size > 4 << 20:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all *.warc.zst in a folder: ids, type, digest, length, what a revisit refers to, payload.

    Any record that breaks the format fails the job (WarcError). A folder without archives gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                yield from _rows_of(archive.as_py())

    # one archive in an Arrow batch at a time is enough: each is bounded, and a few of them fill a batch
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(run, _READ)


def read_written(archives: DataFrame, folder: str) -> DataFrame:
    """The same records from the archives that a written result of ``write_archives`` names, and from no others.

    What a failed attempt of a task may have left in the folder is not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_stream(f"{top}/{name}", compression=None) as file:
                    archive = file.read()
                if len(archive) != size:
                    raise WarcError(f"{name} has {len(archive)} bytes, not {size}")
                yield from _rows_of(archive)

    count = archives.count()
    parts = max(1, min(count, 4 * archives.sparkSession.sparkContext.defaultParallelism), count // 8)
    return archives.select("archive", "n_bytes").repartition(parts, "archive").mapInArrow(run, _READ)
