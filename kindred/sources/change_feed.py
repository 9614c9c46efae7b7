"""A change journal as a streaming source: ``spark.readStream.format("change_feed").option("path", folder)``.

A journal is a folder of segments ``<journal id>-<first>-<next>.jsonl``: one change a line with its number ``usn`` (first <= usn <
next), ``path``, ``reason`` and ``folder``. Old segments are deleted as a journal is overwritten; a journal that was made again has
a new id. The stream's offset is the id and the next number to read. If the numbers from the offset on are not all there any
more, or the id is another one, changes were lost: with ``onloss`` "fail" (the default) the stream stops, with "restart" a row
of kind "whole" says that all is to be listed anew, and reading goes on with what is there. Executors read segments, a task each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "journal string, usn long, kind string, path string, reason long, folder boolean"
_SEGMENT = re.compile(r"(?P<id>[0-9a-zA-Z]+)-(?P<first>\d+)-(?P<next>\d+)\.jsonl")


class LostChanges(RuntimeError):
    """Changes from the stream's offset on cannot all be read."""


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def segments(folder: str) -> dict[str, list[tuple[int, int, str]]]:
    """By journal id its segments (first, next, file) in order."""
    from pyarrow import fs

    system, top = _system(folder)
    out: dict[str, list[tuple[int, int, str]]] = {}
    for info in system.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        if m := _SEGMENT.fullmatch(info.base_name):
            out.setdefault(m["id"], []).append((int(m["first"]), int(m["next"]), info.base_name))
    return {k: sorted(v) for k, v in out.items()}


class Segment(InputPartition):
    def __init__(self, journal: str, low: int, high: int, file: str | None):
        self.journal, self.low, self.high, self.file = journal, low, high, file


class ChangeFeedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.restart = options["path"], options.get("onloss", "fail") == "restart"
        if options.get("onloss", "fail") not in ("fail", "restart"):
            raise ValueError("onloss is fail or restart")

    def _newest(self) -> tuple[str, list[tuple[int, int, str]]]:
        """The journal that is written now: the one of the last name, as ids grow when a journal is made again."""
        found = segments(self.folder)
        return max(found.items()) if found else ("", [])

    def initialOffset(self) -> dict:
        journal, parts = self._newest()
        return {"journal": journal, "usn": parts[0][0] if parts else 0}

    def latestOffset(self) -> dict:
        journal, parts = self._newest()
        return {"journal": journal, "usn": parts[-1][1] if parts else 0}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        parts = segments(self.folder).get(end["journal"], [])
        low = start["usn"] if start["journal"] in (end["journal"], "") else None
        if start["journal"] == "":
            low = parts[0][0] if parts else 0  # the stream began before there was a journal
        at, out = low, []
        if low is not None:
            for first, after, file in parts:
                if after <= at or first >= end["usn"]:
                    continue
                if first > at:
                    break
                out.append(Segment(end["journal"], at, min(after, end["usn"]), file))
                at = min(after, end["usn"])
        if low is not None and at >= end["usn"]:
            return out
        if not self.restart:
            raise LostChanges(f"changes from {start} to {end} are not all in {self.folder}")
        first = parts[0][0] if parts else end["usn"]
        return [Segment(end["journal"], first, first, None), *(Segment(end["journal"], a, min(b, end["usn"]), file) for a, b, file in parts if a < end["usn"])]

    def read(self, partition: Segment) -> Iterator[tuple]:
        if partition.file is None:
            yield (partition.journal, partition.low, "whole", None, None, None)
            return
        system, top = _system(self.folder)
        try:
            file = system.open_input_stream(f"{top}/{partition.file}")
        except FileNotFoundError as e:
            raise LostChanges(f"{partition.file} was overwritten while it was to be read") from e
        with file:
            rest = b""
            while chunk := file.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from self._rows(partition, lines)
            yield from self._rows(partition, [rest])

    def _rows(self, partition: Segment, lines: list[bytes]) -> Iterator[tuple]:
        for line in lines:
            if line.strip():
                r = json.loads(line)
                if partition.low <= r["usn"] < partition.high:
                    yield (partition.journal, r["usn"], "change", r["path"], r.get("reason"), r.get("folder"))


class ChangeFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangeFeedReader:
        return ChangeFeedReader(dict(self.options))
