"""A streaming source that follows growing files of lines by byte offset.

Register it with ``spark.dataSource.register(TailSource)`` and read
``spark.readStream.format("tail").option("root", folder).load()``. Only whole lines are delivered; a file that
got shorter starts again; new files start at their end unless ``backfill`` is true. Paths have to be seen by the
driver and by the executors alike. What a batch reads from within a file comes after the file's header, read again
from its first lines and given the offset -1, so that a reader without any state knows the session.

An offset holds a place for each file; of files that appeared later also where they began to count, so that a
batch that is planned again after a restart reads the same lines.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, value string"
#: Bytes of a file a batch; lines longer than the second are passed over.
BATCH_BYTES, LONGEST_LINE = 4 << 20, 16 << 20
#: Lines at a file's beginning that are looked through for its header.
HEADER_LINES = 200
HEADERS = ("session", "session_meta")
#: Before a path in an offset: where the file began to count.
BEGAN = "began:"


def whole_lines(path: str, start: int, most: int) -> int:
    """Where the last whole line ends that begins within ``most`` bytes from ``start``; a single long line counts whole."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        f.seek(start)
        held = f.read(min(most, size - start))
        cut = held.rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        at = start + len(held)
        while at < size:
            more = f.read(1 << 20)
            if not more:
                break
            cut = more.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(more)
    return start


def header_line(path: str) -> str | None:
    """The line among a file's first ones that names its session, if any does."""
    with open(path, "rb") as f:
        for _ in range(HEADER_LINES):
            raw = f.readline(LONGEST_LINE)
            if not raw:
                break
            try:
                line = json.loads(raw)
            except ValueError:
                continue
            if isinstance(line, dict) and line.get("type") in HEADERS:
                return raw.decode().rstrip("\r\n")
    return None


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root = options["root"]
        self.backfill = options.get("backfill", "false").lower() == "true"
        self.most = int(options.get("maxBytesPerFile", BATCH_BYTES))
        self.seen: dict[str, int] | None = None

    def files(self) -> list[str]:
        found = []
        for folder, _, names in os.walk(self.root, followlinks=False):
            found += [os.path.join(folder, n) for n in names if n.endswith(".jsonl") and not os.path.islink(os.path.join(folder, n))]
        return sorted(found)

    def initialOffset(self) -> dict:
        return {p: 0 if self.backfill else whole_lines(p, 0, 1 << 62) for p in self.files()}

    def latestOffset(self) -> dict:
        # where a file began matters only to the batch that it first belongs to
        now = {p: at for p, at in (self.seen if self.seen is not None else self.initialOffset()).items() if not p.startswith(BEGAN)}
        for p in self.files():
            start = now.get(p)
            if start is None and not self.backfill:
                # a file that appears later starts at its last whole line too
                now[BEGAN + p] = now[p] = whole_lines(p, 0, 1 << 62)
                continue
            if start is None or start > os.path.getsize(p):
                start = 0
            now[p] = whole_lines(p, start, self.most)
        self.seen = now
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = dict(end)
        out = []
        for path, to in end.items():
            if path.startswith(BEGAN):
                continue
            at = start.get(path, end.get(BEGAN + path, 0 if self.backfill else to))
            if to < at:
                at = 0
            if to > at:
                out.append(Stretch(path, at, to))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition.start:
            header = header_line(partition.path)
            if header is not None:
                yield partition.path, -1, header
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                if len(line) <= LONGEST_LINE:
                    try:
                        yield partition.path, at, line.rstrip(b"\r\n").decode()
                    except UnicodeDecodeError:
                        pass  # passed over, as a line that isn't JSON is
                at += len(line)

    def commit(self, end: dict) -> None:
        """Offsets are kept in the checkpoint."""


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:  # noqa: ANN001
        return TailReader(self.options)
