"""Transcripts as a registered source of Spark: files are found when a query is planned, and read in byte ranges.

    spark.dataSource.register(Transcripts)
    spark.read.format("lodestone_transcripts").option("roots", '{"claude": "/home/x/logs"}').load()

Rows are lines: tool, path, mtime_ms, at (the byte where the line begins) and value. With the option
``prune``, filters on tool, path and mtime_ms are taken over from the query, so that other files are
not opened; it needs ``spark.sql.python.filterPushdown.enabled``.
"""

from __future__ import annotations

import fnmatch
import io
import json
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "tool string, path string, mtime_ms long, at long, value string"
#: Bytes of a file that one task reads, but for the end of its last line.
RANGE_BYTES = 32 << 20
#: So many tasks have a range each; of more ranges, tasks get several, which count as ``OPEN_BYTES`` and their own bytes.
TASKS, OPEN_BYTES = 256, 64 << 10
#: Bytes of lines in a batch.
BATCH_BYTES = 4 << 20

_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda a, b: a in b}


@dataclass
class Range:
    tool: str
    path: str
    mtime_ms: int
    start: int
    end: int


@dataclass
class Part(InputPartition):
    """What one task reads."""

    ranges: list[Range]


def dealt(ranges: list[Range]) -> list[Part]:
    """Ranges in order, dealt to tasks of about the same work: many small files are one task."""
    if len(ranges) <= TASKS:
        return [Part([r]) for r in ranges]
    work = [OPEN_BYTES + r.end - r.start for r in ranges]
    most = min(RANGE_BYTES, sum(work) // TASKS)
    out: list[Part] = []
    held = most
    for r, w in zip(ranges, work, strict=True):
        if held >= most:
            out.append(Part([]))
            held = 0
        out[-1].ranges.append(r)
        held += w
    return out


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = json.loads(options["roots"])
        self.pattern, self.skip = options.get("pattern", "*.jsonl"), options.get("skip", "/subagents/")
        self.size = int(options.get("rangeBytes", RANGE_BYTES))
        self.filters: list[Filter] = []

    def _wanted(self, tool: str, path: str, mtime_ms: int) -> bool:
        of = {"tool": tool, "path": path, "mtime_ms": mtime_ms}
        return all(_TESTS[type(f)](of[f.attribute[0]], f.value) for f in self.filters)

    def discover(self) -> list[tuple[str, str, int, int]]:
        """(tool, path, mtime_ms, size) of the files that the query needs."""
        out = []
        for tool, root in self.roots.items():
            if not all(_TESTS[type(f)](tool, f.value) for f in self.filters if f.attribute[0] == "tool"):
                continue
            system, place = fs.FileSystem.from_uri(root)
            for x in system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True)):
                found = (tool, x.path, x.mtime_ns // 1_000_000, x.size)
                if x.is_file and fnmatch.fnmatch(x.base_name, self.pattern) and self.skip not in x.path and self._wanted(*found[:3]):
                    out.append(found)
        return sorted(out)

    def partitions(self) -> list[Part]:
        return dealt([Range(tool, path, ms, at, min(at + self.size, size)) for tool, path, ms, size in self.discover() for at in range(0, size, self.size)])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the ranges, whole."""
        systems = {tool: fs.FileSystem.from_uri(self.roots[tool])[0] for tool in {r.tool for r in partition.ranges}}
        rows: list[tuple[str, str, int, int, str]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["tool", "path", "mtime_ms", "at", "value"])

        for r in partition.ranges:
            with io.BufferedReader(systems[r.tool].open_input_file(r.path), min(max(r.end - r.start, 4096), 1 << 20)) as f:
                at = max(r.start - 1, 0)
                f.seek(at)
                if r.start:
                    at += len(f.readline())  # up to the end of the line that begins before
                while at < r.end and (line := f.readline()):
                    rows.append((r.tool, r.path, r.mtime_ms, at, line.rstrip(b"\n").decode(errors="replace")))
                    at += len(line)
                    held += len(line)
                    if held >= BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class Pruning(Reader):
    """Takes filters over from the query; Spark allows that only where its setting for it is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("tool", "path", "mtime_ms"):
                self.filters.append(f)
            else:
                yield f


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_transcripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Pruning(self.options) if self.options.get("prune", "false") == "true" else Reader(self.options)
