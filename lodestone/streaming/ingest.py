"""Incremental ingest of transcript files as a stream of micro-batches, and the files that change later.

The file source finds each new file once. Logs are also appended to or edited in place, which it
doesn't see: ``refresh`` compares hashes and parses changed files whole again. ``follow`` keeps
where it has read to in each file, and of a file that has grown reads and parses what was appended.
Each batch is written under its own number, so that a batch that is run again after a failure
replaces itself: its messages, and then the files that it read, of which some may hold no message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ranges
from ..sources.scratch import written

#: Batches of changed files are numbered from here; each is later than any in which a file is new.
CHANGED = 1 << 40


def _files(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("_metadata.file_path").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"), F.sha2(F.col("value").cast("binary"), 256).alias("sha"), "value").where("length(value) > 0")


def _write(files: DataFrame, parse: Callable[[DataFrame], DataFrame], out: str, number: int) -> None:
    # the same file can come twice in a batch if it changed meanwhile: the newest counts
    newest = files.groupBy("path").agg(F.max_by(F.struct("sha", "value"), F.struct("mtime_ms", "sha")).alias("f")).select("path", "f.*")
    lines = newest.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    parse(lines).join(newest.select("path", "sha"), "path", "left").write.mode("overwrite").parquet(f"{out}/messages/batch={number}")
    newest.select("path", "sha").write.mode("overwrite").parquet(f"{out}/files/batch={number}")


def ingest(spark: SparkSession, root: str, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, pattern: str = "*.jsonl") -> StreamingQuery:
    """Parses the files below ``root`` that are new, once, into ``out``/messages/batch=N and ``out``/files/batch=N."""
    raw = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return _files(raw).writeStream.foreachBatch(lambda batch, number: _write(batch, parse, out, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(spark: SparkSession, out: str) -> DataFrame:
    """(path, batch, sha) of the last batch in which each file came."""
    last = F.max(F.struct("batch", "sha")).alias("last")
    return spark.read.parquet(f"{out}/files").groupBy("path").agg(last).select("path", "last.batch", "last.sha")


def refresh(spark: SparkSession, root: str, parse: Callable[[DataFrame], DataFrame], out: str, pattern: str = "*.jsonl") -> int:
    """Parses the known files below ``root`` whose contents have changed, as one batch; how many there are."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    known = _last(spark, out)
    changed = _files(raw).join(known.select("path", F.col("sha").alias("had")), "path").where("sha <> had").drop("had")
    count = changed.count()
    if count:
        number = known.agg(F.greatest(F.max("batch") + 1, F.lit(CHANGED))).first()[0]
        _write(changed, parse, out, number)
    return count


def current(spark: SparkSession, out: str) -> DataFrame:
    """Messages of the last batch in which each file came; none where its newest version holds none."""
    return spark.read.parquet(f"{out}/messages").join(_last(spark, out).select("path", "batch"), ["path", "batch"])


#: Bytes before the place read to, whose hash tells whether a file was appended to or made anew.
ANCHOR = 4096
#: Bytes of the lines in one row, at least.
CHUNK = 1 << 20
#: done and lines: how far a file is read; head: a line that stands for all those; whole: the batch that read it from its beginning.
_STATE = "path string, size long, mtime_ms long, done long, lines long, anchor string, head string, whole long"
_NEW = "path string, size long, mtime_ms long, done long, lines long, anchor string, anew boolean, first_line long, value string, n_read long"


def _state(spark: SparkSession, out: str) -> tuple[DataFrame, int]:
    """The last state of each file, and the number of the next batch."""
    if not ranges.exists(spark, f"{out}/state"):
        return spark.createDataFrame([], _STATE), 0
    rows = spark.read.schema(f"{_STATE}, batch long").parquet(f"{out}/state")
    names = [c.split()[0] for c in _STATE.split(", ")[1:]]
    last = rows.groupBy("path").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("path", "s.*")
    return last, rows.agg(F.max("batch") + 1).first()[0]


def _appended(files: DataFrame) -> DataFrame:
    """The whole lines behind the place that each file is read to, in chunks; from the beginning if what stands before is not what was read.

    A last line without its end waits for it.
    """

    def span(path: str, start: int, size: int) -> bytes:
        system, place = fs.FileSystem.from_uri(path)
        with system.open_input_file(place) as f:
            f.seek(start)
            return f.read(max(size - start, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                done = r["done"] or 0
                lines = r["lines"] if done else 0
                start = max(done - ANCHOR, 0)
                found = span(r["path"], start, r["size"])
                n_read, anew = len(found), not done
                if done and hashlib.sha256(found[: done - start]).hexdigest() != r["anchor"]:
                    found = span(r["path"], 0, r["size"])
                    n_read, start, done, lines, anew = n_read + len(found), 0, 0, 0, True
                end = found.rfind(b"\n", done - start) + 1 or done - start
                total = lines + found.count(b"\n", done - start, end)
                anchor = hashlib.sha256(found[max(end - ANCHOR, 0) : end]).hexdigest()
                rows, at = [], done - start
                while at < end or not rows:
                    to = end if end - at <= CHUNK else found.find(b"\n", at + CHUNK, end) + 1 or end
                    rows.append((r["path"], r["size"], r["mtime_ms"], start + end, total, anchor, anew, lines, found[at:to].decode(errors="replace"), n_read))
                    lines += found.count(b"\n", at, to)
                    at = to
                names = [c.split()[0] for c in _NEW.split(", ")]
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows])

    return files.select("path", "size", "mtime_ms", "done", "lines", "anchor").mapInArrow(run, _NEW)


def follow(spark: SparkSession, root: str, parse: Callable[[DataFrame], DataFrame], head: Callable[[DataFrame], DataFrame], out: str, pattern: str = "*.jsonl") -> tuple[int, int]:
    """Parses what the files below ``root`` hold beyond what was read before, as one batch; how many files, and how many bytes were read.

    Files of the same size and time are not opened; of one that has grown, what was appended is
    read, and ``ANCHOR`` bytes before it that tell whether it was. ``head`` makes of lines one line
    (path, value) a file that stands for them where the next ones are parsed (line number -1).
    """
    known, number = _state(spark, out)
    files = ranges.listed(spark, root, pattern).join(known.withColumnsRenamed({"size": "had", "mtime_ms": "then"}), "path", "left")
    files = files.where("had is null or size <> had or mtime_ms <> then")
    files = files.withColumn("done", F.when(F.col("size") >= F.col("done"), F.col("done")))  # shorter than what was read: made anew
    got = written(_appended(files), "appended")
    n, read = got.dropDuplicates(["path"]).agg(F.count("*"), F.coalesce(F.sum("n_read"), F.lit(0))).first()
    if not n:
        return 0, 0
    text = got.where("value <> ''").select("path", "first_line", F.posexplode(F.split(F.expr("substring(value, 1, length(value) - 1)"), "\n")).alias("nth", "value"))
    goes_on = known.join(got.where("not anew").select("path").distinct(), "path", "left_semi").where("head is not null")
    lines = text.select("path", (F.col("first_line") + F.col("nth")).alias("line_no"), "value").unionByName(goes_on.select("path", F.lit(-1).cast("long").alias("line_no"), F.col("head").alias("value")))
    parse(lines).write.mode("overwrite").parquet(f"{out}/messages/batch={number}")
    state = got.groupBy("path").agg(*[F.max(c).alias(c) for c in ("size", "mtime_ms", "done", "lines", "anchor", "anew")])
    state = state.join(head(lines).select("path", F.col("value").alias("head")), "path", "left").join(known.select("path", F.col("whole").alias("since")), "path", "left")
    state = state.withColumn("whole", F.when(F.col("anew"), F.lit(number)).otherwise(F.col("since")).cast("long"))
    state.select([c.split()[0] for c in _STATE.split(", ")]).write.mode("overwrite").parquet(f"{out}/state/batch={number}")
    return n, read


def followed(spark: SparkSession, out: str, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The messages of all files as they were last read; ``settle`` gives them what their file's ``head`` says now."""
    last, _ = _state(spark, out)
    rows = spark.read.parquet(f"{out}/messages").join(last.select("path", "head", "whole"), "path").where("batch >= whole")
    return settle(rows).drop("head", "whole", "batch")
