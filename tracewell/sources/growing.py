"""Logs that grow: only the bytes behind what was read before are read, and folded into what is known.

A store (:mod:`..operators.versions`) keeps, by file: ``offsets`` (how far a log is read), ``sessions``, ``facts``, and ``carried``,
what later parts need of earlier ones: calls that results may still come for, and the keys of usage
records, errors and replies that count once only. A run reads the tails, folds them and writes one
new version of all four, so that a run that breaks off is done again from the same offsets. Facts and
sessions come out as if each log had been read whole.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.versions import Store
from . import ingest, logs

RANGE = 16 << 20
SUMS = ("total_turns", "total_tools", "total_input_tokens", "total_output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")
FIRST, LAST = ("uid", "model", "cwd", "forked_from", "started_at", "root_summary"), ("last_event_at", "exit_signal")


def log_sizes(spark: SparkSession, root: str, glob: str, *, recursive: bool = True) -> DataFrame:
    """``file, size`` of the logs below a root; their contents aren't read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))


def pending(sizes: DataFrame, offsets: DataFrame) -> DataFrame:
    """``file, start, size, anew`` of logs with unread bytes. A log shorter than before was written anew and is read whole."""
    both = sizes.join(offsets.select("file", "offset"), "file", "left").withColumn("anew", F.coalesce(F.col("size") < F.col("offset"), F.lit(False)))
    start = F.when(F.col("anew"), 0).otherwise(F.coalesce("offset", F.lit(0))).cast("bigint")
    return both.select("file", start.alias("start"), "size", "anew").filter("size > start OR anew")


def read_tails(tails: DataFrame, *, range_bytes: int = RANGE) -> DataFrame:
    """``file, ord, line, end`` of the lines in the bytes from ``start`` to ``size`` of each file (``file, start, size``).

    ``ord`` is the byte a line starts at, ``end`` the byte behind it. A long tail is read by many tasks, in ranges: a
    line belongs to the range it starts in. A last line without its end is left for the next time, unless it is whole
    JSON. Paths are read with pyarrow's file systems (local, HDFS, object stores), by position.
    """

    def run(batches):
        for b in batches:
            for file, low, high, size, first in zip(*(b.column(c).to_pylist() for c in ("file", "low", "high", "size", "start"))):
                source, path = opened(file)
                with source.open_input_file(path) as f:
                    yield from lines_of(f, file, low, high, size, first)

    def lines_of(f, file: str, low: int, high: int, size: int, first: int):
        # A range that isn't the first begins behind the first line end at or after the byte before it.
        skip = low != first
        at, buffer, searched, rows = low - skip, b"", 0, []
        f.seek(at)
        while True:
            begin = 0
            while at + begin < high and (end := buffer.find(b"\n", max(begin, searched))) >= 0:
                if not skip:
                    rows.append((file, at + begin, buffer[begin:end], at + end + 1))
                skip, begin = False, end + 1
            at, buffer = at + begin, buffer[begin:]
            searched = len(buffer)
            if len(rows) >= 4_096:
                yield batch(rows)
                rows = []
            if at >= high or not (more := f.read(min(1 << 20, size - at - len(buffer)))):
                break
            buffer += more
        if buffer and not skip and at < high and is_object(buffer):
            rows.append((file, at, buffer, size))
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        file, at, line, end = zip(*rows)
        text = [x.rstrip(b"\r").decode("utf-8", "replace") for x in line]
        return pa.RecordBatch.from_arrays([pa.array(file), pa.array(at, pa.int64()), pa.array(text, pa.string()), pa.array(end, pa.int64())], ["file", "ord", "line", "end"])

    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - F.col("start") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint")))
    ranges = tails.filter("size > start").select("file", "start", "size", parts.alias("from")).withColumn("low", F.col("start") + F.col("from"))
    ranges = ranges.withColumn("high", F.least("size", F.col("low") + range_bytes)).select("file", "low", "high", "size", "start")
    # One range is work for a while; without this a few tasks would read all, since the ranges' rows are small.
    width = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(width, "file", "low").mapInArrow(run, "file string, ord bigint, line string, end bigint")


def last_lines(files: DataFrame, n: int, *, block: int = 64 << 10) -> DataFrame:
    """``file, ord, line, bytes``: the last ``n`` lines of each log (``file, size``), blank ones too, read backward from its end.

    Blocks are read until the lines are there, so that the bytes read (``bytes``, the same in all rows of a log) follow
    the lines and not the log. Logs that have gone meanwhile have no rows.
    """

    def run(batches):
        for b in batches:
            for file, size in zip(b.column("file").to_pylist(), b.column("size").to_pylist()):
                try:
                    source, path = opened(file)
                    with source.open_input_file(path) as f:
                        at, parts, ends = size, [], 0
                        while at > 0 and ends <= n:
                            step = min(block, at)
                            at -= step
                            f.seek(at)
                            parts.append(f.read(step))
                            # A line end that closes the log doesn't begin another line.
                            ends += parts[-1].count(b"\n") - (len(parts) == 1 and parts[-1].endswith(b"\n"))
                except FileNotFoundError:
                    continue
                data = b"".join(parts[::-1])
                lines = data.removesuffix(b"\n").split(b"\n") if data else []
                begins, out = at + sum(len(x) + 1 for x in lines[:-n]), []
                for x in lines[-n:]:
                    out.append((file, begins, x, size - at))
                    begins += len(x) + 1
                if out and n:
                    names, places, texts, read = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(places, pa.int64()), pa.array([x.rstrip(b"\r").decode("utf-8", "replace") for x in texts]), pa.array(read, pa.int64())], ["file", "ord", "line", "bytes"])

    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "size").repartition(width, "file").mapInArrow(run, "file string, ord bigint, line string, bytes bigint")


def opened(file: str) -> tuple:
    """pyarrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(file if ":" in file else f"file://{file}")


def is_object(text: bytes) -> bool:
    """Whether a text without a line end is a whole JSON object, which no more bytes could change."""
    import json

    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def once_key(engine: str) -> Column:
    """What makes an event count once only in its log: ``kind:key``, null where it always counts.

    It covers the records of usage of all engines, the metadata of the first, and the replies of the second (of which
    closing messages are dropped where their text was said before).
    """
    key = F.when((F.col("kind") == "usage") & F.col("usage_key").isNotNull(), F.concat(F.lit("usage:"), "usage_key"))
    if engine == "claude":
        key = key.when(F.col("kind") == "meta", F.lit("meta:"))
    if engine == "codex":
        key = key.when(F.col("kind") == "assistant_text", F.concat(F.lit("said:"), logs.said_key()))
    return key


def fresh(events: DataFrame, known: DataFrame, engine: str) -> DataFrame:
    """The new ``events`` that count, given the keys ``known`` (``file, key``) of earlier parts; ``key`` is theirs."""
    e = events.withColumn("key", once_key(engine)).repartition("file")
    place = Window.partitionBy("file", "key").orderBy("ord", "sub_ord")
    e = e.withColumn("nth", F.row_number().over(place)).join(known.select("file", "key").distinct().withColumn("known", F.lit(True)), ["file", "key"], "left")
    seen = F.col("key").isNotNull() & (F.coalesce("known", F.lit(False)) | (F.col("nth") > 1))
    # A repeated record of usage stays, for its time, but counts nothing. Replies go only if they close a task.
    e = e.withColumns({c: F.when(seen & (F.col("kind") == "usage"), 0).otherwise(F.col(c)).cast("bigint") for c in logs.LONGS})
    return e.filter(~(seen & ((F.col("kind") == "meta") | logs.is_closing()))).drop("nth", "known")


def merged_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of :func:`ingest.session_rows` for whole logs, from those of their earlier parts and of what came behind."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.file") == F.col("n.file"), "full")
    out = {"file": F.coalesce("o.file", "n.file"), "peak_context": F.greatest("o.peak_context", "n.peak_context")}
    out |= {c: F.coalesce(f"o.{c}", f"n.{c}") for c in FIRST} | {c: F.coalesce(f"n.{c}", f"o.{c}") for c in LAST}
    out |= {c: F.coalesce(f"o.{c}", F.lit(0)) + F.coalesce(f"n.{c}", F.lit(0)) for c in SUMS}
    return both.select(*(out[c].alias(c) for c in new.columns))


CARRIED = "file string, kind string, key string, ord bigint, sub_ord int, ts timestamp, name string, payload string"


def ingest_growth(spark: SparkSession, store: str, root: str, glob: str, engine: str, *, range_bytes: int = RANGE, buckets: int = 16, before_commit: Callable[[], None] | None = None) -> dict[str, int]:
    """Reads what has come to the logs of one engine below ``root`` since the last run, and commits the next version.

    Gives ``files, bytes`` read. ``engine`` is claude or codex (the third engine's documents are rewritten, not appended
    to; they are read whole). ``before_commit`` is called when all is written and nothing is live yet.
    """
    s = Store(spark, store, buckets=buckets)
    parse = {"claude": logs.parsed_a, "codex": logs.parsed_b}[engine]
    empty = lambda schema: spark.createDataFrame([], schema)
    table = lambda name, schema: s.read(name) if name in s else empty(schema)
    # The list of files is taken once: logs may go on growing while this runs.
    sizes = log_sizes(spark, root, glob)
    if engine == "claude":
        sizes = sizes.filter(~F.regexp_extract("file", "([^/]+)$", 1).startswith("agent-"))
    tails = s.staged(pending(sizes, table("offsets", "file string, offset bigint")), "tails")
    counted = tails.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.col("size") - F.col("start")), F.lit(0)).alias("bytes")).first()
    if not counted.files:
        return {"files": 0, "bytes": 0}
    lines = s.staged(read_tails(tails, range_bytes=range_bytes), "lines")
    events = s.staged(parse(lines.filter("trim(line) <> ''")), "events")

    anew = tails.filter("anew").select("file")
    touched = tails.select("file")
    carried = table("carried", CARRIED).join(touched, "file", "left_semi").join(anew, "file", "left_anti")
    new = s.staged(fresh(events, carried.filter("kind = 'once'"), engine), "fresh")

    # Calls of earlier parts whose results have come now stand before the new events, without their turns.
    answered = new.filter("kind = 'tool_result' AND call_id IS NOT NULL").select("file", F.col("call_id").alias("key")).distinct()
    calls = carried.filter("kind = 'call'").join(answered, ["file", "key"], "left_semi")
    earlier = calls.select("file", "ord", "sub_ord", "ts", F.lit("tool_use").alias("kind"), "name", F.col("key").alias("call_id"), "payload")
    both = new.drop("key").unionByName(earlier, allowMissingColumns=True)
    known = table("sessions", "file string, total_turns bigint").join(anew, "file", "left_anti").select("file", F.col("total_turns").alias("turns_before"))
    place = tails.join(known, "file", "left").select("file", F.when(F.col("anew"), 0).otherwise(F.col("start")).alias("start"), F.coalesce("turns_before", F.lit(0)).alias("turns_before"))
    facts = ingest.keyed_facts(both).join(place, "file")
    turn = F.nullif(F.coalesce("turn_number", F.lit(0)) + F.col("turns_before"), F.lit(0)).cast("int")
    facts = s.staged(facts.withColumn("turn_number", turn).withColumn("late", F.col("ord") < F.col("start")).drop("start", "turns_before"), "facts")
    errors = carried.filter("kind = 'error'").select("file", F.col("key").alias("error_key")).distinct()
    made = facts.filter("NOT late").join(errors, ["file", "error_key"], "left_anti").drop("late", "error_key")
    codes = facts.filter("late AND success IS NOT NULL").select("file", "ord", "sub_ord", F.col("exit_code").alias("new_code"), F.col("success").alias("new_success"))

    # What later parts will need of this one.
    flat = lambda kind, key, df: df.select("file", F.lit(kind).alias("kind"), key.alias("key"), "ord", F.col("sub_ord").cast("int").alias("sub_ord"), "ts", *(F.col(c) if kind == "call" else F.lit(None).cast("string").alias(c) for c in ("name", "payload")))
    carry = flat("call", F.col("call_id"), new.filter("kind = 'tool_use' AND call_id IS NOT NULL"))
    carry = carry.unionByName(flat("once", F.col("key"), new.filter("key IS NOT NULL"))).unionByName(flat("error", F.col("error_key"), facts.filter("NOT late AND error_key IS NOT NULL").join(errors, ["file", "error_key"], "left_anti")))

    sessions = ingest.session_rows(new.drop("key"))
    if "sessions" in s:
        before = s.read("sessions").join(touched, "file", "left_semi").join(anew, "file", "left_anti")
        sessions = merged_sessions(before, sessions)
    offsets = tails.join(lines.groupBy("file").agg(F.max("end").alias("end")), "file", "left").select("file", F.greatest("start", "end").alias("offset"))

    # Facts of logs whose earlier calls have got a code, or that were written anew, are rewritten; others only grow.
    changed = s.staged(codes.select("file").union(anew).distinct(), "changed")
    if "facts" in s and changed.limit(1).count():
        kept = s.read("facts").join(changed, "file", "left_semi").join(anew, "file", "left_anti").join(codes, ["file", "ord", "sub_ord"], "left")
        kept = kept.withColumns({"exit_code": F.when(F.col("new_success").isNotNull(), F.col("new_code")).otherwise(F.col("exit_code")), "success": F.coalesce("new_success", "success")}).drop("new_code", "new_success")
        # Staged, since it is read from the very buckets that are replaced.
        whole = s.staged(kept.unionByName(made.join(changed, "file", "left_semi")), "whole")
        s.rewrite("facts", whole, changed, "file")
        made = made.join(changed, "file", "left_anti")
    s.append("facts", made, "file")
    if "carried" in s and anew.limit(1).count():
        s.rewrite("carried", carry.limit(0), anew, "file")
    s.append("carried", carry, "file")
    s.rewrite("sessions", s.staged(sessions, "sessions"), touched, "file")
    s.rewrite("offsets", offsets, touched, "file")
    if before_commit is not None:
        before_commit()
    s.commit()
    return {"files": counted.files, "bytes": counted.bytes}


def current(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """Sessions and facts of the newest version."""
    s = Store(spark, store)
    return ingest.named_sessions(s.read("sessions")), s.read("facts")
