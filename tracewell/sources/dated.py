"""Documents as files in dated folders, ``<engine>/<kind>/YYYY/MM/DD/<id>.md``; a file stands whole or not at all.

Where documents of one id are told apart by a column ``mark``, it follows the id: ``<id>~<mark>.md``.

A run writes only what is new: it asks which files there are, and replaces one only where its session has new data.
"""

from __future__ import annotations

import uuid
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import date_parts, safe_name
from .growing import opened


def with_paths(docs: DataFrame, root: str, kind: str, otherwise: date | None = None) -> DataFrame:
    """Adds ``path``: null for documents without a start, unless they go below the day ``otherwise``."""
    started = F.coalesce("started_at", F.lit(otherwise).cast("timestamp")) if otherwise else F.col("started_at")
    d = date_parts(started)
    mark = F.concat(F.lit("~"), safe_name(F.col("mark"))) if "mark" in docs.columns else F.lit("")
    name = F.concat(F.substring(safe_name(F.col("id")), 1, 8), mark, F.lit(".md"))
    path = F.when(started.isNotNull(), F.concat(F.lit(root.rstrip("/") + "/"), F.concat_ws("/", "engine", F.lit(kind), d["y"], d["m"], d["d"], name)))
    return docs.withColumn("path", path)


def present(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of the documents below a root; none where the root isn't there yet. Their contents aren't read."""
    root, fs = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs
    files = fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = [root] if files.exists(fs.Path(root)) else []
    # The driver lists folders only, as many as there are days; the files, which may be millions, are listed by tasks.
    for _ in range(5):
        days = [f"{d}/{s.getPath().getName()}" for d in days for s in files.listStatus(fs.Path(d)) if s.isDirectory()]

    def run(batches):
        from pyarrow.fs import FileSelector

        for b in batches:
            for day in b.column("day").to_pylist():
                source, path = opened(day)
                names = [f"{day}/{f.base_name}" for f in source.get_file_info(FileSelector(path)) if f.is_file and f.base_name.endswith(".md")]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])

    if not days:
        return spark.createDataFrame([], "path string")
    return spark.createDataFrame([(d,) for d in days], "day string").repartition(_width(spark), "day").mapInArrow(run, "path string")


def read(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of the documents below a root, dealt out by file."""

    def run(batches):
        for b in batches:
            texts = []
            for file in b.column("path").to_pylist():
                source, path = opened(file)
                with source.open_input_file(path) as f:
                    texts.append(f.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string())], ["path", "text"])

    return present(spark, root).repartition(_width(spark), "path").mapInArrow(run, "path string, text string")


def _width(spark: SparkSession) -> int:
    """Files are work for a while, but their names are few bytes, which would be gathered in a few tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def planned(docs: DataFrame, existing: DataFrame, *, fresh: DataFrame | None = None) -> DataFrame:
    """``docs`` (with ``path``) and their ``state``: write, kept or undated.

    A document is kept where its file is there, unless its session is among the ``fresh`` (``id``: those with new data). Of two
    documents with one path the later start is written, then the smaller id; the others are kept.
    """
    key = ["id", "mark"] if "mark" in docs.columns else ["id"]
    there = existing.select("path").distinct().withColumn("__there", F.lit(True))
    new = (docs.select(*key).limit(0) if fresh is None else fresh.select(*key)).distinct().withColumn("__new", F.lit(True))
    d = docs.join(there, "path", "left").join(new, key, "left")
    first = d.filter("path IS NOT NULL").groupBy("path").agg(F.min_by(F.struct(*key), F.struct(-F.unix_micros(F.col("started_at").cast("timestamp")), *key)).alias("__first"))
    d = d.join(first, "path", "left")
    state = F.when(F.col("path").isNull(), "undated").when(F.struct(*key) != F.col("__first"), "kept").when(F.col("__there") & F.col("__new").isNull(), "kept").otherwise("write")
    return d.withColumn("state", state).drop("__there", "__new", "__first")


def write(docs: DataFrame) -> DataFrame:
    """``path, bytes`` of the documents (``path, text``) that tasks write: each under another name first, then moved to its own.

    A task that is done again writes the same files again.
    """

    def run(batches):
        made = set()
        for b in batches:
            sizes = []
            for file, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist()):
                target, path = opened(file)
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    target.create_dir(folder, recursive=True)
                    made.add(folder)
                aside = f"{path}.{uuid.uuid4().hex}"
                data = (text or "").encode("utf-8", "surrogatepass")
                with target.open_output_stream(aside) as out:
                    out.write(data)
                target.move(aside, path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return docs.select("path", "text").repartition(_width(docs.sparkSession), "path").mapInArrow(run, "path string, bytes bigint")


def write_dated(spark: SparkSession, docs: DataFrame, root: str, kind: str, *, fresh: DataFrame | None = None, otherwise: date | None = None) -> dict[str, int]:
    """Writes the documents (``engine, id, started_at, text``) that are to be written, and says how many were: ``written, kept, undated``."""
    plan = planned(with_paths(docs, root, kind, otherwise), present(spark, root), fresh=fresh)
    # One pass decides and writes; the counts come back with it.
    counts = {r["state"]: r["n"] for r in plan.groupBy("state").agg(F.count("*").alias("n")).collect()}
    written = write(plan.filter("state = 'write'")).agg(F.count("*").alias("n")).first().n if counts.get("write") else 0
    return {"written": written, "kept": counts.get("kept", 0), "undated": counts.get("undated", 0)}
