"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Character classes of the two word definitions, as Java regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Byte table that lower-cases A-Z and turns every ASCII byte outside 0-9A-Za-z into a blank.
ALNUM_TABLE = bytes(
    b if b >= 0x80 or chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256)
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Only a local session may do without that setting: it gets a temporary folder.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, unless PYTHONPATH already names its folder."""
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_tracewell_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.addPyFile(shutil.make_archive(f"{folder}/tracewell", "zip", root, "tracewell"))
    context._tracewell_shipped = True


#: While a table is written: its shuffles' files go when it is complete, since nothing reads them again, and a
#: few folders are written side by side, without a sort.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "16"}
_stored_paths: list[str] = []


@contextmanager
def _writing(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with _writing(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    _stored_paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`stored`, in buckets of ``key``, so that what groups by it next needs no shuffle."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    width, table = shuffle_width(spark), path.rsplit("/", 1)[1].replace("-", "_")
    with _writing(spark):
        df.repartition(width, key).write.option("path", path).partitionBy(*partition_by).bucketBy(width, key).saveAsTable(table)
    _stored_paths.append(path)
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Deletes all tables that :func:`stored` has written for this process; results that read them are gone then."""
    while _stored_paths:
        name = _stored_paths.pop()
        spark.sql(f"DROP TABLE IF EXISTS {name.rsplit('/', 1)[1].replace('-', '_')}")
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all else unchanged; ``lower`` is much faster, and the same on pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, separator: str = SPACES) -> Column:
    """Array of the words between ``separator`` runs; null text has none. Stays inside the JVM."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda w: w != "")


def space_tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lowered, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash64(tokens: list[bytes]) -> np.ndarray:
    """A stable 64-bit hash for each token."""
    import pandas as pd  # here, so that workers that hash nothing don't load it

    array = np.empty(len(tokens), dtype=object)
    array[:] = tokens
    return pd.util.hash_array(array, categorize=False) if len(tokens) else np.empty(0, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser published with SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def blocks(lengths: list[int], limit: int):
    """Consecutive index ranges whose lengths sum to about ``limit``; every range has an element."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(lengths):
        yield start, len(lengths)
