"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that a Python task is handed at once (a single row may be longer).
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one only in local mode where none is configured, and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if not shared:
        if (spark.sparkContext.master or "").partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set")
        shared = "file://" + tempfile.mkdtemp(prefix="cairn-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Compute once, keep in the shared folder, and cut the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/cairn-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write as a compressed table in the shared folder and read it again (for wide or large cuts)."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, for tasks in Python: from here on the session hands over batches of at most ``BATCH_BYTES``, so that long texts don't add up."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    held = conf.get(key).lower().removesuffix("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def id_text(column) -> F.Column:
    """An id as text; null as the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def fold(column, modulus: int = 5):
    """The fold of a row: crc32 of its id's text, modulo ``modulus``."""
    return F.pmod(F.crc32(id_text(column).cast("binary")), F.lit(modulus))


def hash_order(column, seed: int = 0):
    """60 bits that put ids in a shuffled order, the same on every run and in every engine that has md5."""
    digest = F.md5(F.concat(id_text(column), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
