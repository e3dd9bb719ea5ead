"""A keyed cache of vectors in hash buckets, with a commit file per write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.shared import scratch

__all__ = ["VectorCache", "merge_parts", "safe_name", "scratch"]


def safe_name(name: str, kind: str = "name") -> str:
    """``name``, if it can be one component of a path; else an error."""
    if not name or name in (".", "..") or "/" in name or "\\" in name:
        raise ValueError(f"{kind} can't be part of a path: {name!r}")
    return name


class VectorCache:
    """Vectors by (modality, id); of an id that was written again, the last write wins.

    Rows lie in folders by modality, bucket of the id's hash, and write, so that a look-up reads one bucket. A write first
    takes a number, by a commit file that only one writer can create, and counts once the file that says it is done is there: a write that
    failed half-way is never seen, and two writers don't clash. ``compact`` rewrites what is current; ``clean`` removes
    what no longer counts. The folder needs files that are created exclusively (HDFS and local disks have them).
    """

    SCHEMA = "id string, embedding array<float>, encoder_version string, dim int, written_at timestamp, written long, modality string, bucket int, seq long"
    REST = ("embedding", "encoder_version", "dim", "written_at", "written")

    def __init__(self, spark: SparkSession, path: str, modality: str, version: str, buckets: int = 32) -> None:
        self.spark, self.path, self.modality, self.version = spark, path.rstrip("/"), safe_name(modality, "modality"), version
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = lambda *parts: hadoop.Path("/".join([self.path, *parts]))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # the number of buckets is fixed by the first who opens the cache
        if not self._names("buckets-*"):
            self._create(f"buckets-{buckets}")
        self.buckets = min(int(n.rpartition("-")[2]) for n in self._names("buckets-*"))

    # commit files ---------------------------------------------------------------------------------

    def _names(self, pattern: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.globStatus(self._path(pattern)) or [])

    def _create(self, name: str, text: str = "") -> bool:
        """Whether this call created the file."""
        if self._fs.exists(self._path(name)):
            return False
        try:
            out = self._fs.create(self._path(name), False)
        except Exception as e:  # somebody else was first
            if "already exists" in str(e) or "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _take_number(self) -> int:
        last = max((int(n.split(".")[0]) for n in self._names("*.open")), default=0)
        while not self._create(f"{last + 1:020d}.open"):
            last += 1
        return last + 1

    def _live(self) -> list[int]:
        """The writes that count: done, and not replaced by a compaction."""
        done, gone = set(), set()
        for name in self._names("*.done"):
            done.add(int(name.split(".")[0]))
            stream = self._fs.open(self._path(name))
            gone |= set(json.loads(bytes(stream.readAllBytes()) or b"[]"))
            stream.close()
        return sorted(done - gone)

    # rows -----------------------------------------------------------------------------------------

    def _bucket(self, column):
        return F.pmod(F.xxhash64(column.cast("string")), F.lit(self.buckets)).cast("int")

    def _rows(self, buckets: list[int] | None = None) -> DataFrame:
        live = self._live()
        if not live or not self._fs.exists(self._path("rows")):
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/rows").where((F.col("modality") == self.modality) & F.col("seq").isin(live))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _buckets_of(self, ids: DataFrame) -> list[int]:
        return sorted(r[0] for r in ids.select(self._bucket(F.col("id")).alias("b")).distinct().collect())  # at most as many as buckets

    def _write(self, rows: DataFrame, number: int, replaces: list[int]) -> None:
        out = rows.withColumn("modality", F.lit(self.modality)).withColumn("bucket", self._bucket(F.col("id"))).withColumn("seq", F.lit(number).cast("long"))
        out.repartition("bucket").write.mode("append").partitionBy("modality", "bucket", "seq").parquet(f"{self.path}/rows")
        self._create(f"{number:020d}.done", json.dumps(replaces))

    def append(self, df: DataFrame, overwrite: bool = False) -> None:
        """Adds rows (id, embedding). An id that is there already, or twice in ``df``, is an error unless it is overwritten; so are null ids and null or empty vectors."""
        df = df.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        bad = df.where(F.col("id").isNull() | F.col("embedding").isNull() | (F.size("embedding") == 0)).limit(5).collect()
        if bad:
            raise ValueError(f"no id or no vector: {[r['id'] for r in bad]}")
        twice = df.groupBy("id").count().where("count > 1").limit(5).collect()
        again = [] if overwrite else self._known(df.select("id"), "left_semi").limit(5).collect()
        if twice or again:
            raise ValueError(f"ids are cached already: {sorted(r['id'] for r in [*twice, *again])}")
        number = self._take_number()
        self._write(df.select("id", "embedding", F.lit(self.version).alias("encoder_version"), F.size("embedding").alias("dim"), F.current_timestamp().alias("written_at"), F.lit(number).cast("long").alias("written")), number, [])

    def _newest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.max_by(F.struct(*self.REST), "written").alias("r")).select("id", "r.*")

    def read(self) -> DataFrame:
        return self._newest(self._rows()).drop("written")

    def keys(self) -> DataFrame:
        return self._rows().select("id").distinct().orderBy("id")

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The cached rows of ``ids``, from their buckets alone."""
        return self._newest(self._rows(self._buckets_of(ids)).join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")).drop("written")

    def has(self, key: str) -> bool:
        one = self.spark.createDataFrame([(key,)], "id string")
        return bool(self._rows(self._buckets_of(one)).where(F.col("id") == key).limit(1).count())

    def _known(self, ids: DataFrame, how: str) -> DataFrame:
        cached = self._rows(self._buckets_of(ids)).select(F.col("id").alias("_id")).distinct()
        return ids.join(cached, F.col("id").cast("string") == F.col("_id"), how)

    def missing(self, ids: DataFrame) -> DataFrame:
        return self._known(ids, "left_anti")

    def stats(self) -> DataFrame:
        """(n, bytes, dim, disk_bytes): current vectors, their bytes, the longest, and the bytes of all files of the modality."""
        folder = self._path("rows", f"modality={self.modality}")
        disk = self._fs.getContentSummary(folder).getLength() if self._fs.exists(folder) else 0
        return self.read().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("dim").cast("long") * 4), F.lit(0)).alias("bytes"), F.max("dim").alias("dim"), F.lit(disk).cast("long").alias("disk_bytes"))

    def compact(self) -> None:
        """Rewrites the current rows of the modality as one write that stands for the earlier ones; a write under way meanwhile keeps its place in the order."""
        mine = sorted(r[0] for r in self._rows().select("seq").distinct().collect())  # a number per write
        if len(mine) > 1:
            rows = self._newest(self._rows().where(F.col("seq").isin(mine)))
            self._write(rows, self._take_number(), mine)

    def clean(self) -> None:
        """Removes the files of writes that a compaction stands for. Reads that began before it may fail."""
        live = {str(n) for n in self._live()}
        done = {str(int(n.split(".")[0])) for n in self._names("*.done")}
        for s in self._fs.globStatus(self._path("rows", f"modality={self.modality}", "bucket=*", "seq=*")) or []:
            number = s.getPath().getName().partition("=")[2]
            if number in done and number not in live:
                self._fs.delete(s.getPath(), True)


def merge_parts(parts: list[DataFrame], key: str) -> DataFrame:
    """Keyed parts as one; a later part overwrites the keys of an earlier."""
    out = None
    for i, p in enumerate(parts):
        one = p.withColumn("_part", F.lit(i))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no parts")
    rest = [c for c in out.columns if c not in (key, "_part")]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "_part").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
