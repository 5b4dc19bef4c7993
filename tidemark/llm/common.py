"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, equals ``rest`` (null ids: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


NO_ID = -(1 << 63)


def whole(id_col: str) -> Column:
    """An id without nulls for a pandas task, where nulls would turn ids into floats; ``NO_ID`` is null."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias(id_col)


def nullable(id_col: str) -> Column:
    """The way back from :func:`whole`."""
    return F.when(F.col(id_col) != NO_ID, F.col(id_col)).alias(id_col)


class Scratch:
    """Tables written under ``spark.checkpoint.dir``, to cut lineage.

    A written table survives lost executors and is read back from the same
    bytes by every consumer. ``drop`` removes tables no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def open_fs(uri: str):
    """File system and path of a folder that executors share, for pyarrow."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


POSITION = (1 << 33) - 1   # bits of monotonically_increasing_id that count rows of a partition


def placed(docs: DataFrame, *columns) -> DataFrame:
    """Columns of ``docs`` with ``part`` and ``pos``: the task that reads a row, and its place there."""
    return docs.select(*columns, F.spark_partition_id().cast("long").alias("part"),
                       F.monotonically_increasing_id().bitwiseAND(F.lit(POSITION)).alias("pos"))


def rows_at(docs: DataFrame, keep: DataFrame, counts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows of ``docs`` at ``(part, pos)`` of ``keep``, filtered where they are read; no row is shuffled.

    The places are written in a file for each reading task, which opens its
    own. ``counts`` has the rows of each part; a task that reads another
    number fails, so ``docs`` must be read alike both times (a table as read,
    or narrow operations on one).
    """
    marks = counts.select("part", (-1 - F.col("rows")).alias("pos"))
    path = scratch.path(name)
    (keep.select("part", "pos").unionByName(marks).repartition("part").sortWithinPartitions("part", "pos")
     .write.partitionBy("part").parquet(path))

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import TaskContext

        where, base = open_fs(path)
        found = where.get_file_info(fs.FileSelector(f"{base}/part={TaskContext.get().partitionId()}",
                                                    allow_not_found=True))
        pos = np.concatenate([np.empty(0, np.int64)] + [
            pq.read_table(f.path, columns=["pos"], filesystem=where, partitioning=None)["pos"].to_numpy()
            for f in found if f.base_name.endswith(".parquet")])
        pos.sort()
        rows, pos = -1 - pos[pos < 0].sum() if (pos < 0).any() else 0, pos[pos >= 0]
        at = 0
        for batch in batches:
            lo, hi = np.searchsorted(pos, [at, at + batch.num_rows])
            if lo < hi:
                yield batch.take(pa.array(pos[lo:hi] - at))
            at += batch.num_rows
        if at != rows:
            raise ValueError(f"a part of {rows} rows was read again with {at}")

    return docs.mapInArrow(run, docs.schema)


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased. Bytes split on 0x20 and 0x09-0x0D only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words, remembered for the commonest ones of a task."""

    def __init__(self, limit: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, toks: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, toks), np.uint64, len(toks))
        except KeyError:
            for t in toks:
                if t not in known:
                    known[t] = xxh3_64_intdigest(t)
            return np.fromiter(map(known.__getitem__, toks), np.uint64, len(toks))


_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(word_hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """64-bit hash of every run of ``size`` words, in text order.

    Fewer words than ``size``: the whole sequence is the one shingle; no
    words: none.
    """
    n = len(word_hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(size, n)
    acc = word_hashes[: n - k + 1].copy()
    for j in range(1, k):
        acc *= _P
        acc += word_hashes[j : n - k + 1 + j]
    return mix64(acc + np.uint64(k))


def rows_at_once(spark: SparkSession, rows: int = 256) -> None:
    """At most so many rows in an Arrow batch, as rows here hold whole texts or packed blocks.

    Spark counts rows, not bytes; its default of 10,000 long texts or blocks
    doesn't fit a worker. A lower setting stays as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
