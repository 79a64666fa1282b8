"""What the operators of this subpackage share: staged tables, distributed prefix sums, word hashing.

Tables that cut lineage are written below the folder named by ``spark.checkpoint.dir`` (shared by
driver and executors).  Only where that setting is absent and driver and executors are one process, as
in local tests, a folder is made.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed odd multipliers of the hash functions below (arbitrary, but never to be changed).
MULT = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD,
     0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)

_LOCAL: list[str] = []
#: The setting that removes shuffle files once their query has ended.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for staged tables of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/staged-{spark.sparkContext.applicationId}"


@contextlib.contextmanager
def shuffle_files_removed(spark: SparkSession):
    """Queries made and run inside leave no shuffle files; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


class Scratch:
    """Staged tables of one operator call; ``drop`` removes those no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{scratch_root(spark)}/{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str, group_mb: int = 128) -> DataFrame:
        """``group_mb``: of a row group; small where rows are large, as readers hold a group at a time."""
        path = f"{self.root}/{name}"
        with shuffle_files_removed(self.spark):  # nothing reads those that led to a written table again
            df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", group_mb << 20).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self, df: DataFrame) -> DataFrame:
        """Writes a result that is small beside what it was made from, and drops all else."""
        others = list(self.paths)
        out = self.write(df, "result")
        self.drop(*others)
        return out

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """_row, _doc (all columns): the rows with numbers of their own, written so that the numbers stay; ids may be null or repeated."""
    return scratch.write(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc")), "numbered")


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sizes them for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(scratch: Scratch, df: DataFrame, group: list[str], order: list[Column], value: str, out: str, name: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``group`` before this one.

    The rows are range-partitioned by (group, order), so that a group of any size spreads over many
    tasks; only one total per (group, partition) is carried across.  Equal rows keep one order, as
    the partitioned table is written once.  NULL groups are groups of their own.
    """
    spark = df.sparkSession
    n = shuffle_width(spark)
    ranged = df.repartitionByRange(n, *[F.col(c) for c in group], *order).withColumn("_pid", F.spark_partition_id())
    ranged = scratch.write(ranged.withColumn("_row", F.monotonically_increasing_id()), name)
    totals = ranged.groupBy(*group, "_pid").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    keys = ["_pid", *group]
    carry = totals.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keys)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    joined = ranged.join(carry, same, "inner").select(*ranged.columns, "_carry")
    within = Window.partitionBy("_pid", *group).orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(value).over(within), F.lit(0))
    return joined.withColumn(out, F.col("_carry") + here).drop("_carry", "_pid", "_row")


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, in place."""
    h ^= h >> np.uint64(31)
    h *= MULT[6]
    h ^= h >> np.uint64(29)
    h *= MULT[7]
    h ^= h >> np.uint64(32)
    return h


def byte_table(other_to_space: str | None = None) -> np.ndarray:
    """Maps bytes: A-Z to a-z; white space to a space, or everything but digits, letters and non-ASCII."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    if other_to_space == "non-alphanumeric":
        t[:128] = [c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(128)]
    else:
        t[9:14] = 32
    return t


LOWER_SPACE, LOWER_ALNUM = byte_table(), byte_table("non-alphanumeric")
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * MULT[0])
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE, _INVERSE = int(MULT[1]), pow(int(MULT[1]), -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


class Words:
    """Words of some texts: ``hash`` (64 bits a word), ``first[d]:first[d + 1]`` are those of text d.

    ``start`` and ``end`` are byte positions in ``data``, the texts' mapped bytes, a space after each.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray):
        self.data = data = table[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        space = data == 32
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        power, inverse = _powers(len(data) + 1)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_LETTER[data] * power[: len(data)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))


def pieces(texts: list[bytes], most: int = 1 << 20):
    """Index ranges of consecutive texts of about ``most`` bytes together; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null counts as empty."""
    return [t or b"" for t in column.cast("large_binary").to_pylist()]


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_ints(a: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, compressed."""
    a = np.ascontiguousarray(a, dtype="<u8")
    n = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([n]) + squeeze(a.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes())


def unpack_ints(b: bytes) -> np.ndarray:
    n = b[0]
    planes = np.frombuffer(unsqueeze(b[1:]), np.uint8).reshape(n, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :n] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit values as their differences."""
    if not len(a):
        return b""
    return int(a[0]).to_bytes(8, "little") + pack_ints(np.diff(a))


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.empty(0, np.uint64)
    d = unpack_ints(b[8:])
    out = np.empty(len(d) + 1, np.uint64)
    out[0] = int.from_bytes(b[:8], "little")
    np.cumsum(d, out=out[1:])
    out[1:] += out[0]
    return out


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)
