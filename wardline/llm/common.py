"""Helpers shared by the training-data operators: shared folders, staging, Arrow workers and word splitting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Batches hold whole texts, so they are kept short.
BATCH_ROWS = 64

#: Upper-case ASCII letters become lower case, ASCII white space becomes a space.
_SPACED = bytes(0x20 if b == 0x20 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Upper-case ASCII letters become lower case, every other ASCII character but digits and letters a space.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 0x20 for b in range(256)
)


def utf8(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


def spaced_words(text: str | bytes | None) -> list[bytes]:
    r"""The words `[^\x20\x09-\x0D]+` of a text whose A-Z are lower-cased, as UTF-8."""
    return utf8(text).translate(_SPACED).split()


def alnum_words(text: str | bytes | None) -> list[bytes]:
    r"""The words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z are lower-cased, as UTF-8."""
    return utf8(text).translate(_ALNUM).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Only a local master may go without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:  # with its scheme, as workers open files below it as well
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not (held := spark.conf.get("wardline.llm.dir", "")):
        held = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("wardline.llm.dir", held)
    return held


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once in each application: their functions import it."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_wardline_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "wardline.zip")
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(target)
    context._wardline_shipped = True


class Scratch:
    """A folder of one run below the shared folder, for results that are read more than once."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table once and read it back, which also ends its lineage."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the Arrow batches that hold whole texts short, unless the session asks for shorter ones."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs run inside, for tables of short rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` with short batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def local_fs(uri: str):
    """(file system, path) of a folder or file, for workers that write binary files to the shared folder."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


_CLEAR: dict[str, Callable[[], None]] = {}


def alone(owner: str, clear: Callable[[], None]) -> None:
    """Make a worker forget what the other operators remember in it: workers are used again by later stages."""
    for name, other in _CLEAR.items():
        if name != owner:
            other()
    _CLEAR[owner] = clear


class WordHashes(dict):
    """64-bit hashes of words, forgotten all at once when they are too many."""

    most = 1_000_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes, size: int):
    """64-bit hashes of all runs of `size` neighbours."""
    import numpy as np

    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += hashes[k:k + n]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def row_numbers(first: int, n: int, partition: int):
    """Numbers that no other row of the job has: the partition above the place in it."""
    import numpy as np

    return np.arange(first, first + n, dtype=np.int64) + (partition << 40)


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """Rows with the largest counts, `most` at most: whole steps of the count's logarithm, so that no task sorts them all."""
    step = F.floor(F.log2(F.col(count)) * 16)
    sizes = dict(df.groupBy(step.alias("step")).count().collect())  # a row per step, a thousand at most
    least, held = None, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        least = k
    return df.where(F.lit(False) if least is None else step >= least)


def hashed_out(key: str, buckets: int):
    """Remainder of the unsigned CRC-32 of a key as text: 0 .. buckets - 1."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(buckets)
