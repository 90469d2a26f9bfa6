"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cartoweave.plans.components import ensure_checkpoint_dir

#: The six ASCII white-space characters of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Null ids sort after all others.
NULL_ID = 2**63 - 1


#: Bytes of a batch that a worker turns into Python objects at a time.
SLICE = 4 << 20


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library, which has no malloc_trim
    _LIBC = None


def tidy() -> None:
    """Give freed memory back to the system: workers live on between tasks, and their heaps would only grow."""
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


def sliced(batches, size: int = SLICE):
    """The batches in slices of about `size` bytes (and at least a row), so that a worker's memory doesn't follow Spark's batches."""
    for b in batches:
        rows = max(1, int(size * b.num_rows / max(1, b.nbytes)))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        tidy()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(df: DataFrame) -> int:
    """Spark's estimate of the bytes that a plan reads, for files their size; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def parts_for(df: DataFrame, per_part: int, least: int = 1) -> int:
    """Number of partitions that gives each about per_part bytes of the input, and at least Spark's setting."""
    spark = df.sparkSession
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_of(df) // per_part))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new name in the checkpoint folder, which driver and executors share; what is written there goes with the application."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{sc._jsc.sc().getCheckpointDir().get()}/cartoweave")
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{path.toString()}/{name}-{uuid.uuid4().hex}"


def ascii_lower(text: str) -> str:
    """A-Z only."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs outside [\\x20\\x09-\\x0D], as UTF-8; bytes.split() cuts at exactly these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def crc_sql(column: str) -> str:
    """DuckDB SQL for CRC-32 of a whole number written in decimal; null if it is null."""
    bits = ", ".join(["256"] * 8)
    steps = f"flatten(list_transform(string_split({column}::VARCHAR, ''), lambda c: [ascii(c), {bits}]))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {steps}), lambda a, x: CASE WHEN x < 256 THEN xor(a::BIGINT, x::BIGINT) ELSE xor(a::BIGINT >> 1, 3988292384 * (a::BIGINT & 1)) END)::BIGINT)"


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
