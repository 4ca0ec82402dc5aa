"""What the operators share: the shared folder, sizes, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_HELD = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on one machine one of our own where that is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="riskweave-")
        atexit.register(shutil.rmtree, _OWN[app].removeprefix("file://"), ignore_errors=True)
    return _OWN[app]


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends, if its session still runs then."""

    def remove() -> None:
        with suppress(Exception):
            _delete(spark, path)

    atexit.register(remove)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, tag: str, keep: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet into the shared folder, in folders by some columns, and read it back: later reads don't depend on lost executors.

    Inside scratch() the files go at its end; those to be kept, at the end of the scratch() around that, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    held = getattr(_HELD, "paths", [])
    if len(held) > keep:
        held[-1 - keep].append(path)
    else:
        remove_at_end(spark, path)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside, and not kept, are deleted at the end."""
    if not hasattr(_HELD, "paths"):
        _HELD.paths = []
    _HELD.paths.append([])
    try:
        yield
    finally:
        for path in _HELD.paths.pop():
            _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._written_at)


def press(x: np.ndarray) -> bytes:
    """Integers, compressed byte by byte (the lowest bytes of all, then the next), in as few bytes as the largest needs."""
    x = np.ascontiguousarray(x).ravel()
    size = next(k for k in (1, 2, 4, 8) if k == 8 or not len(x) or (x.min() >= 0 and x.max() < 1 << 8 * k))
    return bytes([size]) + zstandard.compress(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes(), 1)


def unpress(b: bytes) -> np.ndarray:
    size = b[0]
    return np.frombuffer(zstandard.decompress(b[1:]), np.uint8).reshape(size, -1).T.copy().view(f"<u{size}").ravel().astype(np.int64)


def give_back() -> None:
    """Return freed memory to the system, so that a worker that lives on holds no more than it uses."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def width(spark: SparkSession) -> int:
    """Shuffle partitions: set with the size of the input, so a fair count of owners and ranges."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text"):
    """Null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like the one given that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame) -> list:
    """All columns, by whatever names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


class WordHashes(dict):
    """bytes word -> 64-bit hash; keeps what it has seen, up to a bound."""

    BOUND = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the runs of n consecutive word hashes, by a polynomial over uint64."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - n + 1, (seed * int(M2) + int(M1)) % (1 << 64), np.uint64)
    for j in range(n):
        out *= M1
        out += h[j : len(h) - n + 1 + j]
    return mix(out)
