"""What the corpus operators share: the tokenizer files' place, tables in the shared folder, row numbers, hot/tail lookups."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a dictionary that are broadcast at most; the rest is joined by a shuffle.
HOT_ENTRIES = 1 << 18
#: Longer strings are never part of a broadcast dictionary, which bounds its bytes by HOT_ENTRIES * HOT_CHARS * 4.
HOT_CHARS = 48


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="weftlight-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/weftlight/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read back: it is computed once, its lineage is cut and it outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() from which nothing will be read any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(t._shared_path)
        place.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def crc_fold(key: Column | str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts: the fold of a document."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones of any name can't clash."""
    return df.select(*[df[n] for n in names])


def frequent(counts: DataFrame, key: str, n: str = "n", most: int = HOT_ENTRIES) -> int:
    """The smallest power of two f for which at most `most` short keys have a count of f or more.

    Counts per power of two are summed by the executors; the driver sees 64 rows at most.
    """
    per = counts.filter(F.length(key) <= HOT_CHARS).groupBy(F.floor(F.log2(n)).cast("int").alias("b")).count().collect()
    have = {r["b"]: r["count"] for r in per}
    total, cut = 0, 0
    for b in range(max(have, default=0), -1, -1):
        total += have.get(b, 0)
        if total > most:
            cut = b + 1
            break
    return 1 << cut


def give_back() -> None:
    """Give memory that this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


_RESIDENT: list = [None, None]


def resident(key, make: Callable[[], object] = lambda: None):
    """What one operator keeps in a Python worker between tasks; another operator's call lets go of it first.

    Workers are reused, so caches of several operators would otherwise pile up in an executor's memory; what was let go
    of is given back to the system.
    """
    if _RESIDENT[0] != key:
        _RESIDENT[:] = [None, None]
        give_back()
        _RESIDENT[:] = [key, make()]
    return _RESIDENT[1]


def texts_of(batch, name: str = "text") -> list[str]:
    """A string column of an Arrow batch as Python strings, null as empty."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def blocks(batches: Iterable, most_bytes: int):
    """Arrow batches cut so that none has more than about most_bytes (or one row)."""
    for b in batches:
        if b.num_rows < 2 or b.nbytes <= most_bytes:
            if b.num_rows:
                yield b
            continue
        step = max(1, int(b.num_rows * most_bytes / b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
