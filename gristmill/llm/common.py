"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters. ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\r\x0b\x0c"
#: Stands for a null id: sorts behind every real one.
LAST_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the folder that the cluster names in spark.checkpoint.dir. A folder of its own is made only where none is named and all runs on this machine."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gristmill-"))
    return df.checkpoint()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(spark: SparkSession, size: int, each: int = 64 << 20, most: int = 100_000) -> int:
    """Partitions for ``size`` bytes, of ``each`` bytes; the session's number at least, and ``most`` at most, beyond which they grow."""
    return max(parts(spark), min(most, -(-size // each)))


def text_size(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(column) -> list:
    """The UTF-8 bytes of an Arrow string column, null as b''."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def released() -> None:
    """Gives freed memory back to the system at the end of a task: the worker process lives on and may serve other stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
