"""Small helpers around the session that all text operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import ship


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder in which this session's checkpoints lie.

    It is in the session's ``spark.checkpoint.dir``; only where that is unset
    (tests) a folder of our own is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "") or tempfile.mkdtemp(prefix="larkspur-"))
    return context.getCheckpointDir()


_made = 0


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the shared folder.

    Every few checkpoints the driver's JVM collects its garbage, so that Spark's
    cleaner drops shuffle files (and checkpoints, where the session says so)
    that nothing can read any more; long runs would fill the disks with them.
    """
    global _made
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    _made += 1
    if _made % 6 == 0:
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def gathered(df: DataFrame, n: int, each: int) -> DataFrame:
    """``df``, a checkpoint of ``n`` rows, in no more partitions than ``each`` rows in one of them need."""
    return df.coalesce(-(-n // each) or 1)


def removed(spark: SparkSession, path: str) -> None:
    """Delete what a job of ours wrote under the shared folder and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` whose Python worker gives its freed memory back at the end of each task.

    Workers outlive tasks and stages, so what one stage needed would otherwise
    stay beside the needs of all later ones.  Where the session doesn't say how
    many bytes a batch may have, batches are of 4 MB, however long the texts are.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, None) is None:
        conf.set(_BATCH_BYTES, str(4 << 20))

    def slim(batches):
        import ctypes

        import pyarrow as pa

        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return df.mapInArrow(slim, schema)


def filter_bits(n: int, most: int = 26) -> int:
    """Bits (as a power of two) of a bitmap that lets about one in eight strangers through, up to 8 MB."""
    return min(most, max(16, (8 * n).bit_length()))


def bit_filter(values: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of ``2**bits`` bits with bit ``value mod 2**bits`` set for each value.

    Its size is fixed by ``bits``, whatever the number of values, and at most
    ``2**bits / 64`` rows reach the driver.  It only ever lets too much through,
    so what it guards stays exact: callers join with the values themselves after it.
    """
    import numpy as np

    slot = F.pmod(F.col(column), F.lit(1 << bits))
    rows = (
        values.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("bit"))
        .groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[rows["at"].to_numpy(dtype=np.int64)] = rows["bit"].to_numpy(dtype=np.int64)
    return out.astype("<i8").tobytes()
