"""What the corpus operators share: words, bound expressions, model tables as literals, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: white space that separates words (space, tab, LF, VT, FF, CR).
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs of anything but SPACE; none for a null text."""
    pieces = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.filter(pieces, lambda w: w != F.lit(""))


def literal_array(values: Iterable, of: str = "double") -> Column:
    """A bounded table as one foldable literal, so that scoring needs neither a join nor a shuffle."""
    return F.split(F.lit(",".join(format(v, ".10g") for v in values)), ",").cast(f"array<{of}>")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own setting, or, where it is unset and the master is local, one of this machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "checkpoints")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the process
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the shared folder: a lost executor loses none of it, and joins know its size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestone/{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)  # later queries may still read it
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MARKS = 2048  # bitmaps of 32768 bits


def perhaps_among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose `column` is in the only column of `ids`, and a few others: those whose hash one of them shares. What is
    broadcast is MARKS bitmaps of 4 KB, 8 MB at any size of `ids`; it spares a join that follows the shuffle of most other rows."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS * 32768))
    marks = ids.select(at(F.col(ids.columns[0])).alias("at")).groupBy(F.expr("at div 32768").alias("block_")).agg(F.bitmap_construct_agg(F.expr("at % 32768")).alias("marks_"))
    place = df.withColumn("at_", at(F.col(column))).withColumn("block_", F.expr("at_ div 32768"))
    byte = F.conv(F.hex(F.substring("marks_", F.expr("int(at_ % 32768 div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    found = place.join(F.broadcast(marks), "block_").filter(byte.bitwiseAND(F.expr("shiftleft(1, int(at_ % 8))")) != 0)
    return found.select(*df.columns)


def text_batches(batch, column: int, limit: int = 1 << 20):
    """Split an Arrow batch into slices whose texts hold about `limit` bytes (one text at least)."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    slot = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(slot)) + 1
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, end - start)
