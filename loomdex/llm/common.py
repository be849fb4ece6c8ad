"""Plumbing that the training-data operators share: scratch tables, Arrow maps, global ranks.

Scratch tables are Parquet folders below ``spark.checkpoint.dir``, the folder that the driver
and all executors share.  They cut lineage (a lost executor re-reads the table instead of
re-running Python).  Steps that write what they make remove the tables they needed for it (``forget``);
the rest is removed when the session's JVM ends.
"""

from __future__ import annotations

import ctypes
import threading

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare, scratch_path, spread  # noqa: F401 - prepare is for the operators

def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _made.tables.append((path, out))
    return out


class _Made(threading.local):
    def __init__(self):
        self.tables: list[tuple[str, DataFrame]] = []


#: Scratch tables of this thread in the order in which they were written.
_made = _Made()


def made() -> int:
    """A mark: how many scratch tables there are."""
    return len(_made.tables)


def forget(since: int, keep: DataFrame | None = None) -> None:
    """Remove the scratch tables written since the mark, but for ``keep``; only when nothing lazy reads them any more."""
    for path, df in _made.tables[since:]:
        if df is not keep:
            target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _made.tables[since:] = [x for x in _made.tables[since:] if x[1] is keep]


def give_back() -> None:
    """Return what a Python worker has freed to the system, since it lives on and others start beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; one too small to fill all cores is dealt out to them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def partitions_for(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def in_one(df: DataFrame, name: str = "data"):
    """All columns of ``df`` as one struct, so that their names can't clash with an operator's own."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)).alias(name)


def out_of(ranked: DataFrame, df: DataFrame, added: list[str], name: str = "data") -> DataFrame:
    """The columns of ``df`` again, and those that were added; an added one replaces one of its name."""
    return ranked.select(*(F.col(name).getField(c).alias(c) for c in df.columns if c not in added), *added)


def _number(batches):
    """Append the task's number and each row's place in it; the rows come sorted."""
    from pyspark import TaskContext

    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        more = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n, dtype=np.int64))]
        place += n
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_part", "_place"])


def range_ranked(narrow: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sort ``narrow`` over all partitions by ``keys`` and number the rows of each partition.

    ``keys`` must end with a column that differs in every row, so that no run of equal keys can
    fill one partition.  The rows come back from a written table with ``_part`` and ``_place``;
    counts per ``_part`` (at most one row a partition, a number that is configured and does not
    grow with the data) turn both into a global rank.  One shuffle, no window, no join.
    """
    n = partitions_for(narrow)
    schema = T.StructType([*narrow.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_place", T.LongType())])
    ordered = narrow.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return materialise(ordered.mapInArrow(_number, schema), name)
