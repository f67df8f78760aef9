"""Tables that cut a plan's lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local run without one gets a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    _written.append(f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs only reads."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def drop(spark: SparkSession, paths: list[str]) -> int:
    """Deletes tables that nothing reads any more; returns how many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += path.getFileSystem(conf).delete(path, True)
        if name in _written:
            _written.remove(name)
    return n


def drop_written(spark: SparkSession, since: int = 0, but_last: bool = False) -> int:
    """Deletes the tables that operators of this process have left in the shared folder; returns how many.

    Call it when the results that read them are no longer needed.  since: only
    those after the first so many (see written_so_far); but_last: the newest
    table stays.
    """
    return drop(spark, _written[since : -1 if but_last else None])


def written_so_far() -> int:
    """How many tables operators of this process have left."""
    return len(_written)


__all__ = ["drop", "drop_written", "new_path", "shared_folder", "written", "written_so_far"]
