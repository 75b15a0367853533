"""Tables between steps, in the folder that all executors share, and what is small enough to be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Bytes and rows of a table that may be broadcast.
MOST_BYTES, MOST_ROWS = 16_000_000, 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session (driver and executors are one process) gets a temporary folder; a cluster's raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ngramite-")
        spark.sparkContext.setCheckpointDir(found)
        found = f"file://{found}"
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ngramite/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, outlives lost executors, is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table just read, its rows dealt out if it has fewer splits than there are cores; larger ones stay where they are.

    Small files hold one row group, which one task would read and work on alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def discard(*saved: DataFrame) -> None:
    """Deletes what save() wrote, once nothing reads it any more."""
    for df in saved:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def _bytes(value: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(8))
    if isinstance(kind, ArrayType):
        each = F.aggregate(value, F.lit(0).cast("long"), lambda acc, x: acc + _bytes(x, kind.elementType)) if not isinstance(kind.elementType, (ArrayType, StructType)) else F.size(value) * 64
        return F.coalesce(each, F.lit(0)) + 16
    return F.lit(8)


def fitting(df: DataFrame, most_bytes: int = MOST_BYTES, most_rows: int = MOST_ROWS) -> DataFrame:
    """df marked for broadcast if its rows and bytes, both counted, are few; else as it is, for a join by shuffle."""
    size = sum((_bytes(df[f"`{f.name}`"], f.dataType) for f in df.schema), F.lit(8)).cast("long")
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= most_rows and size <= most_bytes else df
