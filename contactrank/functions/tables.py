"""Tables in the folder that driver and executors share: lineage cuts, and folders by Spark's own file system."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Tables up to this size are sent to all tasks.
MAX_BROADCAST_BYTES = 32 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; on a local master, where none is named, a folder of our own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes a table to the checkpoint folder and reads it again."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder through Spark's file system, wherever it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Removes what `checkpoint` has written, once nothing reads it any more."""
    for df in tables:
        drop_folder(df.sparkSession, df.written_to)
