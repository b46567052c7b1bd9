"""The folder that driver and executors share, and tables in it that last as long as the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names.  Only where that is unset and the session is local (tests) it is a
    folder below the warehouse; on a cluster that would be a folder of one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path as Hadoop has them."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def run_folder(spark: SparkSession) -> str:
    """This process's folder in the shared one; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/notes-{_RUN}"
    fs, folder = hadoop_path(spark, path)
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return path


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once, at ``path`` or in this process's folder, and read again: later jobs don't run
    its plan once more, and lost executors cost a read."""
    path = path or f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the largest table that a frame reads, for each partition that ``spread`` makes.
EACH = 8 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into partitions whose number grows with the largest table that it reads, where the
    shuffle partitions of the session would let each grow instead; tables that fit those stay as they are."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    n = -(-max((x for x in sizes if x < 1 << 60), default=0) // EACH)  # what has no figure has the largest of all
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def delete(spark: SparkSession, path: str) -> None:
    fs, found = hadoop_path(spark, path)
    fs.delete(found, True)
