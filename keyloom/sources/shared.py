"""Tables written to the folder that driver and executors share, instead of long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a local session that names none (a test) gets a folder of its own; on a cluster
    that would be the driver's disk, so it is refused there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keyloom-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet, with the writer's options, to the shared folder and read it back.

    The result has no lineage: a lost executor costs no recomputation, and what
    was drawn or numbered before the write cannot change afterwards.  The table goes with
    discard(), or when the session's JVM ends, as a result may be read until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for table in tables:
        if table is None:
            continue
        jvm = table.sparkSession._jvm
        conf = table.sparkSession._jsc.hadoopConfiguration()
        folders = {f.rpartition("/")[0] for f in table.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
