"""Tables in the shared folder: lineage is cut by writing and reading again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, on one machine alone, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark, "_sparkgauge_dir", None)
        if not base:
            base = spark._sparkgauge_dir = "file://" + tempfile.mkdtemp(prefix="sparkgauge-")
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "t", by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: later stages, and reruns after a
    lost executor, start from these files. `by`: columns that get a folder for each value."""
    path = f"{shared_dir(df.sparkSession)}/sparkgauge-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sparkgauge_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote. Only for those that nothing reads any more, reruns after a lost executor
    included: all that was derived from them has been written itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._sparkgauge_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
