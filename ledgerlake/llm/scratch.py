"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local master without one gets a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the files of a table of `written` that nothing reads any more."""
    spark = df.sparkSession
    for folder_uri in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/llm-" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder_uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns of these names, in any case: the operator's own take their place."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])
