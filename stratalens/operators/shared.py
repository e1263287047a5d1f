"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or on a local master that has none, of this machine."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{at}/{uuid.uuid4().hex}" if at else tempfile.mkdtemp(prefix="stratalens-")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: what made it is not asked again, whatever executor is lost."""
    path = f"{folder(df.sparkSession)}/kept"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``kept`` has written, once nothing will read it again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
