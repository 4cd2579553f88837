"""Session settings and shared scratch space."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

def ship_by_value(module_name: str) -> None:
    """Send the functions of a module to Python workers as code, so that workers need no copy
    of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings the operators rely on (UTC timestamps, adaptive plans)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and all executors are threads of this process (tests, a
    laptop) a local folder is made and set. On a cluster an absent setting is an error.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="veilscan-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: lineage is cut and the
    result survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
