"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a temporary one serves a local master;
    on a cluster that would be another folder for each machine, so it is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skyledger-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def delete(jvm, conf, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


class Scratch:
    """They cut lineage and survive lost executors. Tables that a result still reads stay until the
    driver's program ends; the others are dropped as soon as they are not needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        jvm, conf, base = spark._jvm, spark._jsc.hadoopConfiguration(), self.base

        def at_end() -> None:
            with contextlib.suppress(Exception):  # the engine may be gone by then
                delete(jvm, conf, base)

        atexit.register(at_end)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self.names.discard(name)
            delete(self.spark._jvm, self.spark._jsc.hadoopConfiguration(), self.path(name))

    def keep_only(self, *names: str) -> None:
        self.drop(*(self.names - set(names)))
