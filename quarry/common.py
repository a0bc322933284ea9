"""Reading tables, and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table `name` below `base`; a file or a folder of part files."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests, a laptop) a temporary folder of this machine stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="quarry-")
    return _LOCAL_SCRATCH[app]


class Stage:
    """Written intermediate tables of one job.

    Every table goes compressed to the shared folder, so it survives the loss of executors, and the plan that
    reads it starts anew. `drop` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.base}/{label}-{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        if self.count == 1:
            # what is not dropped before goes when the driver ends
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quarry_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = getattr(t, "_quarry_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def stage_of(df: DataFrame, name: str) -> Stage:
    return Stage(df.sparkSession, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
