"""Where the corpus operators cut lineage: checkpoints and tables in the cluster's shared folder.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and the
master is local (tests, a laptop) a folder of our own under the warehouse directory is
set; a cluster without a shared folder is an error.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI; sets the checkpoint directory where the session has none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        have = sc._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("a cluster needs a shared folder: set spark.checkpoint.dir")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder.

    Its files are deleted with the last reference to it where the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, which only a session's start can set; else they stay until the folder is cleared.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Written tables of one operator call, dropped together once their readers have run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        with contextlib.suppress(Exception):  # what cannot be deleted is only left behind
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
