"""Session settings the library relies on, and the folder it shares data through."""

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options that give log semantics; safe to call more than once.

    * UTC session zone: zone-less log times mean the same on every host.
    * JSON objects with a repeated key keep the last value.
    * The JVM does not compile methods above 8000 bytes of code. Where a stage would be fused
      into such a method (mixed formats), Spark runs its operators one by one instead, whose
      code it splits.
    * The file split size must not move between the counting scan and the numbering scan
      of one query when executors come and go, so the parallelism that feeds it is pinned.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set(
            "spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism)
        )
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can see, as named by ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode, where there is one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="logweir-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so that later scans read identical rows."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{os.urandom(6).hex()}")
