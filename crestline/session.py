"""Session defaults and materialisation in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "crestline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE on).

    Cluster settings (master, memory, shuffle width) stay with spark-submit;
    pass ``master`` only for local runs.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut-lineage tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a temporary folder; on a cluster a
    machine-local folder would be invisible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = os.environ.get("CRESTLINE_LOCAL_DIR") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.environ["CRESTLINE_LOCAL_DIR"] = made
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Cuts lineage for iterative operators; a lost executor costs a re-read, not
    a recomputation, and later passes get column pruning on the parquet.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_dir(spark: SparkSession) -> str:
    """Where this application keeps what ``materialize`` writes."""
    return f"{shared_dir(spark).rstrip('/')}/stage-{spark.sparkContext.applicationId}"


def sweep_stage(spark: SparkSession) -> None:
    """Delete all that ``materialize`` wrote in this application: call it once the results that read it are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
