"""Tables in the shared folder that the cluster names: loops write their rounds there, so lineage stays short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from urbanloom.session import ship


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset and Spark is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.urbanloom.scratch", None)
        if not base:
            base = tempfile.mkdtemp(prefix="urbanloom-scratch-")
            spark.conf.set("spark.urbanloom.scratch", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/urbanloom-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a scratch table and reads it back: the lineage is cut and nothing is computed twice."""
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame | None) -> None:
    """Deletes the scratch table that ``stored`` returned as ``df``, once a later one has taken its place."""
    if df is None:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    base = shared_dir(df.sparkSession)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if "/urbanloom-" in folder and path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(base).toUri().getPath()):
            path.getFileSystem(conf).delete(path, True)
