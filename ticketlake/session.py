"""Session settings and table materialisation shared by jobs, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job wants. AQE coalesces small shuffle partitions and splits skewed join
#: partitions; UTC keeps naive timestamps stable across machines; a checkpoint goes when no frame
#: refers to it any more; files are split finely, so that costly text work spreads out. Generated
#: methods over 8000 bytes are never compiled by the JVM, so stages that wide use the split form.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(app: str, cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Single-machine session for tests and the bench; clusters bring their own session.

    A cluster names a folder that all executors share in ``spark.checkpoint.dir``. Here one machine
    is all there is, so a session without the setting gets a folder of its own.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ticketlake-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a session without one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder and go on from there.

    Used where several branches read the same expensive frame (tokenised text). The lineage ends
    at files that outlive any executor; Spark owns them and deletes them with the last reference.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write a large ``df`` once as compressed Parquet in the shared folder and read it from there.

    A checkpoint holds rows as they stand in memory, several times the size of the texts that
    tokens come from; Parquet columns hold a fraction of it. The folder stays until the shared
    folder is emptied.
    """
    path = f"{shared_folder(df.sparkSession)}/tabla-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
