"""Session settings, the shared folder, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the Python call site of every column expression costs more than planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app_name: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings every operator here relies on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone: instants are compared and printed in UTC everywhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can read, as named by the session.

    ``spark.checkpoint.dir`` wins, then the context's own checkpoint folder. Only a local
    session without either gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_FOLDERS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/barloom-{name}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, name: str) -> str:
    """Write ``df`` below the shared folder and return its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once below the shared folder and read it back.

    Used where several branches consume one reduced result. The branches then see real file
    sizes, so Spark's own broadcast threshold decides on joins, and a lost executor never
    repeats the work before the cut.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, name))
