"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int = 8, name: str = "hushframe", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for setting, value in {**SETTINGS, **extra}.items():
        builder = builder.config(setting, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own; on a
    cluster that would be a machine-local path, so it is refused there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hushframe-"))
    return context.getCheckpointDir().rstrip("/")


#: Intermediate tables this process has written and not yet deleted.
_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back: later plans
    start from files that survive the loss of any executor. ``clean_up`` deletes it."""
    path = f"{scratch_folder(df.sparkSession)}/hushframe-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Deletes the intermediate tables written so far and says how many there were.

    Results that are still lazy read them: write or collect what is wanted first.
    """
    done = 0
    while _written:
        place = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    return done
