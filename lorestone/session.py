"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: whether the shuffle files of a query are removed when it ends
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", app: str = "lorestone", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine, as in tests) takes a temporary folder; on a
    cluster it is an error, for executors would not see each other's files.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if folder is None:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lorestone-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/lorestone-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for the actions inside goes as soon as each has ended."""
    before = spark.conf.get(CLEAN_KEY, "false")
    spark.conf.set(CLEAN_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_KEY, before)


def settle(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder as Parquet and read it back.

    This cuts the lineage: the rows survive lost executors, are the same for every later stage, and
    later readers still prune columns and push filters.  What was shuffled for it goes as soon as it is written.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    with cleaned(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.settled_path = path
    return found


def release(df: DataFrame) -> None:
    """Remove the files of a frame from :func:`settle` that nothing will read again."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df.settled_path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
