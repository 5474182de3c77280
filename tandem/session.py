"""Session set-up, lineage cutting and size checks shared by all operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Largest table (estimated bytes in memory) that is ever broadcast.
BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024
# Estimated bytes per broadcast row: hash slot, key and one or two values.
FIXED_ROW_BYTES = 64
TEXT_ROW_BYTES = 160
# Seconds between two collections of the driver's garbage, see release().
RELEASE_SECONDS = 5
_released = [0.0]


def build_session(app_name: str = "tandem", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on (AQE, skew join, UTC)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as the cluster names it.

    Only a local session without the setting gets a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="tandem-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/tandem-{uuid.uuid4().hex}/{name}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete intermediate files that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files, caches and checkpoints of frames that nobody holds any more.

    It learns of them when the driver collects its garbage, else every half an hour, and until then the
    files of a loop's rounds add up on the executors' disks.
    """
    if time.monotonic() - _released[0] > RELEASE_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released[0] = time.monotonic()


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Give a written folder its name; an empty one if nothing was written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path(target)):
        raise FileExistsError(target)
    done = files.rename(path(source), path(target)) if files.exists(path(source)) else files.mkdirs(path(target))
    if not done:
        raise OSError(f"cannot move {source} to {target}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written down in columns and read back: much smaller than a checkpoint's rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(n_rows: int, row_bytes: int = FIXED_ROW_BYTES,
                   limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    return n_rows * row_bytes <= limit


def spread(scan: DataFrame) -> DataFrame:
    """Share out the rows of an input with fewer splits than cores.

    Costs a shuffle of something small; a large input has splits enough and is
    returned as it is. ``scan`` must be a plain read.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


@contextmanager
def session_conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Set SQL options for the plans made inside the block, then restore them.

    Keyword names use ``__`` for dots.
    """
    names = {key.replace("__", "."): value for key, value in settings.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
