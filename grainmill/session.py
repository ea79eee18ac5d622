"""Session settings. A cluster brings its own session; `local_session` is for tests and benches."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings worth having on any session that runs these operators.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "grainmill") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    parallelism = cores if str(cores).isdigit() else (os.cpu_count() or 8)
    settings = RECOMMENDED | {
        "spark.sql.shuffle.partitions": str(parallelism),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.log.level": "ERROR",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster. Only a local session falls back to a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="grainmill-checkpoint-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut_lineage(df):
    """Reliable checkpoint of `df` (runs a job). Used where a long plan must be truncated."""
    context = df.sparkSession.sparkContext
    folder = checkpoint_dir(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most `BATCH_BYTES` to Python from now on, unless the session names a bound of its own.

    Spark's bound of 64 MB leaves executor and worker with buffers of 10,000 whole texts each, which neither gives back.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


_SCRATCH: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables under the shared checkpoint folder; `clear_scratch` deletes it."""
    _SCRATCH.append(f"{checkpoint_dir(spark)}/grainmill-{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def set_down(df, name: str):
    """`df` written to a scratch folder and read back (runs a job): for frames that many jobs read a few columns of."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever file system it is on; a missing one is no error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders made so far. Frames that read them must be done with."""
    while _SCRATCH:
        delete_folder(spark, _SCRATCH.pop())
