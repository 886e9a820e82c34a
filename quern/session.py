"""Session helpers shared by the library, the benchmark and the tests."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "quern") -> SparkSession:
    """A single-machine session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages: spark.checkpoint.dir. Only a local session may do without: it gets a folder of its
    own; on a cluster a machine's folder would be lost with it."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if not jsc.getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    own = tempfile.mkdtemp(prefix="quern-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def kept_rows(df: DataFrame) -> tuple[DataFrame, str]:
    """df as compressed files in the shared folder, and their path, which drop_rows() removes as soon as they are not needed."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_rows(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application, unless their path has it."""
    root, context = Path(__file__).resolve().parent.parent, spark.sparkContext
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p}
    if str(root) in known or context.applicationId in _SHIPPED:
        return
    folder = Path(tempfile.mkdtemp(prefix="quern-package-"))
    shutil.copytree(root / "quern", folder / "package" / "quern", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / "quern"), "zip", folder / "package"))
    _SHIPPED.add(context.applicationId)
