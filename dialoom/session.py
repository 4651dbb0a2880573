"""Session helpers: table access, lineage cuts and shipping the package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that a local run or a test uses; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_SHIPPED: set[str] = set()
_TABLES: dict[str, list[str]] = {}


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "dialoom") -> SparkSession:
    """A session on this machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    session = builder.config(map=LOCAL_CONF).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # Executors fetch the file from the driver whenever they start, so it stays.
    folder = tempfile.mkdtemp(prefix="dialoom-package-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "dialoom_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    archive.write(full, os.path.join("dialoom", os.path.relpath(full, root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of a data folder."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where it has fewer partitions than there are cores: a
    small file is one split, and work per row would run in one task. A table with
    enough splits stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in
    spark.checkpoint.dir; only where that is unset (tests, a single machine) a
    local one is made."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        made = tempfile.mkdtemp(prefix="dialoom-")
        context.setCheckpointDir(made)
        atexit.register(shutil.rmtree, made, True)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from there, so that
    neither a lost executor nor a second use runs its plan again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/dialoom-{uuid.uuid4().hex}"
    keep(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, path: str) -> None:
    """Note a folder of this application, for `drop_cuts`."""
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)


def drop_cuts(spark: SparkSession) -> int:
    """Remove the tables that `cut` has written in this application, and return
    their number. To be called once no result that reads them is needed."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)
