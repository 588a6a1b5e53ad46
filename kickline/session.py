"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
METHOD_LIMIT, COMPILED = "spark.sql.codegen.hugeMethodLimit", 8000   # HotSpot never compiles a longer method
BATCH_LIMIT, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20
_shipped: dict[str, str] = {}
_staged: dict[str, SparkSession] = {}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  driver_memory: str = "12g") -> SparkSession:
    spark = (SparkSession.builder.master(master).appName("kickline")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", driver_memory)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return ship(compile_wide(spark))


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application; their Python workers import it."""
    small_batches(spark)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        name, path = os.path.basename(package), os.path.join(tempfile.mkdtemp(prefix="package-"), "kickline_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, files in os.walk(package):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        out.write(full, os.path.join(name, os.path.relpath(full, package)))
        spark.sparkContext.addPyFile(path)
        _shipped[app] = path
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Every instant in this library is UTC; the zone is a runtime setting."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def compile_wide(spark: SparkSession) -> SparkSession:
    """Projections of many columns outgrow what the JVM compiles as one method and would be interpreted for every row.

    Spark's own limit is the longest legal method; with HotSpot's instead, such a stage runs as several methods that are compiled.
    """
    if int(spark.conf.get(METHOD_LIMIT)) > COMPILED:
        spark.conf.set(METHOD_LIMIT, str(COMPILED))
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """A batch of whole texts is held by the JVM, outside its heap, and by the Python worker at once, for every running task.

    Rows of a few hundred bytes reach Spark's limit of rows first, so only batches of long rows get smaller. A limit set by the user stays.
    """
    if spark.conf.get(BATCH_LIMIT, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_LIMIT, f"{BATCH_BYTES}b")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one named by spark.checkpoint.dir, else the warehouse.

    The same rule holds for every master. What is written there is removed when the driver ends.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    own = f"{root.rstrip('/')}/kickline/{spark.sparkContext.applicationId}"
    _staged[own] = spark
    return own


@atexit.register
def remove_staged() -> None:
    """Deletes the folders of this driver's applications through Spark's file system."""
    for own, spark in list(_staged.items()):
        jsc = spark.sparkContext._jsc
        if jsc is not None and not jsc.sc().isStopped():
            path = spark._jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
        _staged.pop(own)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts lineage like a checkpoint, outlives lost executors, and what is read
    back is columnar, so later jobs still prune columns and push filters down.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
