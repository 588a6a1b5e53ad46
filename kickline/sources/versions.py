"""Tables with an archive: nothing is overwritten before the live version is kept.

A version is a folder of parquet files named by a counter; a small manifest of
JSON lines says which one is live, when it was archived and what it holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kickline.session import shared_dir

MANIFEST = ("version int, label string, event string, n_rows bigint, n_columns int, "
            "content string, at_us bigint")


class TableMissing(FileNotFoundError):
    pass


def content_hash(df: DataFrame) -> tuple[int, str]:
    """Row count and two order-free hashes of the whole content, one aggregate.

    A null is told from every value and counts by its place; names and types are part of the content.
    """
    marked = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    total = [F.sum(h.cast("decimal(38,0)")) for h in (F.xxhash64(*marked), F.xxhash64(F.lit("second"), *marked))]
    row = df.agg(F.count(F.lit(1)).alias("n"), total[0].alias("h"), total[1].alias("g")).first()
    return row.n, f"{row.n}:{row.h}:{row.g}:{','.join(f'{c} {t}' for c, t in df.dtypes)}"


def same_rows(one: DataFrame, other: DataFrame) -> bool:
    """Whether two tables of equal size and columns hold the same rows, repeats included."""
    return one.columns == other.columns and not one.exceptAll(other).take(1)


class VersionedTable:
    def __init__(self, spark: SparkSession, name: str, root: str | None = None, unique: bool = False):
        self.spark = spark
        base = root or f"{shared_dir(spark)}/tables"
        self.path = f"{base}/{name}" + (f"-{uuid.uuid4().hex[:12]}" if unique else "")

    # -- manifest ---------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def exists(self) -> bool:
        return self._exists(f"{self.path}/manifest")

    def manifest(self) -> DataFrame:
        if not self.exists():
            raise TableMissing(f"{self.path} has no version yet; write one first")
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")

    def _log(self, version: int, label: str, event: str, n: int, cols: int, content: str, at_us: int) -> None:
        row = self.spark.createDataFrame([(version, label, event, n, cols, content, at_us)], MANIFEST)
        row.coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _head(self):
        return (self.manifest().filter(F.col("event") != "snapshot")
                .orderBy(F.desc("at_us"), F.desc("version")).first())

    # -- data -------------------------------------------------------------------------------------

    def _dir(self, version: int) -> str:
        return f"{self.path}/data/v{version:06d}"

    def read(self, version: int | None = None) -> DataFrame:
        if not self.exists():
            raise TableMissing(f"{self.path} has no version yet; write one first")
        return self.spark.read.parquet(self._dir(self._head().version if version is None else version))

    def write(self, df: DataFrame, label: str, at_us: int | None = None, partition_by: list[str] | None = None) -> int:
        """New live version. Content equal to an archived version is not stored twice: that
        version becomes live again."""
        logged = self.manifest().collect() if self.exists() else []   # one short line per version
        version = max((r.version for r in logged), default=0) + 1
        at = at_us if at_us is not None else version
        w = df.write.mode("errorifexists").option("compression", "snappy")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(self._dir(version))
        n, content = content_hash(self.spark.read.parquet(self._dir(version)))
        alike = dict.fromkeys(r.version for r in logged if r.content == content)
        same = [v for v in alike if same_rows(self.spark.read.parquet(self._dir(version)), self.spark.read.parquet(self._dir(v)))]
        live = same[0] if same else version
        if same:   # the copy just written repeats an archived version
            fs, p = self._fs(self._dir(version))
            fs.delete(p, True)
        self._log(live, label, "write", n, len(df.columns), content, max(at, max((r.at_us for r in logged), default=0) + 1))
        return live

    def snapshot(self, label: str) -> int:
        """Names the live version; no data moves."""
        h = self._head()
        self._log(h.version, label, "snapshot", h.n_rows, h.n_columns, h.content, h.at_us)
        return h.version

    def restore(self, version: int, label: str = "restore") -> int:
        """Makes an archived version live. The version that was live stays archived."""
        rows = [r for r in self.manifest().filter(F.col("version") == version).limit(1).collect()]
        if not rows:
            raise TableMissing(f"{self.path} has no version {version}")
        head = self._head()
        self._log(version, label, "restore", rows[0].n_rows, rows[0].n_columns, rows[0].content, head.at_us + 1)
        return version

    def inventory(self) -> DataFrame:
        """One row per stored version with its latest label and whether it is live."""
        live = self._head().version
        return (self.manifest().groupBy("version")
                .agg(F.max("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns"),
                     F.max_by("label", "at_us").alias("label"), F.min("at_us").alias("first_at"))
                .withColumn("live", F.col("version") == live))

    def history(self) -> DataFrame:
        """Rows and columns gained or lost from one event to the next."""
        from pyspark.sql import Window
        w = Window.orderBy("at_us", "version")   # one row per version event
        m = self.manifest().filter(F.col("event") != "snapshot")
        return m.select("version", "label", "event", "at_us", "n_rows", "n_columns",
                        (F.col("n_rows") - F.lag("n_rows").over(w)).alias("d_rows"),
                        (F.col("n_columns") - F.lag("n_columns").over(w)).alias("d_columns"))
