"""Session defaults and shared-folder handling used by every layer of the library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set by ``build_session`` unless the caller overrides them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and quiet UI; ``conf`` entries win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master may go without the setting; it then gets a temporary folder, which is
    remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def lenient_json(spark: SparkSession) -> None:
    """Of a JSON object's repeated key the last value counts, as browsers and most parsers have it."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


#: Rows and bytes of an Arrow batch between Spark and its Python workers.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to a size that long texts cannot blow up."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


#: Rows of a sort or a grouping that one task may hold at once.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to so many tasks that each gets about TASK_ROWS of ``rows``.

    Without a number Spark deals to a fixed count and joins small partitions up to a size in bytes as
    shuffled, so what a task holds would grow with the table.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(parts, *keys)


class Workspace:
    """Intermediate tables of one run, written as Parquet below the shared folder.

    A written table cuts the lineage and survives lost executors, and Spark knows its size, so
    the next join can choose its strategy. ``drop`` frees a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table as read back."""
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._plumbline_path = where  # noqa: SLF001
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm  # noqa: SLF001
        for table in tables:
            where = jvm.org.apache.hadoop.fs.Path(table._plumbline_path)  # noqa: SLF001
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def clean_workspaces(spark: SparkSession) -> None:
    """Delete all intermediate tables below the shared folder. Results that still read them must be written first."""
    jvm = spark._jvm  # noqa: SLF001
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/plumbline")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001
