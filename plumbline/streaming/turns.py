"""The hourly turn as a stream with exact writes: a batch that is run again changes nothing.

State tables are versions below a folder, one a batch. A batch reads the version of the last batch in
the ledger before it, writes its own version (over what an unfinished run of it left), and then enters
itself in the ledger. A batch that is in the ledger is done and is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import catalog


class Ledger:
    """Versions of tables by batch: ``<root>/<table>/v=<batch>`` and ``<root>/ledger/v=<batch>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def batches(self) -> list[int]:
        where, fs = self._fs(f"{self.root}/ledger")
        return sorted(int(f.getPath().getName()[2:]) for f in fs.listStatus(where)) if fs.exists(where) else []

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """A table as the last finished batch (before one) left it."""
        last = max(b for b in self.batches() if before is None or b < before)
        return self.spark.read.parquet(f"{self.root}/{table}/v={last}")

    def write(self, batch: int, **tables: DataFrame) -> None:
        """All tables of a batch, then its entry in the ledger, which is what makes them count."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={batch}")
        where, fs = self._fs(f"{self.root}/ledger/v={batch}")
        fs.create(where, True).close()


def start(ledger: Ledger, runs: DataFrame, journeys: DataFrame) -> None:
    """The tables as they are before the first batch."""
    ledger.write(-1, runs=runs, journeys=journeys, claims=journeys.select("id").limit(0).withColumn("at", F.lit(None).cast("timestamp")))


def turn(ledger: Ledger, limit: int = 3):
    """The function of ``foreachBatch``: one scheduled turn for each tick (at, failed array of ids) of a batch, in order.

    A tick sweeps stale runs, claims the due journeys and releases those whose start failed. Ticks are
    few; a batch that was done before is left alone.
    """

    def run(ticks: DataFrame, batch: int) -> None:
        if batch in ledger.batches():
            return
        runs, journeys, claims = (ledger.read(t, batch) for t in ("runs", "journeys", "claims"))
        for tick in ticks.orderBy("at").toLocalIterator():
            now = F.lit(tick.at).cast("timestamp")
            done = catalog.tick(runs, journeys, now, limit)
            failed = list(tick.failed or [])
            started = done["due"].filter(~F.col("id").isin(failed)) if failed else done["due"]
            free = done["due"].filter(F.col("id").isin(failed)).select("id") if failed else done["due"].select("id").limit(0)
            claims = claims.unionByName(started.select("id", now.alias("at")))
            runs, journeys = done["runs"], catalog.release_claims(done["journeys"], free)
        ledger.write(batch, runs=runs, journeys=journeys, claims=claims)

    return run
