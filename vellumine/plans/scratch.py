"""Tables that cut lineage, kept in the folder which all executors share."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings of a session that runs whole queries: rows are whole texts, and the shuffle files of a finished write are of no more use.
DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def prepare(spark: SparkSession) -> None:
    """For entry points alone: DEFAULTS where the session sets nothing itself. Operators change no setting."""
    for name, value in DEFAULTS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (clusters: use --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where none is named and the master is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="vellumine-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def sample_bound(count: int, n: int) -> int:
    """A bound on 63-bit hashes that about n to 2 n of count rows stay under, so that what is sorted for a sample does not grow with the input."""
    share = min(1.0, (1.5 * n + 20 + 4 * math.sqrt(n)) / max(1, count))
    return min((1 << 63) - 1, int(share * (1 << 63)))


class Scratch:
    """Parquet tables of one operator run, under the shared folder; removed when the driver ends, also if the session was stopped before.

    A table that has been written survives the loss of any executor, as it is read again from the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/vellumine-{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(path)
        self.files.deleteOnExit(path)  # by the driver's JVM, which outlives the session

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str, **tests: Column) -> tuple[DataFrame, dict[str, int]]:
        """As write(), with the number of its rows ("rows") and of those that pass each test, counted while they are written: no query more."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count(F.when(test, 1)).alias(c) for c, test in tests.items())), name)
        return out, seen.get

    def drop(self, name: str) -> None:
        self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)
