"""Session helpers: shared storage for intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that is ever sent to every executor.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A temporary folder is set only in local mode, where the session names none. On a cluster that is an error: each executor
    would write to a disk of its own.
    """
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="loomfit-")
        spark.sparkContext.setCheckpointDir(d)
    return d


@dataclass
class Stored:
    """A table written to the shared folder; it cuts lineage and outlives executors."""

    df: DataFrame
    path: str

    def count(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        """Delete the files. Only for tables no later result reads."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str, by: str | None = None) -> Stored:
    """Write ``df`` as a parquet table in the shared folder, in a folder per value of ``by`` if given, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomfit/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def clear(spark: SparkSession) -> None:
    """Delete every table :func:`store` has left in the shared folder, once no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/loomfit")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its known number of rows is within the limit, else as it is.

    Beyond the limit Spark joins by shuffling both sides (AQE splits skewed partitions).
    """
    return F.broadcast(df) if rows <= limit else df


def tasks(rows: int, each: int) -> int:
    """Tasks for so many counted rows: the partitions of a shuffle whose tasks shall not grow with the data."""
    return max(1, -(-rows // each))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_loomfit_shipped", False):
        return
    root = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="loomfit-")) / "loomfit.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("loomfit") / p.relative_to(root)))
    sc.addPyFile(str(file))
    sc._loomfit_shipped = True
