"""Written intermediate tables: a folder that all executors share, and tables in it that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where it is unset and Spark runs on this machine alone (local tests)."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex[:12]}/{name}"
    _made.append((spark, path.rsplit("/", 1)[0]))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    """A point in the list of scratch tables, for `release`."""
    return len(_made)


def release(since: int) -> None:
    """Removes the scratch tables made since then, but the last: what they were for has been written to it."""
    for spark, path in _made[since:-1]:
        remove(spark, path)
    del _made[since:-1]


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the shared folder has its own clean-up
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the table to the shared folder and reads it back, so a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
