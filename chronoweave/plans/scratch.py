"""Intermediate tables in the folder that all executors share.

An iterative plan has to cut its lineage, and the cut must survive the loss of an executor. ``Scratch``
therefore writes Parquet below ``spark.checkpoint.dir`` (read from the session; a temporary folder of our
own is taken only where that setting is unset, as in local tests) and reads it back with a known schema.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_OPEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="chronoweave-")
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    return _FALLBACK[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _OPEN:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone already
            pass


class Scratch:
    """A folder of tables that live as long as the driver process."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._tables = 0
        _OPEN.append((spark, self.path))

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the table read back; its lineage ends at the files."""
        path = f"{self.path}/{self._tables}"
        self._tables += 1
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._chronoweave_path = path
        return back

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that no later plan reads."""
        path = getattr(df, "_chronoweave_path", None)
        if path:
            _delete(self.spark, path)
