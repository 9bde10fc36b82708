"""Scratch tables in the shared folder of the cluster.

Loops cut their lineage by writing each generation as a table here and reading it back.  A written
table survives lost executors, and its known size lets Catalyst choose the join.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set as checkpoint folder; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="murmuration-")
    return _LOCAL_ROOTS[application]


class Scratch:
    """One uniquely named folder per run; tables are addressed by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{scratch_root(spark).rstrip('/')}/murmuration-{uuid.uuid4().hex}"
        self._names: dict[str, None] = {}

    def path(self, name: str) -> str:
        self._names[name] = None
        return f"{self.folder}/{name}"

    def names(self) -> list[str]:
        return list(self._names)

    def drop(self, *names: str) -> None:
        """Delete tables by name, or all of them; what still reads them can no longer run."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for path in [f"{self.folder}/{n}" for n in names] or [self.folder]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` (replacing a table of that name) and return a scan of what was written.

        Positions and velocities are noise to a compressor, so the files are plain.
        """
        plain = {"compression": "none", "parquet.enable.dictionary": "false"}
        df.write.mode("overwrite").options(**plain).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))
