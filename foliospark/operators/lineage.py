"""Cuts lineage in iterative operators, and names the folder for tables that operators write."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set a local session gets a temporary one; on a
    cluster, whose machines would not see it, that is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        by_hand = sc._jsc.sc().getCheckpointDir()
        root = by_hand.get() if by_hand.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="foliospark-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_made: dict[str, SparkSession] = {}


@atexit.register
def _clean() -> None:
    """Removes at the driver's end what it has written for itself."""
    for path, spark in _made.items():
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: the folder is the cluster's to clear
            return


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/foliospark-{kind}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as a table and read again. Its size is then known: what is guessed through a
    chain of checkpoints multiplies with every join, until planning takes longer than the work."""
    path = own_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
