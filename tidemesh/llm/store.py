"""Tables that cut lineage, in the folder shared by the driver and all executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Folders of the tables that stored() has written and that are still there.
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; only where it is unset and Spark runs in this process a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="tidemesh-")
        shared_folder.own = path
        path = f"file://{path}" if path.startswith("/") else path
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: later steps don't compute it anew, and lost executors lose nothing.

    The table stays as long as results may read it: until the scratch() around it ends, clear() or the driver's end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(nullable(df.schema)).parquet(path)


class Scratch:
    """Tables written since a scratch() began."""

    def __init__(self) -> None:
        self._kept: set[str] = set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """As stored(), for a table that outlives the scratch()."""
        out = stored(df, name)
        self._kept.add(_tables[-1])
        return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes the tables that stored() writes meanwhile, but for those kept."""
    began, own = set(_tables), Scratch()
    try:
        yield own
    finally:
        _delete(spark, [t for t in _tables if t not in began and t not in own._kept])


def clear(spark: SparkSession) -> None:
    """Deletes all tables that stored() has written; results that read them can't be computed any more."""
    _delete(spark, list(_tables))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _tables.remove(path)


@atexit.register
def _at_end() -> None:
    spark = SparkSession.getActiveSession() if _tables else None
    if spark is not None:
        try:
            clear(spark)
        except Exception:  # noqa: BLE001  Spark has ended already; its folder is the cluster's to clean
            pass


#: Rows in an Arrow batch. Spark's default of 10,000 long texts is much to hold several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most BATCH_ROWS rows: results are computed later, so the setting has to stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
