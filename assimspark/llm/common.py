"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed pattern: a word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text):
    """Array of the words of a text column (none for null)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        jvm_dir = context._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            found = jvm_dir.get()
        elif context.master == "local" or context.master.startswith("local["):
            found = f"file://{tempfile.mkdtemp(prefix='assimspark-')}"
            context.setCheckpointDir(found)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs nothing that was written."""
    return _written(df, new_folder(df.sparkSession, what))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job in the shared folder, of which some go as soon as later ones hold what is needed of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, what: str) -> DataFrame:
        path = new_folder(self.spark, what)
        table = _written(df, path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more; tables that were not written here are left alone."""
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def settle(self) -> None:
        """Let the driver collect its garbage now: Spark deletes shuffle files once nothing in the driver refers to their shuffle any more."""
        gc.collect()
        self.spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand texts to Python in batches of so many rows at most, for jobs whose rows are whole documents: a worker holds one batch at a time.

    Results are computed later, so the setting stays; it is only ever lowered.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
