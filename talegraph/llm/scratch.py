"""Tables written between steps, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset on a local master (tests), a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        at = "file://" + tempfile.mkdtemp(prefix="talegraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows in a batch that goes to a Python task: few where whole texts come back, the default where a batch is combined.
TEXT_ROWS, COMBINED_ROWS = 2_000, 10_000


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Bound what one batch holds, for the jobs that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bound what one batch holds for the jobs inside, and for those only."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drawn(key: Column, wanted: int, n: int, seed: int) -> Column:
    """Whether a key is among about ``wanted`` of ``n``: by all 64 bits of its hash, so any share can be drawn."""
    if n <= wanted:
        return F.lit(True)
    return F.xxhash64(key.cast("string"), F.lit(seed)) < F.lit((wanted << 64) // n - (1 << 63))


#: Rows of a few numbers each that make a file worth its task.
FILE_ROWS = 100_000


class Scratch:
    """Writes tables that cut lineage; a lost executor costs no more than the step at hand."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """rows: about how many there are, where known, so a small table gets few files."""
        self.n += 1
        if rows is not None:
            most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df = df.coalesce(max(1, min(most, rows // FILE_ROWS + 1)))
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that save() wrote and that nothing lazy reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows up to which the small side of a join is broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20


def join_checked(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", weight: Column | None = None) -> DataFrame:
    """Join with a broadcast of ``small`` only if it was counted and is within the bounds.

    ``small`` should be a saved table.  weight: bytes of a row, 32 if None.  At most
    BROADCAST_ROWS + 1 rows are looked at."""
    row = small.limit(BROADCAST_ROWS + 1).select((weight if weight is not None else F.lit(32)).cast("long").alias("b")).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    if row[0] <= BROADCAST_ROWS and row[1] <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)
