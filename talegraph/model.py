"""The graph as DataFrames, and what iterations need."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """node: id, kind, title, summary, props (JSON), story_from, story_to, reveal_at, tx_from, tx_to, origin, locked, rev
    edge: src, dst, rel, hard, story_from, story_to, tx_to, confidence"""

    node: DataFrame
    edge: DataFrame
    node_alias: DataFrame
    node_tag: DataFrame
    visibility: DataFrame
    evidence: DataFrame

    @property
    def live_node(self) -> DataFrame:
        return self.node.where("tx_to is null")

    @property
    def live_edge(self) -> DataFrame:
        return self.edge.where("tx_to is null")

    def as_views(self, prefix: str = "") -> None:
        """Register every table and live view for SQL."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(prefix + f.name)
        self.live_node.createOrReplaceTempView(prefix + "live_node")
        self.live_edge.createOrReplaceTempView(prefix + "live_edge")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset on a local master, as in tests, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        at = "file://" + tempfile.mkdtemp(prefix="talegraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Cut the lineage of an iteration's table: written once in the folder that the cluster shares, by columns if any are named, and read again."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def among(df: DataFrame, column, values: DataFrame, most: int = 64) -> DataFrame:
    """Rows of df whose column may be one of values, a table of one column: if its distinct values are few the rest is left out before any shuffle."""
    few = [r[0] for r in values.distinct().limit(most + 1).collect()]
    return df.where(column.isin([x for x in few if x is not None])) if len(few) <= most else df


def head(ident) -> F.Column:
    """What stands before the first slash of an id: its kind, so the values are few."""
    return F.substring_index(ident, "/", 1)


#: Rows that one task should sort or hold.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt out by key to as many tasks as rows asks for, so what one task holds does not follow the input."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


@contextmanager
def tasks_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of the jobs inside, and of those only, are dealt to as many tasks as rows asks for."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, max(int(before), -(-rows // TASK_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bound what an Arrow batch holds for the jobs inside, and for those only."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(g: Graph) -> Graph:
    """The graph as tables written once, nodes by kind and edges by relation, for operators that read it many times."""
    spark = g.node.sparkSession
    at = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    by = {"node": "kind", "edge": "rel"}
    tables = {}
    for f in fields(g):
        df = getattr(g, f.name)
        if f.name in by:
            df.write.partitionBy(by[f.name]).parquet(f"{at}/{f.name}")
            df = spark.read.schema(df.schema).parquet(f"{at}/{f.name}").select(*df.columns)
        tables[f.name] = df
    return Graph(**tables)


def one_if(condition) -> F.Column:
    return F.when(condition, 1).otherwise(0)
