"""Registry of this subpackage's queries, and what they share."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a test table; further columns of the file, whatever their names, are not read."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*[F.col(f"`{c}`") for c in columns])


#: Shuffle files go when the action that wrote them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, packed: str | None = None) -> DataFrame:
    """The frame as a Parquet table in the checkpoint folder: cuts the lineage like a checkpoint, and packs narrow rows far better.

    Nothing reads the shuffle files behind it again, so they do not stay on disk beside those of the next step.
    ``packed`` names the compression, where it is not to be the session's.
    """
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(path, compression=packed)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)
