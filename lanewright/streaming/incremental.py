"""Incremental runs: only lanes that the cache lacks are computed, in batches of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.operators.graph import latest, missing


def read_cache(spark, path: str, schema: str) -> DataFrame:
    """The cached results, the last of each lane; empty if there are none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    rows = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    return latest(rows, ["lane_id"], "written")


def compute_missing(wanted: DataFrame, path: str, schema: str, compute: Callable[[DataFrame], DataFrame], written: int) -> DataFrame:
    """Appends ``compute`` of the lanes in ``wanted`` that the cache at ``path`` lacks; returns the whole cache."""
    spark = wanted.sparkSession
    new = compute(missing(wanted, read_cache(spark, path, schema), "lane_id")).withColumn("written", F.lit(written).cast("long"))
    names = [c.split()[0] for c in schema.split(", ")]
    new.select(*names).write.mode("append").parquet(path)
    return read_cache(spark, path, schema)


def run_stream(lanes: DataFrame, path: str, schema: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A query that feeds each micro-batch of a stream of lanes through ``compute_missing``."""

    def batch(rows: DataFrame, number: int) -> None:
        compute_missing(rows.dropDuplicates(["lane_id"]), path, schema, compute, number)

    return lanes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
