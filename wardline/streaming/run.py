"""Run a stream over what is there now, into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from wardline.sources.staging import shared_folder

#: State by key of any size: on disk, in the checkpoint, read in parts.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, path: str | None = None, state_partitions: int | None = None) -> DataFrame:
    """Process all available input of ``stream``, append it to Parquet files at ``path``, and read them.

    A stream keeps the number of state partitions it first starts with:
    ``state_partitions``, or by default one per core of the cluster.
    Progress is checkpointed next to the output, so a run that lost its
    executors or its driver goes on where it stopped.
    """
    spark = stream.sparkSession
    target = path or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    settings = {
        "spark.sql.shuffle.partitions": str(state_partitions or spark.sparkContext.defaultParallelism),
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:  # a query copies the settings when it starts
        query = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", f"{target}.progress")
            .trigger(availableNow=True)
            .outputMode("append")
            .start(target)
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)
