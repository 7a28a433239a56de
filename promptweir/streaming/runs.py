"""Running a stream over the data at hand into files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptweir.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file stream over the table ``name`` of a folder, a file or a folder of files, with
    the schema it has now."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name[:-1]}[{name[-1]}]")  # a stream takes one file only by a pattern


def run_available(stream: DataFrame, purpose: str, keyed_state: bool = False, base: str | None = None,
                  partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Processes all input that is available and returns what was written.

    Output and progress go to a folder, a fresh one in the shared folder unless ``base`` names one that
    an earlier run has left: a run continues where the last one in its folder ended.
    """
    spark = stream.sparkSession
    base = base or shared_dir(spark, purpose)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    if keyed_state:
        spark.conf.set(provider, ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{base}/progress").option("path", f"{base}/rows").partitionBy(*partition_by)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        if keyed_state and before is not None:
            spark.conf.set(provider, before)
        elif keyed_state:
            spark.conf.unset(provider)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
