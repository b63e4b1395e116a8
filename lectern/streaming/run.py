"""Drive a streaming frame over what is available and read the result back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset the warehouse, or in local mode (tests) a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        at = spark.conf.get("spark.sql.warehouse.dir")
    if not at and not _own:
        _own.append(tempfile.mkdtemp(prefix="lectern-stream-"))
    return (at or f"file://{_own[0]}").rstrip("/")


def read_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A Parquet table (a file or a folder) as a stream of its files, in the schema of the files there are."""
    # a pattern that only the path itself matches: a plain path would have to be a folder
    only = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(only)


def last_updates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Run ``df`` in update mode until its input is used up; the last row of every key.

    Each micro-batch is written under its own id, so a batch that is run again
    after a failure replaces itself.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/lectern-stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/b={number}")

    q = df.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    out = spark.read.schema(StructType([*df.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{base}/out/*")
    rest = [c for c in df.columns if c not in keys]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r"))
    return last.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def staged(df: DataFrame, order: list[str], parts: int) -> str:
    """Write ``df`` as ``parts`` files, one after another in the order of ``order``: the path to read as a stream, a file a micro-batch."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/lectern-staged-{uuid.uuid4().hex}"
    cut = df.select(F.percentile_approx(order[0], [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    slice_of = sum((F.when(F.col(order[0]) > c, 1).otherwise(0) for c in cut), F.lit(0))
    for k in range(parts):
        df.where(slice_of == k).coalesce(1).write.mode("append").parquet(base)
    return base


def appended(df: DataFrame, base: str | None = None) -> DataFrame:
    """Run ``df`` in append mode until its input is used up; all its rows. With the same ``base`` a run goes on where the last one stopped."""
    spark = df.sparkSession
    base = base or f"{shared_dir(spark)}/lectern-stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/b={number}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    # keyed state of several variables needs this store
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = df.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
        q.awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return spark.read.schema(df.schema).parquet(f"{base}/out/*")
