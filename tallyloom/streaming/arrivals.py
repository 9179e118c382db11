"""Upserting uploads as their files arrive.

No streaming operator of its own: new CSV files of one known header layout are picked up by
a file stream, and every micro-batch goes through the same cleaning and upsert as an upload.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyloom.operators.canonical import to_canonical, with_valid_keys
from tallyloom.operators.cleaning import Mapping, clean_upload
from tallyloom.schema import SEQ
from tallyloom.sources.store import SalesStore
from tallyloom.sources.uploads import value_or_null


def upsert_arrivals(
    store: SalesStore,
    folder: str,
    headers: list[str],
    mapping: Mapping,
    date_format: str,
    source: str,
    checkpoint: str,
) -> StreamingQuery:
    """Upsert every CSV file that is or comes into ``folder``, then stop.

    A repeated micro-batch leaves the same rows behind, since the upsert is by key. Files of
    one micro-batch are ordered by name, later micro-batches win over earlier ones.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # The row number is not available in a stream, only within its batches.
        seq = F.struct("path", "block", F.monotonically_increasing_id().alias("row"))
        rows = batch.withColumn(SEQ, seq).drop("path", "block")
        cleaned = clean_upload(rows, mapping, date_format)
        store.upsert(with_valid_keys(to_canonical(cleaned, mapping, source, datetime.now())))

    return (
        _arrivals(store.spark, folder, headers)
        .writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _arrivals(spark: SparkSession, folder: str, headers: list[str]) -> DataFrame:
    schema = ", ".join(f"`{h}` string" for h in headers)
    # a file whose header is not the known layout fails the stream instead of being read by position
    reader = spark.readStream.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", False)
    raw = reader.csv(folder)
    return raw.select(
        *[value_or_null(F.col(f"`{h}`")).alias(h) for h in headers],
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
    )
