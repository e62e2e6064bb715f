"""Uploads as a stream: chunk files are taken up as they come, each chunk once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanforge.sources.ingest import CHUNK, first_chunks


def chunk_stream(spark: SparkSession, source: str, files_per_batch: int = 1000) -> DataFrame:
    """Chunks from the Parquet files of a folder."""
    return spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files_per_batch).parquet(source)


def store_chunks(chunks: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write new chunks under ``target``, by project and kind.

    A batch is written to a folder of its own number, so one that is run again after a failure replaces itself.  The
    number is read again as ``batch``: ``ingest.first_chunks`` takes the chunk that came first when the upload is read.
    """

    def write(batch: DataFrame, number: int) -> None:
        first_chunks(batch.drop("batch")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(chunks: DataFrame) -> DataFrame:
    """Chunks received by project and kind, kept up to date."""
    return chunks.dropDuplicates(["project_id", "kind", "seq"]).groupBy("project_id", "kind").agg(F.count("*").alias("chunks"), F.max("seq").alias("last_seq"))
