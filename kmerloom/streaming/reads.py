"""Long reads as a stream of files: each micro-batch is joined with the static counts and written in index order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import correct as C

SCHEMA = "read_index bigint, label string, seq string"


def correct_stream(spark: SparkSession, source: str, short_reads: DataFrame, target: str, checkpoint: str, p: C.Parameters = C.Parameters(), files_at_once: int = 8) -> StreamingQuery:
    """Parquet files of reads in `source` to Parquet of corrected reads in `target`; stops when all files are done.

    The accurate reads are counted once, before the first batch. A batch writes to a folder of its own name, so a batch that is run
    again replaces what it wrote.
    """
    tables = C.count_tables(short_reads, p)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(source)

    def one(batch: DataFrame, number: int) -> None:
        C.correct(batch, tables, p).orderBy("read_index").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
