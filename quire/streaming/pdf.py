"""Extraction over streams of files.

Reading a file is stateless, so a stream gives what a batch over the same files
gives; modificationTime can carry a watermark for what follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.extract import PdfFrames
from quire.sources.pdf import stream_files


def stream_pdfs(spark: SparkSession, path: str, password: str = "", mode: str = "PERMISSIVE", **options) -> PdfFrames:
    """The tables of files as they arrive below ``path``; use one table per query."""
    return PdfFrames(stream_files(spark, path, **options), password, mode)


def write_available(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a streaming table to Parquet until all files present have been read."""
    return lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def pages_per_window(files: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files, readable files and pages that arrived in each window of modificationTime.

    A file is read once and becomes its time and number of pages.  Files later
    than ``late`` are dropped, and a window's state goes when it is past that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.kernel import extract
        from quire.kernel.errors import PdfError

        for batch in batches:
            pages = []
            for content in batch.column("content"):
                try:
                    pages.append(extract.inspect(content.as_buffer().to_pybytes() if content.is_valid else b"")["page_count"])
                except (PdfError, RecursionError):
                    pages.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("modificationTime"), pa.array(pages, pa.int64())], names=["modificationTime", "pages"])

    counted = files.select("modificationTime", "content").mapInArrow(run, "modificationTime timestamp, pages long")
    timed = counted.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window))
    return timed.agg(F.count("*").alias("files"), F.count("pages").alias("readable"), F.sum("pages").alias("pages"))
