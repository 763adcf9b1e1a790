"""The same scan over streams of pages: micro-batches through the batch plans, with bounded deduplication state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kelpie.functions import urls
from kelpie.plans.scan import scan_pages, scan_text
from kelpie.sources.rules import Rule


def read_pages(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """A stream of page tables that arrive as Parquet files, with the time of arrival as ingested."""
    schema = "page_id long, url string, html string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path).withColumn("ingested", F.current_timestamp())


def unseen_pages(pages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each canonical URL once; a URL is forgotten when the watermark has passed it, so state stays bounded."""
    keyed = pages.withColumn("canon", urls.canonical(F.col("url")))
    return keyed.withWatermark("ingested", delay).dropDuplicatesWithinWatermark(["canon"])


def findings_of_text(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings in a stream of free text: a stateless plan."""
    return scan_text(docs, rules, id_col, text)


def run(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, rules: list[Rule] | None = None, once: bool = True) -> StreamingQuery:
    """Scans every micro-batch and gives its findings to the sink with the batch's number, by which it can be idempotent."""

    def each(batch: DataFrame, number: int) -> None:
        sink(scan_pages(batch, rules).findings, number)

    writer = pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
