"""Pages as a stream: text out for each page in. A page is its own state, so there is no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagesieve.plans.pipelines import all_text


def page_text_stream(pages: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write (url, text) of a stream of (url, html) as Parquet; each micro-batch is one batch plan, written under its number,
    so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        all_text(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
