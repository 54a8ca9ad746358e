"""Continuous ingest: each micro-batch becomes segments of an index, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Index
from ..sources.ingest import MAX_DOCS, lines

#: How long a batch may wait, and how much one takes, by default.
INTERVAL = "60 seconds"
MAX_BYTES = 128 << 20


def stream_ndjson(index: Index, path: str, checkpoint: str, interval: str | None = INTERVAL, max_files: int | None = None, max_bytes: int | None = MAX_BYTES, max_docs: int = MAX_DOCS, name: str = "stream") -> StreamingQuery:
    """Ingests a folder's JSON line files as they appear. interval None: what is there now, then stop.

    The stream's offset log takes the place of a write-ahead log. A batch is named after the stream and
    its number, and an index doesn't take a name twice, so a batch that is run again after a failure adds nothing.
    """
    reader = index.spark.readStream.format("text")
    # the two limits exclude each other
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    elif max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)

    def flush(batch: DataFrame, number: int) -> None:
        index.add(lines(batch), batch=f"{name}-{number:09d}", max_docs=max_docs)

    writer = reader.load(path).writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()
