"""Append-only ingestion: a stream's micro-batches become rows and commits of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, path: str, checkpoint: str, branch: str = "main", user: str | None = None, trigger: dict | None = None, index: str | None = None) -> StreamingQuery:
    """Appends every micro-batch of `stream` to the dataset, one commit a batch. A batch that was committed before a
    failure is known by its message and not added twice. index: a text column whose inverted index follows."""
    from versalake.dataset import dataset

    def batch(df: DataFrame, epoch: int) -> None:
        ds = dataset(f"{path}@{branch}" if branch != "main" else path, spark=df.sparkSession, user=user)
        ds.reset(force=True)
        message = f"stream batch {epoch}"
        if any(c["message"] == message for c in ds.commits()):
            return
        if not df.isEmpty():
            ds.extend_frame(df)
        ds.commit(message, allow_empty=True)
        if index:
            ds.create_index_vectorized(index)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
