"""Streams of cells into stored arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_stream(cells: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a stream of cells i0..., value into the array stored at path; a batch that comes again changes nothing.

    In a directory of chunks a micro-batch fetches and puts only the chunks of
    its cells. In a versioned store it is a new version, which copies the
    table; readers there never see a part of a batch.
    """
    from ..operators.array import ArrayFrame, StoredArray
    from ..sources import store

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        versioned = store.exists(spark, f"{path}/current")
        array = ArrayFrame.open(spark, path) if versioned else StoredArray.open(spark, path)
        named = batch.select(*[batch[f"i{i}"].alias(f"o{i}") for i in range(array.meta.rank)], "value")
        if versioned:
            array.write(None, named).save(path)
        else:
            array.write(None, named)

    writer = cells.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
