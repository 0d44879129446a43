"""The resumable runner on a stream: each batch of damage records is repaired and appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textmend.sources.store import append_predictions, load_predictions


def stream_predictions(stream: DataFrame, repair: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """stream: damage records; repair makes store rows of a batch. A batch that comes again after a failure adds only keys
    that aren't stored, so each key is stored once."""

    def each(batch: DataFrame, number: int) -> None:
        rows = repair(batch.where("k > 0"))
        known = load_predictions(batch.sparkSession, path).select("id", "severity", "method", "method_version")
        append_predictions(rows.join(known, ["id", "severity", "method", "method_version"], "left_anti").dropDuplicates(["id", "severity", "method", "method_version"]), path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
