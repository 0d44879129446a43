"""How the numpy operators move data: rows are dealt to chunks by key, each chunk packs what it has for each bucket into one binary row, and buckets answer chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmend.sources.store import checkpointed, shared_folder  # noqa: F401 (for the operators)


def sized(docs: DataFrame, text: str) -> int:
    """Bytes of text in all rows."""
    return docs.select(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def chunked(docs: DataFrame, columns: dict, key: list, chunks: int) -> DataFrame:
    """The named columns and chunk, a number below chunks that depends on the key columns alone."""
    return docs.select(*(c.alias(n) for n, c in columns.items()), F.pmod(F.xxhash64(*key), F.lit(chunks)).cast("int").alias("chunk"))


def counts(total: int, chunk_bytes: int, bucket_bytes: int) -> tuple[int, int]:
    """Chunks and buckets for so many bytes of text."""
    return max(1, -(-total // chunk_bytes)), max(1, -(-total // bucket_bytes))


def summed(df: DataFrame, count, size: int):
    """The sum of count(batch), a vector of size numbers, over all rows; df's first column is a text. Each task sums up
    its own rows. The tasks' vectors are added in 8 parts and in levels, at most 256 of them at once, so no task's input
    grows with the number of tasks (up to 2**24 of them)."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from .arrays import lean, pieces

    def each(batches):
        lean()
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                total += count(part)
        cut = np.array_split(total, 8)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(8), pa.int32()), pa.array([task] * 8, pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], names=["part", "task", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["total"].to_pylist())
        return pa.table({"part": pa.array(table["part"].to_pylist()[:1], pa.int32()), "task": pa.array(table["task"].to_pylist()[:1], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, task int, total binary"
    rows = df.mapInArrow(each, schema)
    for _ in range(3):
        rows = rows.withColumn("task", F.shiftright("task", 8)).groupBy("part", "task").applyInArrow(add, schema)
    rows = rows.collect()
    return np.concatenate([np.frombuffer(r.total, np.int64) for r in sorted(rows)]) if rows else np.zeros(size, np.int64)
