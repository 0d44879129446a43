"""Seeded draws that depend only on their key: never on order, partition or engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: int, *key: Column | str) -> Column:
    """sha256 of seed:key:... in hexadecimal."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.lit(k) if isinstance(k, str) else k.cast("string") for k in key)), 256)


def draw(seed: int, *key: Column | str) -> Column:
    """An integer below 2**32."""
    return F.conv(F.substring(hash_key(seed, *key), 1, 8), 16, 10).cast("long")


def uniform(seed: int, *key: Column | str) -> Column:
    """A number from 0 to below 1."""
    return draw(seed, *key) / F.lit(4294967296.0)


def below(n: Column, seed: int, *key: Column | str) -> Column:
    """An integer below n."""
    return F.pmod(draw(seed, *key), n.cast("long")).cast("int")


def hash_places(df: DataFrame, key: Column, *ties: str, name: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in the order of a hexadecimal hash (and ties). No task orders all rows: the first three
    digits part them evenly into 4096 ranges, whose sizes (as many rows at most) give where each range starts."""
    rows = df.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 3))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key", *ties))
    return rows.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + inside).cast("int")).drop("_key", "_range", "_start")
