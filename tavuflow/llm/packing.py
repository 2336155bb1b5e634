"""Problem 9: items of varying size put into containers of fixed capacity, shortest pack first over the size histogram.

The histogram of sizes has at most ``capacity`` entries whatever the data, so the plan is made on the driver: sizes are
placed longest first, each into the container with the most room, whole ranges of alike containers at a time. Each placement
is a range of ranks within a size; the items join it by their rank. An item above the capacity is cut into full containers
and a rest; items of size 0 or null, and null ids, need no container. Equal sizes are ranked by id, so ties are settled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavuflow.session import bounded, materialize

#: Items of a size that are ranked together, about, and the least number of such groups.
ROWS_PER_SALT, LEAST_SALTS = 1_000_000, 16


def plan_packs(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (size, first rank, first container, items of the size in each container), and the number of containers.

    Rank r of a size in the row's range goes to container first + (r - first rank) // items.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free space: ranges (first container, count)
    rows: list[tuple[int, int, int, int]] = []
    made = 0
    for size in sorted(histogram, reverse=True):
        left, rank = int(histogram[size]), 0
        while left:
            free = max(room, default=0)
            if free >= size:
                first, count = room[free].pop()
                if not room[free]:
                    del room[free]
                times = 1
            else:
                times = min(capacity // size, left)
                first, count, free = made, left // times, capacity
                made += count
            used = min(count, left // times)
            if used < count:
                room.setdefault(free, []).append((first + used, count - used))
            rows.append((size, rank, first, times))
            if free - times * size:
                room.setdefault(free - times * size, []).append((first, used))
            left -= used * times
            rank += used * times
    return np.array(rows, np.int64).reshape(-1, 4), made


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(container_id, key, part, start_at, n): which part of each item, from start_at on, n long, lies in which container."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = items.sparkSession
    whole = items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).filter("key is not null and size > 0")
    parts = whole.select(
        "key",
        F.posexplode(F.expr(f"sequence(0L, size - 1, {capacity}L)")).alias("part", "start_at"),
        "size",
    ).select("key", "part", "start_at", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start_at")).alias("n"))
    parts = materialize(parts, "pack")
    total = parts.count()
    salts = max(LEAST_SALTS, total // ROWS_PER_SALT)
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("key", "part"), F.lit(salts)))
    cells = materialize(parts.groupBy("n", "salt").agg(F.count("*").alias("c")), "cells")
    histogram = {r["n"]: r["c"] for r in cells.groupBy("n").agg(F.sum("c").alias("c")).collect()}  # at most capacity rows
    plan, _ = plan_packs(histogram, capacity)
    span = max(histogram.values(), default=0) + 1
    order = np.argsort(plan[:, 0] * span + plan[:, 1])
    plan = plan[order]
    keys = plan[:, 0] * span + plan[:, 1]
    shared = spark.sparkContext.broadcast((keys, plan))  # bounded by capacity: each size is placed in a few ranges
    # A rank within its salt, and the items of the size in the salts before it: one row for each size and salt.
    before = Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("n", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    ranked = parts.withColumn("at", F.row_number().over(Window.partitionBy("n", "salt").orderBy("key", "part")) - 1)
    ranked = ranked.join(bounded(offsets), ["n", "salt"]).withColumn("rank", F.col("at") + F.col("offset"))
    kind = items.schema[key].dataType
    schema = T.StructType([T.StructField("container_id", T.LongType()), T.StructField(key, kind), T.StructField("part", T.IntegerType()), T.StructField("start_at", T.LongType()), T.StructField("n", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, plan = shared.value
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = np.searchsorted(keys, n * span + rank, side="right") - 1
            box = plan[row, 2] + (rank - plan[row, 1]) // plan[row, 3]
            yield pa.RecordBatch.from_arrays([pa.array(box), batch.column("key"), batch.column("part"), batch.column("start_at"), batch.column("n")], schema.names)

    return ranked.select("key", "part", "start_at", "n", "rank").mapInArrow(place, schema)
