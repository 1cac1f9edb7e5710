"""Filling containers of fixed capacity, by bounded-space online packing.

Every partition keeps a fixed number of open windows. Items arrive in short runs, the largest of a run first. An item goes to the window in which it leaves the
least room; where it fits none, the fullest window is emitted and a new one opened. What is still open at the end of
the partitions is merged in rounds, groups of partitions at a time, until one group is left.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import checkpointed


class Windows:
    """A fixed number of open windows over one stream of sizes."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.open: list[tuple[int, int]] = []  # (room, number), ascending
        self.started = 0

    def place(self, size: int) -> tuple[int, int | None]:
        """(number of the window that takes the item, number of the window emitted for it or None)."""
        at = bisect_left(self.open, (size, -1))
        emitted = None
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            if len(self.open) >= self.windows:
                emitted = self.open.pop(0)[1]
            room, number = self.capacity, self.started
            self.started += 1
        if room == size:
            emitted = number if emitted is None else emitted
        else:
            insort(self.open, (room - size, number))
        return number, emitted


def pack_stream(sizes: np.ndarray, capacity: int, windows: int) -> tuple[np.ndarray, set[int]]:
    """(window of each item, windows still open at the end) for sizes from 0 to the capacity."""
    w = Windows(capacity, windows)
    taken = np.array([w.place(s)[0] for s in sizes.tolist()], dtype=np.int64)
    return taken, {number for _, number in w.open}


def pieces(items: DataFrame, key: str, size: Column, capacity: int) -> DataFrame:
    """(key, piece, size): items above the capacity cut into full pieces and a rest, all others whole, as piece 0."""
    sized = items.select(key, size.cast("long").alias("whole"))
    counts = F.greatest(F.lit(1), F.ceil(F.col("whole") / F.lit(capacity))).cast("int")
    return sized.select(key, "whole", F.explode(F.sequence(F.lit(0), counts - 1)).alias("piece")).select(
        key, "piece", F.least(F.lit(capacity), F.col("whole") - F.col("piece").cast("long") * capacity).alias("size")
    )


def runs_largest_first(sizes: np.ndarray, run: int) -> np.ndarray:
    """An order that keeps runs of so many items in place and sorts each by size, descending."""
    return np.lexsort((np.arange(len(sizes)), -sizes, np.arange(len(sizes)) // run))


def _packed(parts: DataFrame, key: str, capacity: int, windows: int, run_items: int) -> DataFrame:
    kind = parts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        table = table.take(pa.array(runs_largest_first(table["size"].to_numpy(), run_items)))
        taken, left = pack_stream(table["size"].to_numpy(), capacity, windows)
        part = table["part"][0].as_py()
        still = np.isin(taken, np.fromiter(left, dtype=np.int64, count=len(left)))
        out = table.select(["item", "piece", "size"]).append_column("part", pa.array(np.full(len(taken), part), pa.int32()))
        out = out.append_column("window", pa.array(taken, pa.int64())).append_column("open", pa.array(still))
        yield from out.to_batches()

    return parts.select(F.col(key).alias("item"), "piece", "size", F.spark_partition_id().alias("part")).mapInArrow(
        run, f"item {kind}, piece int, size long, part int, window long, open boolean"
    )


def _merged(left: DataFrame, kind: str, group: Column, capacity: int, windows: int) -> DataFrame:
    """Best fit, largest first, of the open windows of each group, every window as one item; of the windows that result
    only the ``windows`` emptiest stay open, so that a group of the next round is bounded too."""

    def run(rows: pa.Table) -> pa.Table:
        part, window = rows["part"].to_numpy().astype(np.int64), rows["window"].to_numpy()
        names, first, of = np.unique(np.stack([part, window], 1), axis=0, return_index=True, return_inverse=True)
        of = of.ravel()
        used = np.bincount(of, weights=rows["size"].to_numpy()).astype(np.int64)
        order = np.lexsort((names[:, 1], names[:, 0], -used))
        taken, still = pack_stream(used[order], capacity, len(order))
        filled = np.bincount(taken, weights=used[order]) if len(order) else np.zeros(0)
        still = set(sorted(still, key=lambda w: (filled[w], w))[:windows])
        home = np.empty(len(order), dtype=np.int64)
        home[order] = taken
        lead = np.full(int(taken.max(initial=-1)) + 1, -1, dtype=np.int64)
        lead[taken[::-1]] = order[::-1]  # each merged window keeps the name of its first member
        best = names[lead[home[of]]]
        return (
            rows.select(["item", "piece", "size"])
            .append_column("part", pa.array(best[:, 0], pa.int32()))
            .append_column("window", pa.array(best[:, 1], pa.int64()))
            .append_column("open", pa.array(np.isin(home[of], np.fromiter(still, dtype=np.int64, count=len(still)))))
        )

    return (
        left.withColumn("group", group)
        .groupBy("group")
        .applyInArrow(
            lambda t: run(t.drop_columns(["group"])),
            f"item {kind}, piece int, size long, part int, window long, open boolean",
        )
    )


def pack(
    items: DataFrame,
    key: str,
    size: Column,
    capacity: int,
    windows: int = 256,
    run_items: int = 512,
    items_per_partition: int = 200_000,
    fan_in: int = 32,
) -> DataFrame:
    """(key, container, piece): every item in one container of the capacity, longer ones cut into pieces of that size.

    items has one row per key. A null key or size is left out, a size below 0 counts as 0; an item of size 0 takes a
    place but no room; sizes above the capacity are the only ones cut, and piece counts from 0. Containers are numbered
    from 0 without gaps. The result depends on the items only: partitions are hashed by key and sorted by it, so a
    lost task is repeated with the same outcome.

    The number of partitions follows the number of items. Rounds of merging take ``fan_in`` partitions to
    a task, each with at most ``windows`` open windows, and end when one group is left.
    """
    if capacity < 1 or windows < 1 or fan_in < 2:
        raise ValueError("capacity and windows must be at least 1, fan_in at least 2")
    kind = items.schema[key].dataType.simpleString()
    clean = items.where(F.col(key).isNotNull() & size.isNotNull()).select(key, F.greatest(size.cast("long"), F.lit(0)).alias("whole"))
    # checkpointed so that the rows are counted and packed from the same copy
    parts = checkpointed(pieces(clean, key, F.col("whole"), capacity))
    n = max(1, -(-parts.count() // items_per_partition))
    spread = parts.repartition(n, key).sortWithinPartitions(key, "piece")
    packed = checkpointed(_packed(spread, key, capacity, windows, run_items))
    done = [packed.where(~F.col("open"))]
    left, span = packed.where("open"), 1
    while True:
        span *= fan_in
        merged = _merged(left, kind, F.floor(F.col("part") / F.lit(span)), capacity, windows)
        if span >= n:
            done.append(merged)
            break
        merged = checkpointed(merged)
        done.append(merged.where(~F.col("open")))
        left = merged.where("open")
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return _numbered(rows, key)


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """Container numbers without gaps from (part, window): windows ranked within their part, behind those of earlier
    parts. The number of windows of each part is one small row, joined back."""
    ranked = rows.select(
        "item", "piece", "part", F.dense_rank().over(Window.partitionBy("part").orderBy("window")).alias("nth")
    )
    counts = rows.groupBy("part").agg(F.countDistinct("window").alias("windows"))
    before = counts.select(
        "part", (F.sum("windows").over(Window.orderBy("part")) - F.col("windows")).alias("before")
    )
    return ranked.join(before, "part").select(
        F.col("item").alias(key), (F.col("before") + F.col("nth") - 1).alias("container"), "piece"
    )
