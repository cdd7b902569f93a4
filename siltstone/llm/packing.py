"""Problem 7: filling fixed-capacity containers with items: variable-capacity best fit."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items packed together: a block wastes a few part-filled containers at most, whatever its size.
BLOCK_ITEMS = 32_768


class BestFit:
    """Best-fit decreasing over several permitted capacities at once.

    An item goes to the open bin with the least room that holds it. If there
    is none, a bin is opened of the size that costs least: for each permitted
    size the rest of the stock is looked ahead at (largest item that fits,
    again and again) and the size whose bin would leave the smallest share
    unused is taken, the larger of equals. In the end every bin is downsized
    to the smallest permitted size that holds its contents.
    """

    def __init__(self, capacities: Sequence[int]):
        self.capacities = sorted(set(int(c) for c in capacities))
        if not self.capacities or self.capacities[0] < 1:
            raise ValueError("capacities must be positive")

    def _fill(self, size: int, capacity: int, stock: list[int], sizes: int) -> int:
        """Contents of a new bin of one capacity that begins with an item, filled from the stock."""
        room, used = capacity - size, {}
        while room and (fit := sizes & ((1 << (room + 1)) - 1)):
            n = fit.bit_length() - 1
            k = min(room // n, stock[n] - used.get(n, 0))
            if k:
                used[n] = used.get(n, 0) + k
                room -= n * k
            if used.get(n, 0) >= stock[n]:
                sizes &= ~(1 << n)
        return capacity - room

    def _open(self, size: int, stock: list[int], sizes: int) -> int:
        best, cost = 0, 2.0
        for c in self.capacities:
            if c >= size:
                unused = 1 - self._fill(size, c, stock, sizes) / c
                if unused <= cost:
                    best, cost = c, unused
        return best

    def pack(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin of each item, capacity of each bin). Sizes are 1 to the largest capacity."""
        order = np.argsort(-sizes, kind="stable").tolist()
        stock = np.bincount(sizes, minlength=self.capacities[-1] + 1).tolist()
        present = sum(1 << n for n, k in enumerate(stock) if k and n)
        bins = np.zeros(len(sizes), np.int64)
        contents: list[int] = []
        # Open bins by room left, and which rooms occur, as the bits of one number.
        by_room: dict[int, list[int]] = {}
        rooms = 0
        for i in order:
            n = int(sizes[i])
            stock[n] -= 1
            if not stock[n]:
                present &= ~(1 << n)
            fit = rooms >> n
            if fit:
                room = n + (fit & -fit).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, b = self._open(n, stock, present), len(contents)
                contents.append(0)
            contents[b] += n
            bins[i] = b
            if left := room - n:
                by_room.setdefault(left, []).append(b)
                rooms |= 1 << left
        held = np.array(contents, np.int64)
        return bins, np.array(self.capacities, np.int64)[np.searchsorted(self.capacities, held)]


def split_items(items: DataFrame, capacity: int) -> DataFrame:
    """Items as parts: one, or if larger than the capacity full parts of it and a rest. Empty items have no part.

    doc_id, part, start_token, n_tokens.
    """
    last = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    parts = items.where(F.col("n_tokens") > 0).withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    start = (F.col("part") * F.lit(capacity).cast("bigint")).alias("start_token")
    return parts.select(
        "doc_id", "part", start, F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - start).alias("n_tokens")
    )


def pack(items: DataFrame, capacities: Sequence[int], block_items: int = BLOCK_ITEMS, rows: int | None = None) -> DataFrame:
    """Pack items (doc_id, n_tokens) into containers of the given capacities, optimised jointly.

    container_id, capacity, doc_id, part, start_token, n_tokens; every token of
    every item once, an item split only if it exceeds the largest capacity.

    Items are hashed into blocks whose number follows their count, and each
    block is packed on its own in one pass: at most ``block_items`` parts are
    held, more (repeated ids that hash alike) are packed in further rounds. No
    item is dropped; null, zero and negative sizes have no tokens and no
    container. Repeated doc_ids are packed as often as they occur.
    """
    caps = sorted(set(int(c) for c in capacities))
    fit = BestFit(caps)
    n_blocks = max(1, math.ceil((items.count() if rows is None else rows) / (block_items // 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, n, round_no = None, 0, 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            bins, sizes = fit.pack(t.column("n_tokens").to_numpy())
            ids = pa.array([f"{block}-{round_no}-{b}" for b in bins.tolist()], pa.string())
            columns = [ids, pa.array(sizes[bins], pa.int32())]
            columns += [t.column(c).combine_chunks() for c in ("doc_id", "part", "start_token", "n_tokens")]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return pa.RecordBatch.from_arrays(
                columns, ["container_id", "capacity", "doc_id", "part", "start_token", "n_tokens"]
            )

        for b in batches:
            blocks = b.column("_block").to_numpy()
            at = 0
            while at < len(b):
                if held and (blocks[at] != block or n >= block_items):
                    yield out()
                    held, n, round_no = [], 0, round_no + 1 if blocks[at] == block else 0
                block = int(blocks[at])
                end = min(int(np.searchsorted(blocks, block, "right")), at + block_items - n)
                held.append(b.slice(at, end - at))
                n += end - at
                at = end
        if held:
            yield out()

    parts = split_items(items, caps[-1]).withColumn("_block", F.pmod(F.xxhash64("doc_id", "part"), F.lit(n_blocks)))
    return (
        parts.repartition("_block")
        .sortWithinPartitions("_block", "doc_id", "part")
        .mapInArrow(
            run,
            "container_id string, capacity int, doc_id bigint, part int, start_token bigint, n_tokens bigint",
        )
    )


def fill_report(packed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Containers, tokens and the share of unused space by capacity, and by further columns."""
    each = packed.groupBy(*by, "container_id", "capacity").agg(F.sum("n_tokens").alias("n"))
    return each.groupBy(*by, "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("n").alias("n_tokens"),
        (1 - F.sum("n") / F.sum("capacity")).alias("unused_share"),
    )
