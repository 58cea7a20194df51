"""Packing token sequences: first-fit decreasing in randomised groups.

Documents are tokenised and cut into pieces of at most ``length`` ids (whole
sequences and a rest). Pieces are dealt at random into groups of about
``group_size``; each group is packed on its own by first-fit decreasing. A
tournament tree over the bins' free space finds the first bin that fits in
logarithmic time. A group is bounded, so no task grows with the input.

Edge cases: a null or empty text has the end id alone; repeated rows are packed
one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwright.llm.textcore import slices
from sheetwright.llm.tokens import encoder
from sheetwright.llm.workspace import Workspace

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, draw long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bins:
    """First fit through a tournament tree: each node has the most free space below it."""

    def __init__(self, capacity: int, most: int):
        self.capacity = capacity
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.tree = [0] * (2 * self.leaves)
        self.used = 0

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, or a new one; the offset there."""
        tree, leaves = self.tree, self.leaves
        if tree[1] < size:
            node = leaves + self.used
            self.used += 1
            tree[node] = self.capacity
        else:
            node = 1
            while node < leaves:
                node *= 2
                if tree[node] < size:
                    node += 1
        offset = self.capacity - tree[node]
        found, room = node - leaves, tree[node] - size
        tree[node] = room
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left > right else right
            node >>= 1
        return found, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; equal sizes keep their order."""
    order = np.argsort(-sizes, kind="stable")
    bins, where, offsets = Bins(capacity, max(1, len(sizes))), np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for k in order.tolist():
        where[k], offsets[k] = bins.place(int(sizes[k]))
    return where, offsets


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """The pieces of every document, with a random draw that deals them into groups."""

    def cut(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer, end_id)
        random = np.random.default_rng([TaskContext.get().partitionId(), 5])
        for batch in slices(batches):
            doc_ids, out = batch.column("doc_id").to_pylist(), []
            for row, ids, bounds in encode.encode(batch.column("text")):
                data = ids.astype("<u4").tobytes()
                for k, (first, last) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    for start in range(first, last, length):
                        stop = min(start + length, last)
                        out.append((doc_ids[row + k], start - first, stop - start, zlib.crc32(data[4 * start : 4 * stop]), last - first))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array(random.integers(0, 1 << 62, len(out)))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, group_size: int = 8192) -> DataFrame:
    """A row for each piece with its sequence and its offset there."""
    space = Workspace(docs.sparkSession, "packing")
    pieces = space.save(token_pieces(docs, tokenizer, end_id, length), "pieces")  # tokenised once, drawn once
    groups = max(1, -(-pieces.count() // group_size))

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "draw"], ignore_index=True)
        where, offsets = first_fit_decreasing(frame["length"].to_numpy(), length)
        return frame.assign(sequence_id=frame["bucket"].to_numpy() * (1 << 32) + where, offset=offsets)[[x.split()[0] for x in PACKED.split(", ")]]

    return pieces.withColumn("bucket", F.col("draw") % F.lit(groups)).groupBy("bucket").applyInPandas(group, PACKED)
