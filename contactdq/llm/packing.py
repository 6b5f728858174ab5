"""Best-fit packing in rounds over a tree.

Documents are encoded and cut into pieces where they are read. Each task packs its own pieces best-fit, longest first. Full and nearly
full bins (``nearly`` of the capacity) are final. Two bins can only be merged if one is at most half full, and local best fit leaves at most one such bin
for each pack of a task. So the bins that go on, as items of the next round, are the half-full ones and a few times as many of the roomiest others that
can take the smallest; all the rest are final. Each round deals them to one task for ``FAN_IN`` half-full bins and packs them best-fit
again, until one task holds them or no half-full bin is left. What goes on is in proportion to the tasks, not to the documents. A bin carries its
pieces along (never more than its capacity in number), so merging bins moves rows, not joins.

Edge cases: a null or empty text is its end id alone. Repeated rows and null ids are packed row by row. A very long text is cut into full pieces after
a shorter first one. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactdq.llm.common import slices, written
from contactdq.llm.encoding import encoder

CAPACITY = 1024
TASK_BINS = 50_000
NEARLY = 0.995
FAN_IN = 64  # half-full bins, and so packs of the round before, that meet in one task
PARTNERS = 8  # roomy bins that go on for each half-full one

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BIN_SCHEMA = pa.schema([("bin", pa.int64()), ("fill", pa.int32()), ("pieces", pa.list_(_PIECE))])
_BIN = "bin long, fill int, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document of n tokens: the first may be shorter, the rest are full."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def best_fit(fills: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins as lists of item numbers: each item, longest first, goes to the fullest bin that takes it."""
    order = sorted(range(len(fills)), key=lambda i: (-fills[i], i))
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted rooms that some bin has
    for i in order:
        need = fills[i]
        at = bisect_left(rooms, need)
        if at == len(rooms):
            bins.append([i])
            chosen, room = len(bins) - 1, capacity
        else:
            room = rooms[at]
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[chosen].append(i)
        left = room - need
        if left > 0:
            if not by_room.get(left):
                by_room[left] = []
                rooms.insert(bisect_left(rooms, left), left)
            by_room[left].append(chosen)
    return bins


def _name(turn: int, part: int) -> int:
    return (turn << 56) | (part << 32)


def _packed(rows: list[tuple[int, list]], capacity: int, name: int) -> tuple[list, int]:
    out = []
    for chosen in best_fit([fill for fill, _ in rows], capacity):
        out.append({"bin": name, "fill": sum(rows[i][0] for i in chosen), "pieces": [p for i in chosen for p in rows[i][1]]})
        name += 1
    return out, name


def _batches(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_pylist(rows[i : i + 4096], _BIN_SCHEMA)


def _first_round(tokenizer: str, keeps_space: bool, end_id: int, capacity: int, task_bins: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, keeps_space), np.array([end_id], np.uint32)
        name, held = _name(0, TaskContext.get().partitionId()), []
        for batch in slices(batches):
            full = []
            for doc, own in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1))):
                ids = np.concatenate((own, end)).astype("<u4")
                start = 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    piece = {"doc_id": doc, "piece": k, "start": start, "length": n, "ids_crc32": zlib.crc32(ids[start : start + n].tobytes())}
                    start += n
                    if n == capacity:
                        full.append({"bin": name, "fill": n, "pieces": [piece]})
                        name += 1
                    else:
                        held.append((n, [piece]))
            yield from _batches(full)
            if len(held) >= task_bins:
                rows, name = _packed(held, capacity, name)
                yield from _batches(rows)
                held = []
        rows, name = _packed(held, capacity, name)
        yield from _batches(rows)

    return pack


def _next_round(turn: int, capacity: int, task_bins: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = _name(turn, TaskContext.get().partitionId()), []
        for batch in batches:
            held += zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            if len(held) >= 2 * task_bins:
                rows, name = _packed(held, capacity, name)
                yield from _batches(rows)
                held = []
        rows, name = _packed(held, capacity, name)
        yield from _batches(rows)

    return pack


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, keeps_space: bool = True, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", task_bins: int = TASK_BINS, nearly: float = NEARLY
) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``nearly`` is the part of the capacity from which a bin counts as full. ``task_bins`` bounds what a task holds.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    now = written(base.mapInArrow(_first_round(tokenizer, keeps_space, end_id, capacity, task_bins), _BIN), "bins")
    done, turn, full, parts = [], 0, int(nearly * capacity), None
    while True:
        # One row for each fill: never more than the capacity.
        fills = {r["fill"]: r["count"] for r in now.filter(F.col("fill") < full).groupBy("fill").count().collect()}
        small = sum(n for f, n in fills.items() if 2 * f <= capacity)
        if not small or sum(fills.values()) < 2 or parts == 1:
            done.append(now)
            break
        most, wanted = min(fills), PARTNERS * small
        for fill in sorted(f for f in fills if 2 * f > capacity and f + min(fills) <= capacity):
            if wanted <= 0:
                break
            most, wanted = fill, wanted - fills[fill]
        open_ = (F.col("fill") < full) & ((2 * F.col("fill") <= capacity) | (F.col("fill") <= most))
        done.append(now.filter(~open_))
        turn += 1
        parts = -(-small // FAN_IN)
        again = now.filter(open_)
        dealt = again.coalesce(1) if parts == 1 else again.repartition(parts, F.xxhash64("bin", F.lit(turn)))
        now = written(dealt.mapInArrow(_next_round(turn, capacity, task_bins), _BIN), "bins")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    placed = every.select(
        F.col("bin").alias("sequence_id"),
        F.inline(F.expr("transform(pieces, (p, i) -> struct(p.*, aggregate(slice(pieces, 1, i), 0L, (s, q) -> s + q.length) AS offset))".replace("p.*", "p.doc_id AS doc_id, p.piece AS piece, p.start AS start, p.length AS length, p.ids_crc32 AS ids_crc32"))),
    )
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
