"""Whitening of embeddings by a covariance summed over tiles.

Entries become whole numbers, so counts, sums and deviations are exact. The dimensions are cut into blocks of columns; a pair of blocks is a tile.
Rows are cut into row-blocks, whose column blocks are shuffled by row-block as packed integers. A task multiplies all tile pairs of a
row-block, centred before, and adds them up by tile; the sums of the tasks are added per tile in two steps, streamed, so
that no task holds more than one tile of another. The tiles make the covariance matrix, on the driver, which holds its eigenvectors: it grows with
the square of the dimension and not with the rows.

Whole numbers are centred by a whole number first and by what is left of the mean then, so nothing is lost to large sums.

Edge cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are entries beyond 2**42, which no double tells
from their neighbours once scaled. If vectors differ in length, those of the most frequent length count (the longest of several) and the others are dropped, as they
have no covariance with these. Null and repeated ids are carried through, a row each; equal vectors all count. Components without
variance (eigenvalue at most 1e-12 of the trace) have no whitened value and are left out: one row, or rows that are all equal, give no result. An empty
table gives none. A deviation that a long cannot hold is null. Columns other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
TILE = 16
BLOCK_BYTES = 1 << 20  # of a row-block: at most 2048 rows
HELD_BYTES = 64 << 20  # of sums by tile that a task holds before it passes them on
_LARGEST = 2.0**52


def whole_vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole-number vectors of a batch (id, vector), one matrix for each length."""
    column = batch.column(1)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    bad = np.concatenate(([0], np.cumsum(~(np.abs(flat) < _LARGEST))))
    starts = np.cumsum(lengths) - lengths
    valid = (lengths > 0) & (bad[starts + lengths] == bad[starts])
    for d in np.unique(lengths[valid]).tolist():
        rows = np.flatnonzero(valid & (lengths == d))
        yield rows, flat[starts[rows][:, None] + np.arange(d)].astype(np.int64) + SHIFT


def _of_length(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    return next(((rows, x) for rows, x in whole_vectors(batch) if x.shape[1] == d), (np.zeros(0, np.int64), np.zeros((0, d), np.int64)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every length: rows, and sum, least and greatest of each dimension. Sums stay below 2**63 for some thousand rows of the largest entries, so they are passed on by batch as decimals."""
    found: dict[int, list] = {}
    for batch in batches:
        for rows, x in whole_vectors(batch):
            own = [len(rows), x.astype(object).sum(axis=0) if np.abs(x).max() > 1 << 40 else x.sum(axis=0).astype(object), x.min(axis=0), x.max(axis=0)]
            old = found.get(x.shape[1])
            found[x.shape[1]] = own if old is None else [old[0] + own[0], old[1] + own[1], np.minimum(old[2], own[2]), np.maximum(old[3], own[3])]
    for d, (n, total, low, high) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string())), pa.array([low], pa.list_(pa.int64())), pa.array([high], pa.list_(pa.int64()))], ["d", "n", "total", "low", "high"])


@dataclass(frozen=True)
class Totals:
    """Of the vectors that count: number, length, and sum, least and greatest entry of each dimension."""

    n: int
    sums: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        """The whole part of the mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the whole part leaves of the mean."""
        return np.array([(s % self.n) / self.n for s in self.sums], np.float64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sum)**2 of each row, exactly; null beyond a long."""
        largest = max((max(self.n * h - s, s - self.n * low) for h, low, s in zip(self.high, self.low, self.sums)), default=0)
        if largest**2 * len(self.sums) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def totals(base: DataFrame) -> Totals | None:
    """Exact sums of the vectors of the most frequent length; one row for each dimension comes to the driver."""
    parts = base.mapInArrow(_sums, "d int, n long, total array<string>, low array<long>, high array<long>")
    each = parts.select("d", "n", F.posexplode(F.arrays_zip("total", "low", "high")).alias("at", "x"))
    sums = each.groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x.total").cast("decimal(38,0)")).alias("total"), F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    best = F.struct("n", "d")
    rows = sums.join(F.broadcast(sums.agg(F.max(best).alias("b")).select("b.n", "b.d")), ["n", "d"]).orderBy("at").collect()  # one row is broadcast
    return Totals(rows[0]["n"], tuple(int(r["total"]) for r in rows), tuple(r["low"] for r in rows), tuple(r["high"] for r in rows)) if rows else None


def _column_blocks(of: Totals, tile: int):
    """Row-blocks of a task as packed columns: row-block, number of the columns, entries less the whole part of the mean."""
    d, whole = len(of.sums), of.whole
    kind = np.int32 if max(max(h - w, w - low) for h, low, w in zip(of.high, of.low, whole.tolist())) < 1 << 31 else np.int64
    most = max(1, min(2048, BLOCK_BYTES // (d * 8)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, np.zeros((0, d), np.int64)

        def block(x: np.ndarray) -> pa.RecordBatch:
            parts = [np.ascontiguousarray(x[:, a : a + tile]).astype(kind).tobytes() for a in range(0, d, tile)]
            return pa.RecordBatch.from_arrays([pa.array([number] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["rows", "columns", "data"])

        for batch in batches:
            held = np.concatenate((held, _of_length(batch, d)[1] - whole))
            while len(held) >= most:
                yield block(held[:most])
                held, number = held[most:], number + 1
        if len(held):
            yield block(held)

    return cut, kind


def _products(of: Totals, tile: int, kind: type):
    """Sums over row-blocks, which arrive with their column blocks together, of the product of every tile pair."""
    d, rest = len(of.sums), of.rest
    widths = [min(tile, d - a) for a in range(0, d, tile)]

    def out(sums: dict) -> pa.RecordBatch:
        salt = TaskContext.get().partitionId() % 32
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([salt] * len(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["i", "j", "salt", "data"]
        )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        now, held = None, {}
        for batch in batches:
            for rows, columns, data in zip(*(c.to_pylist() for c in batch.columns)):
                if rows != now:
                    now, held = rows, {}
                own = np.frombuffer(data, kind).reshape(-1, widths[columns]).astype(np.float64) - rest[columns * tile : columns * tile + widths[columns]]
                held[columns] = own
                for other, x in held.items():
                    key, product = (min(columns, other), max(columns, other)), (x.T @ own if other <= columns else own.T @ x)
                    if key in sums:
                        sums[key] += product
                    else:
                        sums[key] = product
                    if len(sums) * tile * tile * 8 > HELD_BYTES:
                        yield out(sums)
                        sums = {}
        if sums:
            yield out(sums)

    return multiply


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of tiles that arrive in order; one is held at a time."""
    now, total, salt = None, None, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([salt], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "j", "salt", "data"])

    for batch in batches:
        for i, j, salt, data in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.frombuffer(data, np.float64)
            if (i, j) == now:
                total = total + own
                continue
            if now is not None:
                yield out()
            now, total = (i, j), own
    if now is not None:
        yield out()


def covariance(base: DataFrame, of: Totals, tile: int = TILE) -> np.ndarray:
    """The covariance matrix (divisor n) of the whole-number vectors, put together from its tiles."""
    cut, kind = _column_blocks(of, tile)
    blocks = base.mapInArrow(cut, "rows long, columns int, data binary").repartition("rows").sortWithinPartitions("rows", "columns")
    tiles, schema = blocks.mapInArrow(_products(of, tile, kind), "i int, j int, salt int, data binary"), "i int, j int, salt int, data binary"
    for keys in (("i", "j", "salt"), ("i", "j")):
        tiles = tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_added, schema)
    d = len(of.sums)
    out = np.zeros((d, d))
    for row in tiles.select("i", "j", "data").collect():  # d * d / 2 numbers
        a, b = row["i"] * tile, row["j"] * tile
        own = np.frombuffer(row["data"], np.float64).reshape(min(tile, d - a), min(tile, d - b)) / of.n
        out[a : a + own.shape[0], b : b + own.shape[1]] = own
        out[b : b + own.shape[1], a : a + own.shape[0]] = own.T
    return out


def principal(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvectors (columns), eigenvalues and shares of the trace of the first components with variance, by falling eigenvalue."""
    trace = float(np.trace(matrix))
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > 1e-12 * trace).sum()) if trace > 0 else 0
    return vectors[:, :k], values[:k], values[:k] / trace if k else values[:0]


def _moments(of: Totals, project: np.ndarray):
    """Sums and products of whitened values over the rows of a task."""
    d, k = project.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            w = of.centred(_of_length(batch, d)[1]) @ project
            total += np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["m"])

    return add


def identity_error(base: DataFrame, of: Totals, project: np.ndarray) -> float:
    """The largest entry, by its size, of the covariance of the whitened values less the identity matrix."""
    k = project.shape[1]
    sums = base.mapInArrow(_moments(of, project), "m array<double>").select(F.posexplode("m").alias("at", "m")).groupBy("at").agg(F.sum("m").alias("m"))
    m = np.array([r["m"] for r in sums.orderBy("at").collect()]) / of.n
    return float(np.abs(m[k:].reshape(k, k) - np.outer(m[:k], m[:k]) - np.eye(k)).max())


def _projected(of: Totals, project: np.ndarray):
    d, k = project.shape

    def rows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _of_length(batch, d)
            if not len(rows):
                continue
            whitened = of.centred(x) @ project
            at = pa.array(np.repeat(np.arange(len(rows)), k))
            ids, deviations = batch.column(0).take(pa.array(rows)), pa.array(of.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), deviations.take(at), pa.array(whitened.ravel())], ["vec_id", "component", "deviation", "whitened"])

    return rows_out


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = 8, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector that counts and each of the first ``components``."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    of = totals(base)
    if of is None:
        return spark.createDataFrame([], _SCHEMA)
    axes, values, shares = principal(covariance(base, of, tile), components)
    if not len(values):
        return spark.createDataFrame([], _SCHEMA)
    project = axes / np.sqrt(values)
    error = identity_error(base, of, project)
    told = base.mapInArrow(_projected(of, project), "vec_id long, component int, deviation long, whitened double")
    explained = F.element_at(F.array(*map(F.lit, shares.tolist())), F.col("component"))
    return told.select("vec_id", "component", F.lit(of.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
