"""Token ids in patched frame-of-reference files.

A file holds documents in ascending id order. Their ids are one stream, cut into blocks of 1024: the block's minimum is
subtracted, the rest is bit-packed at the width that the chosen percentile of values needs, and larger values keep their
low bits in the pack while place and high bits go to the block's exception list. An index of block starts follows, so a block can be read
alone, then the table of documents.

Layout, little-endian: ``PFR1``, blocks, block starts (uint64), documents (int64 id, uint8 has-id, uint64 first token,
uint64 tokens), footer (uint64 blocks, uint64 documents, uint64 tokens, uint64 index offset, ``PFR1``).
Block: uint32 minimum, uint16 values, uint16 exceptions, uint8 width, packed bits, exceptions (uint16 place, uint32 high bits).

Tasks write files of bounded size under names of their own and report them; only reported files are read, so a repeated
task leaves at most unused files. Blocks of one width are packed and unpacked together, a bounded number at a time.

Edge cases: a null or empty text is its end id alone. Rows with one id keep all their texts, in the order of their texts' hashes, and are spread
over files by them, so an id may hold any part of the rows; a null id comes first. A very long text is one run of ids, longer than a file's
size if need be. An empty table writes no file and reads as no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactdq.llm.common import shared_dir, shuffle_partitions, slices, written
from contactdq.llm.encoding import encoder

MAGIC = b"PFR1"
BLOCK = 1024
PERCENTILE = 95.0
FILE_TOKENS = 4_000_000
_AT_ONCE = 256  # blocks that are packed or unpacked together
_HEAD, _FOOT = struct.Struct("<IHHB"), struct.Struct("<QQQQ4s")
_DOCUMENT = np.dtype([("id", "<i8"), ("has_id", "u1"), ("first", "<u8"), ("n", "<u8")])
_EXCEPTION = np.dtype([("place", "<u2"), ("high", "<u4")])


def pack_block(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of at most 65,535 unsigned 32-bit values."""
    low = int(values.min()) if len(values) else 0
    rest = (values - np.uint32(low)).astype(np.uint32)
    cut = int(np.percentile(rest, percentile, method="higher")) if len(rest) else 0
    width = cut.bit_length()
    places = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width] if len(rest) else np.zeros((0, width), np.uint8)
    outliers = np.zeros(len(places), _EXCEPTION)
    outliers["place"], outliers["high"] = places, rest[places] >> np.uint32(width) if len(places) else 0
    return _HEAD.pack(low, len(rest), len(places), width) + np.packbits(bits.ravel(), bitorder="little").tobytes() + outliers.tobytes()


def unpack_block(raw: bytes, at: int = 0) -> np.ndarray:
    """The values of the block that starts at a byte of a file."""
    low, n, exceptions, width = _HEAD.unpack_from(raw, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    rest = np.zeros((n, 32), np.uint8)
    rest[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    values = np.packbits(rest, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    if exceptions:
        outliers = np.frombuffer(raw, _EXCEPTION, exceptions, at + size)
        values[outliers["place"]] |= outliers["high"] << np.uint32(width)
    return values + np.uint32(low)


def _bits(rest: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value of each row, one after another from the lowest bit on; rows of a multiple of 64 values, as bytes."""
    lanes = rest.reshape(len(rest), -1, 64).astype(np.uint64)
    if width < 32:
        lanes &= np.uint64((1 << width) - 1)
    out = np.zeros((*lanes.shape[:2], width), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[:, :, word] |= lanes[:, :, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= lanes[:, :, k] >> np.uint64(64 - shift)
    return out.astype("<u8").view(np.uint8).reshape(len(rest), -1)


def _unbits(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    """The inverse of ``_bits`` for rows of n values."""
    words = np.ascontiguousarray(raw).view("<u8").reshape(len(raw), n // 64, width)
    out = np.empty((len(raw), n // 64, 64), np.uint32)
    keep = np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        value = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, :, word + 1] << np.uint64(64 - shift))
        out[:, :, k] = value & keep
    return out.reshape(len(raw), n)


def _pack_whole_blocks(ids: np.ndarray, percentile: float) -> list[bytes]:
    """``pack_block`` for every row of a table of blocks, those of one width at a time."""
    n = ids.shape[1]
    low = ids.min(axis=1)
    rest = ids - low[:, None]
    cut = np.percentile(rest, percentile, axis=1, method="higher")
    widths = np.array([int(c).bit_length() for c in cut.tolist()])
    out: list = [b""] * len(ids)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        some = rest[rows]
        packed = _bits(some, width) if width else np.zeros((len(rows), 0), np.uint8)
        which, places = np.nonzero(some >> np.uint32(width)) if width < 32 else (np.zeros(0, np.int64),) * 2
        outliers = np.zeros(len(places), _EXCEPTION)
        outliers["place"], outliers["high"] = places, some[which, places] >> np.uint32(width) if len(places) else 0
        bounds = np.searchsorted(which, np.arange(len(rows) + 1)).tolist()
        for i, row in enumerate(rows.tolist()):
            a, b = bounds[i], bounds[i + 1]
            out[row] = _HEAD.pack(int(low[row]), n, b - a, width) + packed[i].tobytes() + outliers[a:b].tobytes()
    return out


def pack_file(ids: np.ndarray, documents: np.ndarray, percentile: float = PERCENTILE, block: int = BLOCK) -> bytes:
    """A whole file: the ids of its documents one after another, and their table."""
    blocks, whole = [], len(ids) // block * block if block % 64 == 0 else 0
    for at in range(0, whole, block * _AT_ONCE):
        blocks += _pack_whole_blocks(ids[at : min(whole, at + block * _AT_ONCE)].reshape(-1, block), percentile)
    blocks += [pack_block(ids[i : i + block], percentile) for i in range(whole, len(ids), block)]
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
    ends = len(MAGIC) + np.cumsum(sizes)
    at = int(ends[-1]) if len(ends) else len(MAGIC)
    return b"".join([MAGIC, *blocks, (ends - sizes).astype("<u8").tobytes(), documents.tobytes(), _FOOT.pack(len(blocks), len(documents), len(ids), at, MAGIC)])


def unpack_file(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """All values of a file, from its block starts."""
    parts: list = [np.zeros(0, np.uint32)] * len(starts)
    alike: dict[tuple[int, int], list[int]] = {}
    heads = [_HEAD.unpack_from(raw, s) for s in starts.tolist()]
    for i, (_, n, _, width) in enumerate(heads):
        alike.setdefault((n, width), []).append(i)
    every = np.frombuffer(raw, np.uint8)
    for (n, width), rows in alike.items():
        for some in (rows[k : k + _AT_ONCE] for k in range(0, len(rows), _AT_ONCE)):
            if n % 64 or not width:
                for i in some:
                    parts[i] = unpack_block(raw, int(starts[i]))
                continue
            size, at = n * width // 8, starts[some].astype(np.int64) + _HEAD.size
            values = _unbits(every[at[:, None] + np.arange(size)], width, n)
            for k, i in enumerate(some):
                low, _, exceptions, _ = heads[i]
                if exceptions:
                    outliers = np.frombuffer(raw, _EXCEPTION, exceptions, int(at[k]) + size)
                    values[k, outliers["place"]] |= outliers["high"] << np.uint32(width)
                parts[i] = values[k] + np.uint32(low)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def read_index(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Block starts and the table of documents."""
    blocks, documents, _, at, magic = _FOOT.unpack_from(raw, len(raw) - _FOOT.size)
    if magic != MAGIC or raw[:4] != MAGIC:
        raise ValueError("not a token file, or a torn one")
    return np.frombuffer(raw, "<u8", blocks, at), np.frombuffer(raw, _DOCUMENT, documents, at + 8 * blocks)


def read_tokens(raw: bytes, first: int, n: int, block: int = BLOCK) -> np.ndarray:
    """Tokens first to first + n - 1 of a file, from the blocks that hold them."""
    starts, _ = read_index(raw)
    if not n:
        return np.zeros(0, np.uint32)
    parts = [unpack_block(raw, int(starts[b])) for b in range(first // block, (first + n - 1) // block + 1)]
    return np.concatenate(parts)[first - first // block * block :][:n]


def _write(path: str, raw: bytes) -> None:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as out:
        out.write(raw)


def _writer(folder: str, tokenizer: str, keeps_space: bool, end_id: int, percentile: float, file_tokens: int):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, keeps_space)
        part, seq, end = TaskContext.get().partitionId(), 0, np.array([end_id], np.uint32)
        streams, table, size = [], [], 0

        def closed() -> pa.RecordBatch:
            path = f"{folder}/part-{part:05d}-{seq:05d}-{uuid.uuid4().hex}.pfr"
            _write(path, pack_file(np.concatenate(streams), np.array(table, _DOCUMENT), percentile))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([path]), pa.array([size], pa.int64()), pa.array([len(table)], pa.int64())], schema=schema)

        for batch in slices(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1))):
                table.append((doc or 0, doc is not None, size, len(ids) + 1))
                streams += [ids, end]
                size += len(ids) + 1
                if size >= file_tokens:
                    yield closed()
                    streams, table, size, seq = [], [], 0, seq + 1
        if table:
            yield closed()

    return write


def write_files(
    docs: DataFrame, tokenizer: str, end_id: int = 2, keeps_space: bool = False, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, percentile: float = PERCENTILE, file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """Encode, append the end id, write files in ascending id order, and return their list: ``part, seq, path, n_tokens, n_docs, first`` (tokens in all files before)."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens"
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # Rows of one id (or none) are spread and ordered by their texts.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit("")))]
    ordered = base.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    files = ordered.mapInArrow(_writer(folder, tokenizer, keeps_space, end_id, percentile, file_tokens), "part int, seq int, path string, n_tokens long, n_docs long")
    listed = written(files, "files")
    # Prefix sums in two steps: over the parts, of which there are as many as shuffle partitions, and over the files of each.
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = listed.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("base"))
    return listed.join(parts, "part").withColumn("first", (F.col("base") + F.coalesce(F.sum("n_tokens").over(before("part", "seq")), F.lit(0))).cast("long")).drop("base")


def _read(path: str) -> bytes:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_stream(place) as file:
        return file.read()


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = _read(path)
            starts, table = read_index(raw)
            le = memoryview(unpack_file(raw, starts).astype("<u4", copy=False)).cast("B")
            crcs = [zlib.crc32(le[4 * a : 4 * (a + n)]) for a, n in zip(table["first"].tolist(), table["n"].tolist())]
            cols = [pa.array(table["id"].astype(np.int64), mask=table["has_id"] == 0), pa.array(table["first"].astype(np.int64) + first), pa.array(table["n"].astype(np.int64)), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One row for each document of the listed files: ``doc_id, start, n_tokens, ids_crc32``.

    Tasks read the files that their rows of the list name, one at a time; nothing is broadcast or joined.
    """
    listed = written(files.select("path", "first"), "list")
    n = max(1, min(shuffle_partitions(spark), listed.count()))
    return listed.repartition(n).mapInArrow(_crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")
