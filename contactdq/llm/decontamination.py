"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of ``window`` consecutive words (shorter items are one window), windows into shingles of up to
five words. A document can only hold a window if it holds all of the window's shingles, so the one-shingle prefix, its
rarest by the count over all documents, is enough to find it; a window with a shingle that no document has is dropped at
once. Documents and windows are joined on that shingle, bounded by the shingle's place in the window and by the
document's length, and the words themselves are compared last.

One pass reads the texts. It lets through only places whose shingle is set in a bitmap of the items' shingles. The bitmap
has a fixed size, so it is broadcast whatever the benchmark's size; a wrong bit costs a row and never a result.

Edge cases: null and empty texts have no words and are never hit. Items without words have no window; an item without
an id can hit words but is not counted or listed. Repeated items count once, repeated documents are judged row by row,
a null doc_id is carried through. A very long text is scanned whole. An empty benchmark or document table works. Other columns are
ignored, and kept by ``clean_documents`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactdq.llm.common import slices, whole_row, written
from contactdq.llm.wordhash import alnum, run_hashes, word_hashes

SHINGLE = 5
BITS = 24

_WINDOWS = "item_id string, text string, size int, shingles array<struct<shingle:long,offset:int>>"
_SCANNED = "rid long, doc_id {id}, n_words long, hits array<struct<pos:int,shingle:long,lead:int,context:array<string>>>"


def item_windows(benchmark: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Every window of every item with its words (joined by spaces) and its shingles with their places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_id", pa.string()), ("text", pa.string()), ("size", pa.int32()), ("shingles", pa.list_(pa.struct([("shingle", pa.int64()), ("offset", pa.int32())])))])
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = alnum(text)
                size = min(window, len(words))
                k = min(SHINGLE, size)
                if not k:
                    continue
                keys = run_hashes(word_hashes(words), k).view(np.int64).tolist()
                for start in range(len(words) - size + 1):
                    shingles = [{"shingle": keys[start + j], "offset": j} for j in range(size - k + 1)]
                    rows.append({"item_id": item, "text": b" ".join(words[start : start + size]).decode("utf-8", "surrogatepass"), "size": size, "shingles": shingles})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(cut, _WINDOWS)


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The items' shingles as 2**BITS bits; at most 2**(BITS - 6) small rows come to the driver."""
    place = F.shiftrightunsigned("shingle", 64 - BITS)
    rows = (
        windows.select(F.explode("shingles.shingle").alias("shingle"))
        .select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(shingle, {64 - BITS}) & 63))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _scanned(docs: DataFrame, windows: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: number of words, and the places of shingles that may be an item's, with the words around them."""
    lengths = [r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect()]
    bitmap = docs.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(windows), bitorder="little"))
    hit = pa.struct([("pos", pa.int32()), ("shingle", pa.int64()), ("lead", pa.int32()), ("context", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(bitmap.value, bitorder="little").view(bool)
        rid = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            counts, found = [], []
            for text in batch.column(1).to_pylist():
                words = alnum(text)
                hashes, mine = word_hashes(words), []
                for k in lengths:
                    runs = run_hashes(hashes, k)
                    for p in np.flatnonzero(bits[(runs >> np.uint64(64 - BITS)).view(np.int64)]).tolist():
                        first = max(0, p - window + k)
                        around = [w.decode("utf-8", "surrogatepass") for w in words[first : p + window]]
                        mine.append({"pos": p, "shingle": int(runs[p].view(np.int64)), "lead": p - first, "context": around})
                counts.append(len(words))
                found.append(mine)
            ids = pa.array(range(rid, rid + len(counts)), pa.int64())
            rid += len(counts)
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(hit))], ["rid", "doc_id", "n_words", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(scan, _SCANNED.format(id=kind))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, n_words, n_hit, items`` (sorted ids of items with a window in it) ``, hit_spans`` (word ranges)."""
    windows = written(item_windows(benchmark, window, item_id, item_text), "windows")
    scanned = written(_scanned(docs, windows, window, id_col, text_col), "scanned")
    places = scanned.select("rid", "n_words", F.explode("hits").alias("h")).select("rid", "n_words", "h.*")
    # Rarity of a shingle is its count over all documents.
    rarity = places.groupBy("shingle").agg(F.count("*").alias("seen"))
    texts = windows.groupBy("text").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    told = texts.select("text", "size", F.inline("shingles")).join(rarity, "shingle", "left")
    prefix = (
        told.groupBy("text", "size")
        .agg(F.min_by(F.struct("shingle", "offset"), F.struct("seen", "offset")).alias("p"), F.count("seen").alias("present"), F.count("*").alias("all"))
        .filter("present = all")
        .select("text", "size", "p.shingle", "p.offset")
    )
    w, p = prefix.alias("w"), places.alias("p")
    met = p.join(
        w,
        F.expr(
            "p.shingle = w.shingle AND p.pos >= w.offset AND p.pos - w.offset + w.size <= p.n_words"
            " AND array_join(slice(p.context, p.lead - w.offset + 1, w.size), ' ') = w.text"
        ),
    ).select("p.rid", F.expr("p.pos - w.offset").alias("start"), F.expr("p.pos - w.offset + w.size").alias("end"), "w.text")
    spans = met.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found"), F.collect_set("text").alias("texts"))
    # One span for overlapping or touching windows.
    merged = F.expr(
        """aggregate(found, cast(array() AS array<struct<start:int,end:int>>), (a, x) -> CASE
           WHEN size(a) > 0 AND element_at(a, -1).end >= x.start
           THEN array_append(slice(a, 1, size(a) - 1), named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))
           ELSE array_append(a, named_struct('start', x.start, 'end', x.end)) END)"""
    )
    owners = windows.filter("item_id IS NOT NULL").select("text", "item_id").distinct()
    items = spans.select("rid", F.explode("texts").alias("text")).join(owners, "text").groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = spans.select("rid", merged.alias("hit_spans"))
    joined = scanned.select("rid", "doc_id", "n_words").join(covered, "rid", "left").join(items, "rid", "left")
    n_hit = F.coalesce(F.aggregate("hit_spans", F.lit(0), lambda s, x: s + x["end"] - x["start"]), F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hit_spans", F.array().cast("array<struct<start:int,end:int>>")).alias("hit_spans"), "rid")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with their own columns.

    Texts, not ids, are the key (a 64-bit hash, the CRC-32 and the length), so null or repeated ids are safe. Rows are looked up among the
    keys of contaminated texts: Spark sends these to the rows while they are few, and else shuffles both.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(whole_row(docs), text.alias("_text"), F.xxhash64(text).alias("_k1"), (F.shiftleft(F.crc32(text.cast("binary")), 31) + F.octet_length(text)).alias("_k2"))
    found = contamination(keyed.select("_text", F.struct("_k1", "_k2").alias("_key")), benchmark, window, "_key", "_text")
    bad = written(found.filter("n_hit > 0").select("doc_id._k1", "doc_id._k2").distinct(), "contaminated")
    return keyed.drop("_text").join(bad, ["_k1", "_k2"], "left_anti").select("_row.*")
