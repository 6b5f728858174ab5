"""Substring dedup by super-k-mers.

A window is ``window`` consecutive words. Each window has a minimiser: the least hash among its runs of ``seed`` words.
Consecutive windows with one minimiser form a super-k-mer, which travels as one packed string to the bucket of that
minimiser; equal windows always meet there. In the bucket, sorting the windows counts them exactly: the first document
of each distinct window is found, and a later document loses the words of its window.

What is not needed does not travel. First pass: minimiser, hash and place of every super-k-mer, without its words.
Buckets of one document are dropped, equal super-k-mers are one string (with the smallest document id), and only
buckets with two different strings or more need words. A bucket with more than ``split`` strings is broken up: its
windows are aggregated one by one under their own hashes, partly before the shuffle, so no task holds such a bucket.

Windows are compared by two 64-bit hashes together (minimiser or string hash, and window hash).

Edge cases: null, empty and short texts have no windows and lose nothing. Repeated rows of one doc_id count as one
document, and a row that repeats as a whole is cut up into strings once. Of windows that repeat within a document none is lost for it. A very long text is
one list of words in one task. A null doc_id comes after all others: such a row can lose words, never cause it. An empty table works.
Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactdq.llm.common import written
from contactdq.llm.wordhash import run_hashes, spaced, window_minima, word_hashes

WINDOW = 50
SEED = 16
SPLIT = 2048
_LAST = (1 << 63) - 1

_PIECES = "d long, th long, mini long, pk long, start int, n int"
_PACKED = "mini long, pk long, lo long, packed binary, broken boolean"
_LATER = "mini long, pk long, offs array<int>"


def super_kmers(words: list[bytes], window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, string hash, first window and number of windows of each super-k-mer of a text."""
    n = len(words) - window + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e, e, e
    hashes = word_hashes(words)
    minis = window_minima(run_hashes(hashes, seed), window - seed + 1)
    starts = np.concatenate(([0], np.flatnonzero(minis[1:] != minis[:-1]) + 1))
    counts = np.diff(np.concatenate((starts, [n])))
    # A string's hash is that of its windows' hashes.
    marks = run_hashes(hashes, window)
    strings = np.array([_digest(marks[s : s + c]) for s, c in zip(starts.tolist(), counts.tolist())], np.int64)
    return minis[starts].view(np.int64), strings, starts, counts


def _digest(marks: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(marks.tobytes(), digest_size=8).digest(), "little", signed=True)


def _pieces(window: int, seed: int):
    names = ["d", "th", "mini", "pk", "start", "n"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            parts = [super_kmers(spaced(t), window, seed) for t in batch.column(2).to_pylist()]
            sizes = [len(p[0]) for p in parts]
            cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(d, sizes), pa.int64()), pa.array(np.repeat(th, sizes), pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:2]), *(pa.array(c.astype(np.int32), pa.int32()) for c in cols[2:])], names
            )

    return cut


def _pack(window: int):
    """The words of the wanted super-k-mers of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = spaced(text)
                for x in wanted:
                    rows[0].append(x["mini"])
                    rows[1].append(x["pk"])
                    rows[2].append(x["lo"])
                    rows[3].append(b" ".join(words[x["start"] : x["start"] + x["n"] + window - 1]))
                    rows[4].append(x["broken"])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], ["mini", "pk", "lo", "packed", "broken"])

    return cut


def _later_windows(mini: int, pks: list, los: list, packed: list, window: int) -> list[tuple]:
    """Sort the windows of one bucket; for each string, the places of windows that a smaller document has too."""
    marks = [run_hashes(word_hashes(p.split(b" ")), window) for p in packed]
    sizes = [len(m) for m in marks]
    every, lo = np.concatenate(marks), np.repeat(np.array(los, np.int64), sizes)
    order = np.lexsort((lo, every))
    ordered = every[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    later = np.empty(len(every), bool)
    later[order] = lo[order][np.flatnonzero(first)][np.cumsum(first) - 1] < lo[order]
    ends = np.cumsum(sizes)
    found = [(mini, pk, np.flatnonzero(later[e - s : e]).tolist()) for pk, s, e in zip(pks, sizes, ends)]
    return [x for x in found if x[2]]


def _count_buckets(window: int):
    """Buckets arrive sorted by minimiser; one at a time is held, and none has more than SPLIT strings."""
    schema = pa.schema([("mini", pa.int64()), ("pk", pa.int64()), ("offs", pa.list_(pa.int32()))])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, ([], [], []), []
        for batch in batches:
            for mini, pk, lo, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if mini != now and held[0]:
                    done += _later_windows(now, *held, window)
                    held = ([], [], [])
                    if len(done) >= 2000:
                        yield out(done)
                        done = []
                now = mini
                held[0].append(pk)
                held[1].append(lo)
                held[2].append(packed)
        if held[0]:
            done += _later_windows(now, *held, window)
        if done:
            yield out(done)

    return count


def _windows_alone(window: int):
    """Strings of a broken-up bucket as one row for each distinct window: its hash and its places in the string."""
    schema = pa.schema([("mini", pa.int64()), ("pk", pa.int64()), ("lo", pa.int64()), ("mark", pa.int64()), ("offs", pa.list_(pa.int32()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, places, sizes = [], [], []
            for packed in batch.column(3).to_pylist():
                own = run_hashes(word_hashes(packed.split(b" ")), window)
                order = np.argsort(own, kind="stable")
                at = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
                marks.append(own[order][at].view(np.int64))
                places += [x.astype(np.int32) for x in np.split(order, at[1:])]
                sizes.append(len(at))
            ids = [np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes) for i in range(3)]
            every = np.concatenate(marks) if marks else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in ids), pa.array(every, pa.int64()), pa.array(places, pa.list_(pa.int32()))], schema=schema)

    return cut


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED, split: int = SPLIT) -> DataFrame:
    """``d, th, spans``: for each document with such words, the word ranges covered by windows that a smaller document id also has.

    ``docs`` has ``d`` (id, nulls as the largest), ``th`` (hash of the text) and ``text``.
    """
    pieces = written(docs.select("d", "th", "text").mapInArrow(_pieces(window, seed), _PIECES), "pieces")
    shared = pieces.groupBy("mini").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo < hi").select("mini")
    here = pieces.join(shared, "mini", "left_semi")
    strings = here.groupBy("mini", "pk").agg(F.min("d").alias("lo"), F.min(F.struct("d", "th", "start", "n")).alias("at"))
    sizes = strings.groupBy("mini").agg(F.count("*").alias("n_strings"), F.sum("at.n").alias("n_windows"))
    needed = strings.join(sizes.filter("n_strings > 1"), "mini").withColumn("broken", (F.col("n_strings") > split) | (F.col("n_windows") > 64 * split))
    # One row for each id and text, made so by each task before the shuffle: repeated rows would pack the same strings again and again.
    once = docs.groupBy("d", "th").agg(F.first("text").alias("text"))
    asked = needed.groupBy(F.col("at.d").alias("d"), F.col("at.th").alias("th")).agg(F.collect_list(F.struct("mini", "pk", "lo", F.col("at.start").alias("start"), F.col("at.n").alias("n"), "broken")).alias("asked"))
    carrying = once.join(asked, ["d", "th"])
    packed = written(carrying.select("text", "asked").mapInArrow(_pack(window), _PACKED), "packed")
    whole = packed.filter("NOT broken").select("mini", "pk", "lo", "packed").repartition("mini").sortWithinPartitions("mini")
    counted = whole.mapInArrow(_count_buckets(window), _LATER)
    alone = packed.filter("broken").select("mini", "pk", "lo", "packed").mapInArrow(_windows_alone(window), "mini long, pk long, lo long, mark long, offs array<int>")
    least = alone.groupBy("mini", "mark").agg(F.min("lo").alias("first"))
    hot = alone.alias("w").join(least.alias("f"), F.expr("w.mini = f.mini AND w.mark = f.mark AND f.first < w.lo")).groupBy("w.mini", "w.pk").agg(F.flatten(F.collect_list("offs")).alias("offs"))
    # A later document than a string's first has the whole string from it; the first one may have windows from smaller documents.
    own = here.join(strings.select("mini", "pk", "lo"), ["mini", "pk"])
    covered = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    start = F.col("start")
    whole_spans = own.filter("lo < d").select("d", "th", F.array(covered(start, start + F.col("n") + window - 1)).alias("s"))
    part = own.filter("lo >= d").join(counted.unionByName(hot), ["mini", "pk"]).select("d", "th", F.transform("offs", lambda x: covered(start + x, start + x + window)).alias("s"))
    return whole_spans.unionByName(part).groupBy("d", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("spans"))


def _kept_words(text: str | None, spans: list | None) -> tuple[int, int, bytes]:
    words = spaced(text)
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, [s["a"] for s in spans], 1)
    np.add.at(gone, [s["b"] for s in spans], -1)
    keep = np.cumsum(gone[:-1]) == 0
    return len(words), int(len(words) - keep.sum()), b" ".join(w for w, k in zip(words, keep.tolist()) if k)


def _removed(with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_kept_words(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = [batch.column(0), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in done], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array([x[2].decode("utf-8", "surrogatepass") for x in done], pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return cut


def deduplicated(docs: DataFrame, window: int = WINDOW, seed: int = SEED, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row for each document: ``doc_id, n_words, n_removed, kept_sha256`` and, if asked, the text that is left."""
    text = F.col(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))
    spans = repeated_spans(base, window, seed, split)
    joined = base.join(spans, ["d", "th"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")
    return joined.mapInArrow(_removed(with_text), schema)
