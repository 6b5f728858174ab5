"""Document quality by a convolutional network over bytes, in numpy.

A text is its UTF-8 bytes. Each byte has a learned vector; learned filters look at ``WIDTH`` bytes from every place of the
document. The greatest response of each filter in a chunk of ``2 * STEP`` places describes the chunk; chunks start every ``STEP`` places, so each
overlaps the next by half, and together they cover the whole document. A hidden layer reads each chunk, its units are max-pooled over
all chunks, and a logistic unit makes one probability of them. So a unit can tell a chunk by what stands in it, and by what does not: a
chunk that repeats one word answers to few filters.

Training is by gradients through the greatest responses (Adam), on the driver, over a bounded sample: at most ``max_rows`` labelled texts of each class
(those with the least hash of their id) among those of at most ``max_bytes`` bytes. Both bounds are parameters; nothing else is bounded, and everything scored is
scored whole, in pieces of fixed size. Classes count as in all labelled rows: the logit is shifted by the odds that the sample left out.

Edge cases: null and empty texts score as one chunk without responses. Rows without an id are scored. Repeated rows score alike. A very
long text is scored whole, in bounded memory. Repeated labels of one id count once, as good only if all are, and so do equal texts of
several ids. Without labels of both classes every score is the share of good labels, or 0.5 without any label. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactdq.llm.common import slices, written

SIZE, WIDTH, FILTERS, HIDDEN = 8, 5, 24, 16
STEP = 64
PIECE = 1 << 16  # places whose responses are held at once
PAD = 256  # what stands after the end of a text: a vector of zeros


@dataclass
class Net:
    """Parameters of a network; ``constant`` is the score of all texts where nothing could be learned."""

    bytes_: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    constant: float | None = None

    def parts(self) -> list[np.ndarray]:
        return [self.bytes_, self.kernel, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def new_net(seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    vectors = normal(1.0, PAD + 1, SIZE)
    vectors[PAD] = 0
    return Net(
        vectors, normal((SIZE * WIDTH) ** -0.5, WIDTH * SIZE, FILTERS), np.zeros(FILTERS, np.float32), normal((FILTERS + 1) ** -0.5, FILTERS + 1, HIDDEN), np.zeros(HIDDEN, np.float32), normal(HIDDEN**-0.5, HIDDEN), np.zeros(1, np.float32)
    )


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of several texts, each filled up to whole steps, as one array; steps of each text and places used of each step."""
    lengths = np.array([len(t) for t in texts], np.int64)
    steps = np.maximum(1, -(-lengths // STEP))
    out = np.full(int(steps.sum()) * STEP, PAD, np.uint16)
    at = np.concatenate(([0], np.cumsum(steps)[:-1])) * STEP
    used = np.full(int(steps.sum()), STEP, np.int64)
    used[np.cumsum(steps) - 1] = lengths - (steps - 1) * STEP
    for t, a in zip(texts, at.tolist()):
        out[a : a + len(t)] = np.frombuffer(t, np.uint8)
    return out, steps, used


def _windows(net: Net, data: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The codes at and after some places; what lies beyond the end of the place's own text is PAD."""
    at = places[:, None] + np.arange(WIDTH)
    return np.where(at < ends[:, None], data[np.minimum(at, len(data) - 1)], PAD)


def responses(net: Net, data: np.ndarray, steps: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The greatest response of every filter in every step (rows) of the texts laid out."""
    text_end = np.zeros(len(data) // STEP, bool)
    text_end[np.cumsum(steps) - 1] = True
    out = np.empty((len(used), FILTERS), np.float32)
    per = PIECE // STEP
    for at in range(0, len(used), per):
        n = min(per, len(used) - at)
        codes = data[at * STEP : (at + n) * STEP + WIDTH - 1]
        if len(codes) < n * STEP + WIDTH - 1:
            codes = np.concatenate((codes, np.full(n * STEP + WIDTH - 1 - len(codes), PAD, np.uint16)))
        x = net.bytes_[codes].reshape(-1)
        seen = np.lib.stride_tricks.as_strided(x, (n * STEP, WIDTH * SIZE), (SIZE * x.itemsize, x.itemsize))
        y = (seen @ net.kernel).reshape(n, STEP, FILTERS)
        # A text that fills its last step to the end would see the next one there: those few places are done anew.
        last = np.flatnonzero(text_end[at : at + n] & (used[at : at + n] > STEP - WIDTH + 1))
        if len(last):
            places = ((at + last)[:, None] * STEP + np.arange(STEP - WIDTH + 1, STEP)).ravel()
            own = net.bytes_[_windows(net, data, np.repeat((at + last + 1) * STEP, WIDTH - 1), places)].reshape(len(places), -1)
            y[last[:, None], np.arange(STEP - WIDTH + 1, STEP)] = (own @ net.kernel).reshape(len(last), WIDTH - 1, FILTERS)
        short = np.flatnonzero(used[at : at + n] < STEP)
        for k in short.tolist():
            y[k, used[at + k] :] = -np.inf
        out[at : at + n] = y.max(axis=1)
    return np.maximum(out + net.bias, 0)


def chunked(peaks: np.ndarray, steps: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of two steps each, one for every step but the last of a longer text: their inputs, first steps, and chunks of each text."""
    counts = np.maximum(steps - 1, 1)
    starts = np.cumsum(steps) - steps
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    second = np.where(np.repeat(steps > 1, counts), first + 1, first)
    filled = np.where(second > first, used[first] + used[second], used[first]) / (2.0 * STEP)
    return np.column_stack((np.maximum(peaks[first], peaks[second]), filled.astype(np.float32))), first, counts


def logits(net: Net, texts: list[bytes]) -> np.ndarray:
    """One logit for each text."""
    data, steps, used = laid_out(texts)
    inputs, _, counts = chunked(responses(net, data, steps, used), steps, used)
    units = np.maximum(inputs @ net.hidden + net.hidden_bias, 0)
    pooled = np.maximum.reduceat(units, np.cumsum(counts) - counts, axis=0)
    return pooled @ net.out + net.out_bias[0]


def slopes(net: Net, texts: list[bytes], good: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted log-loss of some texts and its gradient in every parameter; only the places of greatest responses carry it."""
    data, steps, used = laid_out(texts)
    peaks = responses(net, data, steps, used)
    inputs, first, counts = chunked(peaks, steps, used)
    units = np.maximum(inputs @ net.hidden + net.hidden_bias, 0)
    bounds = np.cumsum(counts) - counts
    pooled = np.maximum.reduceat(units, bounds, axis=0)
    p = 1 / (1 + np.exp(-(pooled @ net.out + net.out_bias[0])))
    loss = float(-(weight * np.log(np.where(good > 0, p, 1 - p) + 1e-12)).sum())
    d_out = (weight * (p - good)).astype(np.float32)
    g_out, g_out_bias = pooled.T @ d_out, np.array([d_out.sum()], np.float32)
    # Where each unit of each text has its greatest value.
    d_pool = d_out[:, None] * net.out * (pooled > 0)
    best = np.stack([b + units[b : b + c].argmax(axis=0) for b, c in zip(bounds.tolist(), counts.tolist())])
    chunk, unit, value = best.ravel(), np.tile(np.arange(HIDDEN), len(texts)), d_pool.ravel()
    live = value != 0
    chunk, unit, value = chunk[live], unit[live], value[live]
    g_hidden, g_hidden_bias = np.zeros_like(net.hidden), np.zeros_like(net.hidden_bias)
    np.add.at(g_hidden.T, unit, inputs[chunk] * value[:, None])
    np.add.at(g_hidden_bias, unit, value)
    own, back = np.unique(chunk, return_inverse=True)
    d_in = np.zeros((len(own), FILTERS + 1), np.float32)
    np.add.at(d_in, back, net.hidden.T[unit] * value[:, None])
    d_in = d_in[:, :FILTERS]
    # Of the two steps of a chunk, the one with the greater response; in it, the place.
    one = first[own]
    two = np.minimum(one + 1, len(used) - 1)
    second = (inputs[own, :FILTERS] != peaks[one]) & (inputs[own, :FILTERS] == peaks[two])
    step = np.where(second, two[:, None], one[:, None])
    d_in = np.where(inputs[own, :FILTERS] > 0, d_in, 0)
    row, col = np.nonzero(d_in)
    step, slope = step[row, col], d_in[row, col]
    ends = np.repeat(np.cumsum(steps), steps) * STEP
    places_of, inverse = np.unique(step, return_inverse=True)
    every = (places_of[:, None] * STEP + np.arange(STEP)).ravel()
    seen = net.bytes_[_windows(net, data, np.repeat(ends[places_of], STEP), every)].reshape(len(every), -1)
    y = (seen @ net.kernel).reshape(len(places_of), STEP, FILTERS)
    y[np.arange(STEP) >= used[places_of][:, None]] = -np.inf
    where = y.argmax(axis=1)[inverse, col] + step * STEP
    codes = _windows(net, data, ends[step], where)
    x = net.bytes_[codes].reshape(len(where), -1)
    g_kernel, g_bias = np.zeros_like(net.kernel), np.zeros_like(net.bias)
    np.add.at(g_kernel.T, col, x * slope[:, None])
    np.add.at(g_bias, col, slope)
    g_bytes = np.zeros_like(net.bytes_)
    np.add.at(g_bytes, codes.ravel(), (net.kernel.T[col] * slope[:, None]).reshape(-1, SIZE))
    g_bytes[PAD] = 0
    return loss, [g_bytes, g_kernel, g_bias, g_hidden, g_hidden_bias, g_out, g_out_bias]


def train(texts: list[bytes], good: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Net:
    """A network fitted to texts and their labels, in which both classes weigh the same."""
    net, rng = new_net(seed), np.random.default_rng(seed + 1)
    weight = np.where(good > 0, 0.5 / max(1, good.sum()), 0.5 / max(1, (1 - good).sum())) * len(good)
    parts = net.parts()
    first, second, turn = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    epochs = max(epochs, -(-400 * batch // len(texts)))  # few texts are seen more often
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            _, gradients = slopes(net, [texts[i] for i in some], good[some], weight[some] / len(some))
            turn += 1
            pace = rate * 0.5 * (1 + np.cos(np.pi * turn / total))
            for p, g, m, v in zip(parts, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.002 * (g * g - v)
                p -= pace * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.998**turn)) + 1e-6)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """``text, good`` of the sample to learn from, and how many labelled rows of each class there are in all."""
    told = labels.select(F.col(f"`{id_col}`").cast("long").alias("_d"), F.col(f"`{label_col}`").cast("int").alias("good")).filter("_d IS NOT NULL AND good IS NOT NULL AND crc32(cast(_d AS string)) % 5 <> 0")
    told = told.groupBy("_d").agg((F.min("good") > 0).cast("int").alias("good"))
    totals = {r["good"]: r["count"] for r in told.groupBy("good").count().collect()}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    sized = docs.select(F.col(f"`{id_col}`").cast("long").alias("_d"), (F.octet_length(text) <= max_bytes).alias("fits")).filter("fits").join(told, "_d").select("_d", "good").distinct()
    chosen = None
    for kind in (1, 0):
        some = sized.filter(f"good = {kind}").orderBy(F.xxhash64("_d"), "_d").limit(max_rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most 2 * max_rows ids are broadcast, and as many texts of at most max_bytes bytes are read.
    chosen = written(chosen, "chosen")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_d"), text.alias("text")).filter(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "_d")
    return rows.groupBy("text").agg(F.min("good").alias("good")), totals


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 1000, max_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Net:
    """Learn from labelled rows whose crc32 of the id is not divisible by five, at most ``max_rows`` of each class."""
    rows, totals = training_rows(docs, labels, max_rows, max_bytes, id_col, text_col, label_col)
    told = sorted((r["text"].encode("utf-8", "surrogatepass"), r["good"]) for r in rows.collect())
    good = np.array([g for _, g in told], np.float64)
    if len(set(good.tolist())) < 2:
        net = new_net()
        net.constant = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
        return net
    net = train([t for t, _ in told], good, **options)
    net.out_bias += np.float32(np.log(totals[1] / totals[0]))
    return net


def _scored(net: Net):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            if net.constant is not None:
                p = np.full(batch.num_rows, net.constant)
            else:
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
                p = np.empty(len(texts))
                at = 0
                while at < len(texts):  # texts of some megabytes together, a longer one alone
                    end, size = at + 1, len(texts[at])
                    while end < len(texts) and size + len(texts[end]) <= 1 << 20:
                        size += len(texts[end])
                        end += 1
                    p[at:end] = 1 / (1 + np.exp(-logits(net, texts[at:end]).astype(np.float64)))
                    at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return score


def score(docs: DataFrame, net: Net, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, held_out, score, predicted``."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    held = F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 5 = 0"), F.lit(False))
    return base.mapInArrow(_scored(net), "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
