"""Toxic spans and scores by a linear-chain conditional random field.

Documents carry labels, tokens do not, so token labels are found in turns. At first a token counts as toxic where it stands in a toxic document and
has a feature (the word or its opening letters) that is far more frequent in toxic than in clean documents, and in many contexts, so that copies
of one text teach nothing. A two-state chain is fitted by maximum likelihood on windows around the tokens that have a feature: feature weights, bias
and transitions, with gradients from forward-backward passes. Then the chain itself labels the toxic training documents: tokens of a marginal of
a half or more count as toxic, the likeliest one where there is none, and the chain is fitted anew. So a token that the field cannot tell from clean ones loses its label, and one that
it finds among toxic ones gains it.

Scoring runs forward-backward over whole texts. Tokens without a feature all have one potential, so a run of them is a power
of one 2x2 matrix, in closed form, and a text costs as many steps as it has tokens with a feature. The marginals give
the spans (places in the text, by code points); their sum, their maximum and their density give the score by a logistic function fitted on the
training documents.

Bounds of the fit, the only ones: at most ``max_rows`` labelled documents of each class, those with the least hash of their id, and as background
the tokens near four fixed places of each. All features that pass the test enter, with windows around all tokens that have one. Everything scored is scored whole.

Edge cases: null and empty texts score as texts without toxic tokens. Rows without an id are scored. Repeated rows score alike. A very long text is scored whole.
Repeated labels of one id count once, as toxic if any is, and so do equal texts of several ids. Without labels of both classes, or if no feature passes
the test, every score is 0. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactdq.llm.common import slices, written
from contactdq.llm.wordhash import alnum

PREFIXES = (3, 4, 5, 6, 7)
SLOTS = 1 + len(PREFIXES)
SIDE = 4
LENGTH = 2 * SIDE + 1

#: A token, as ``alnum`` finds it: no lower-casing makes an ASCII character that parts words, or removes one.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Up to so many distinct windows the driver sums the gradients, beyond that Spark does.
DRIVER_WINDOWS = 100_000


def feature_hashes(word: str) -> list[int]:
    """The word and its prefixes, as signed 64-bit hashes."""
    keys = [f"={word}"] + [f"<{word[:k]}" for k in PREFIXES if len(word) >= k]
    return [xxhash.xxh64_intdigest(k) - (1 << 63) for k in keys]


def tokens(text: str | None) -> list[str]:
    """Lower-cased words of letters and digits."""
    return [w.decode("utf-8", "surrogatepass") for w in alnum((text or "").lower())]


@dataclass
class Model:
    """Weights of a fitted chain, and of the score made from its marginals."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: tuple[float, float, float] = (0.0, 0.0, 0.0)  # 0 to 1, 1 to 0, 1 to 1; 0 to 0 is 0
    score: tuple[float, ...] | None = None

    def emission(self, word: str) -> float:
        return sum(self.weights.get(h, 0.0) for h in feature_hashes(word))


def marginals(gaps: np.ndarray, emissions: np.ndarray, counts: np.ndarray, model: Model) -> np.ndarray:
    """P(toxic) of the marked tokens of several chains at once.

    ``counts`` marked tokens in each chain; for each, ``gaps`` (unmarked tokens since the previous one or the start) and ``emissions``.
    """
    a, b, c = np.exp(model.moves)
    eb = np.exp(model.bias)
    step = np.array([[1.0, a * eb], [b, c * eb]])  # from, to; an unmarked token's emission included
    values, vectors = np.linalg.eig(step)
    top = int(np.argmax(values.real))
    inverse = np.linalg.inv(vectors)
    p1 = np.outer(vectors[:, top], inverse[top]).real
    p2 = np.outer(vectors[:, 1 - top], inverse[1 - top]).real
    ratio = float((values[1 - top] / values[top]).real)
    move = np.array([[1.0, a], [b, c]])
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    forward = np.empty((len(gaps), 2))
    backward = np.empty((len(gaps), 2))
    light = np.stack((np.ones(len(emissions)), np.exp(np.minimum(emissions + model.bias, 50))), axis=1)
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    state = np.tile([1.0, 0.0], (len(counts), 1))  # a clean state before the first token
    for k in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -k, side="left"))
        at = starts[:live] + k
        now = state[:live]
        gap = gaps[at][:, None]
        now = now @ p1 + (now @ p2) * np.power(ratio, gap)
        now = (now @ move) * light[at]
        state[:live] = now / now.sum(axis=1, keepdims=True)
        forward[at] = state[:live]
    state = np.ones((len(counts), 2))
    for k in range(int(counts[0]) - 1 if len(counts) else -1, -1, -1):
        live = int(np.searchsorted(-counts, -k, side="left"))
        at = starts[:live] + k
        backward[at] = state[:live]
        now = (state[:live] * light[at]) @ move.T
        gap = gaps[at][:, None]
        now = now @ p1.T + (now @ p2.T) * np.power(ratio, gap)
        state[:live] = now / now.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)


class _Scorer:
    """Marks tokens with a feature and runs the chains of a batch; made once in each task."""

    def __init__(self, model: Model, cached: int = 300_000):
        self.model, self.cached, self.known = model, cached, {}

    def batch(self, texts: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Tokens and marked tokens of each text, places of the marked, and their marginals one after another."""
        lengths, places, emissions = [], [], []
        for text in texts:
            words = alnum((text or "").lower())
            known = self.known
            for w in set(words):
                if w not in known:
                    known[w] = self.model.emission(w.decode("utf-8", "surrogatepass"))
            scores = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            if len(known) > self.cached:
                known.clear()
            at = np.flatnonzero(scores)
            lengths.append(len(words))
            places.append(at)
            emissions.append(scores[at])
        counts = np.array([len(p) for p in places], np.int64)
        gaps = np.concatenate([np.diff(p, prepend=-1) - 1 for p in places]) if places else np.zeros(0)
        p = marginals(gaps.astype(np.float64), np.concatenate(emissions) if emissions else np.zeros(0), counts, self.model)
        return np.array(lengths), counts, places, p


def summary(lengths: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """One row of inputs of the score for each text: 1, log of expected toxic tokens, greatest marginal, toxic tokens in 100."""
    owner = np.repeat(np.arange(len(counts)), counts)
    expected = np.bincount(owner, p, len(counts))
    greatest = np.zeros(len(counts))
    np.maximum.at(greatest, owner, p)
    return np.stack((np.ones(len(counts)), np.log1p(expected), greatest, np.log1p(100 * expected / np.maximum(lengths, 20))), axis=1)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def slopes(theta: np.ndarray, windows: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Sum over windows, each ``counts`` times, of the likelihood's gradient: feature weights (the first is of no feature), bias, transitions."""
    total = np.zeros_like(theta)
    w, bias, moves = theta[:-4], theta[-4], theta[-3:]
    move = np.exp(np.array([[0.0, moves[0]], [moves[1], moves[2]]]))
    for at in range(0, len(windows), 20_000):
        some, many = windows[at : at + 20_000], counts[at : at + 20_000].astype(np.float64)
        n = len(some)
        flat = np.frombuffer(b"".join(some), np.uint32).reshape(n, -1).astype(np.int64)
        features = flat[:, : LENGTH * SLOTS].reshape(-1, LENGTH, SLOTS)
        labels, valid = flat[:, LENGTH * SLOTS : LENGTH * (SLOTS + 1)], flat[:, LENGTH * (SLOTS + 1) :] == 1
        linked = valid[:, 1:]  # places before a text count as clean, places after it for nothing
        before, after = labels[:, :-1] == 1, labels[:, 1:] == 1
        seen = np.array([((p & linked).sum(axis=1) * many).sum() for p in (~before & after, before & ~after, before & after)])
        light = np.ones((n, LENGTH, 2))
        light[:, :, 1] = np.where(valid, np.exp(np.clip(w[features].sum(axis=2) + bias, -30, 30)), 0.0)
        forward, backward = np.empty((n, LENGTH, 2)), np.ones((n, LENGTH, 2))
        forward[:, 0] = light[:, 0]
        for k in range(1, LENGTH):
            now = np.where(linked[:, k - 1 : k], forward[:, k - 1] @ move, forward[:, k - 1].sum(axis=1, keepdims=True)) * light[:, k]
            forward[:, k] = now / now.sum(axis=1, keepdims=True)
        for k in range(LENGTH - 2, -1, -1):
            now = light[:, k + 1] * backward[:, k + 1]
            now = np.where(linked[:, k : k + 1], now @ move.T, now.sum(axis=1, keepdims=True))
            backward[:, k] = now / now.sum(axis=1, keepdims=True)
        both = forward * backward
        p = both[:, :, 1] / both.sum(axis=2)
        joint = forward[:, :-1, :, None] * move[None, None] * (light * backward)[:, 1:, None, :]
        joint = (joint / joint.sum(axis=(2, 3), keepdims=True)) * (linked * many[:, None])[:, :, None, None]
        expected = np.array([joint[:, :, 0, 1].sum(), joint[:, :, 1, 0].sum(), joint[:, :, 1, 1].sum()])
        miss = np.where(valid, labels - p, 0.0) * many[:, None]
        pull = np.bincount(features.ravel(), np.repeat(miss.ravel(), SLOTS), len(w))
        pull[0] = 0
        total += np.concatenate((pull, [miss.sum()], seen - expected))
    return total


def summed_slopes(theta: np.ndarray, windows: DataFrame) -> np.ndarray:
    """``slopes`` over written windows, by Spark; one row for each task comes back."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(theta)
        for batch in batches:
            total += slopes(theta, batch.column(0).to_pylist(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return sum((np.frombuffer(r[0]) for r in windows.mapInArrow(part, "total binary").collect()), np.zeros_like(theta))


def fit_chain(slope_of: Callable[[np.ndarray], np.ndarray], n: int, n_features: int, rounds: int = 120, rate: float = 0.15, ridge: float = 1e-4) -> tuple[np.ndarray, float, tuple]:
    """Maximum likelihood over ``n`` windows, whose gradients ``slope_of`` sums."""
    theta = np.concatenate((np.zeros(n_features + 1), [-3.0], np.zeros(3)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        slope = slope_of(theta) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[: n_features + 1], float(theta[n_features + 1]), tuple(theta[n_features + 2 :].tolist())


def fit_score(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _squash(x @ beta)
        slope = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return tuple(beta.tolist())


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct features of each document with a bit mask of the words before them."""
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            masks: dict[int, int] = {}
            before = 0
            for word in tokens(text):
                for h in feature_hashes(word):
                    masks[h] = masks.get(h, 0) | (1 << before)
                before = xxhash.xxh64_intdigest(word) & 63
            keys = np.fromiter(masks.keys(), np.int64, len(masks))
            bits = np.fromiter(masks.values(), np.uint64, len(masks)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(bits), pa.array(np.full(len(keys), toxic, np.int32))], ["feature", "contexts", "toxic"])


def _told_by_seeds(numbers: dict[int, int], strong: set[int]):
    """First labels: tokens with a feature that is far more frequent in toxic documents."""
    return lambda text, words: {i for i, word in enumerate(words) if not strong.isdisjoint(numbers[h] for h in feature_hashes(word) if h in numbers)}


def _told_by(model: Model):
    """Labels by a fitted chain: tokens of a marginal of a half or more, else the likeliest one."""
    scorer = _Scorer(model)

    def told(text: str | None, words: list[str]) -> set[int]:
        _, _, places, p = scorer.batch([text])
        return set(places[0][(p >= 0.5) | (p == p.max())].tolist()) if len(p) else set()

    return told


def _window_rows(numbers: dict[int, int], teacher: Callable):
    """Windows around all marked tokens (and at four fixed places), as bytes of feature numbers, labels and validity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = teacher()
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text)
                bad = told(text, words) if toxic else set()
                marked = {}
                for i, word in enumerate(words):
                    own = [numbers[h] for h in feature_hashes(word) if h in numbers]
                    if own:
                        marked[i] = own
                middles = list(marked) + list(range(SIDE, len(words), max(1, len(words) // 4)))[:4]
                for mid in middles:
                    f, y, ok = np.zeros((LENGTH, SLOTS), np.uint32), np.zeros(LENGTH, np.uint32), np.zeros(LENGTH, np.uint32)
                    for j, i in enumerate(range(mid - SIDE, mid + SIDE + 1)):
                        if 0 <= i < len(words):
                            ok[j] = 1
                            own = marked.get(i, ())
                            f[j, : len(own)] = own
                            y[j] = i in bad
                    out.append(np.concatenate((f.ravel(), y, ok)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["window"])

    return cut


def _summaries(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            lengths, counts, _, p = scorer.batch(batch.column(0).to_pylist())
            x = summary(lengths, counts, p)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, i]) for i in range(1, 4))], ["toxic", "x1", "x2", "x3"])

    return score


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: bool = True) -> tuple[DataFrame, dict[int, int]]:
    """``text, toxic`` of the documents to learn from, and how many of each class there are in all."""
    told = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if held_out:
        told = told.filter("crc32(cast(doc_id AS string)) % 3 <> 1")
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {int(r["toxic"] > 0): r["count"] for r in told.groupBy("toxic").count().collect()}
    chosen = None
    for kind in ("toxic > 0", "toxic <= 0"):
        some = told.filter(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = written(chosen.select(F.col("doc_id").alias("_d"), (F.col("toxic") > 0).cast("int").alias("toxic")), "chosen")
    # At most 2 * max_rows small rows are broadcast.
    rows = docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_d").select("text", "toxic")
    return written(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "training"), totals


def _fit_windows(rows: DataFrame, numbers: dict[int, int], teacher: Callable) -> tuple[np.ndarray, float, tuple]:
    # Equal windows have equal gradients: each is kept once, with its count.
    windows = rows.select("text", "toxic").mapInArrow(_window_rows(numbers, teacher), "window binary").groupBy("window").agg(F.count("*").alias("n"))
    windows = written(windows, "windows")
    distinct, n_windows = windows.agg(F.count("*"), F.sum("n")).first()
    if distinct <= DRIVER_WINDOWS:
        raw = windows.orderBy("window").collect()
        own, many = [bytes(r[0]) for r in raw], np.array([r[1] for r in raw])
        return fit_chain(lambda theta: slopes(theta, own, many), n_windows, len(numbers))
    return fit_chain(lambda theta: summed_slopes(theta, windows), n_windows, len(numbers))


def _model(top: list, weights: np.ndarray, bias: float, moves: tuple) -> Model:
    return Model({r["feature"]: float(weights[i + 1]) for i, r in enumerate(top) if abs(weights[i + 1]) > 0.02}, bias, moves)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2000, held_out: bool = True, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", turns: int = 1) -> Model:
    """Learn a model from at most ``max_rows`` labelled documents of each class; ``turns`` is how often the chain labels them anew."""
    rows, totals = training_rows(docs, labels, max_rows, id_col, text_col, label_col, held_out)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model()
    counts = rows.select("text", "toxic").mapInArrow(_feature_rows, "feature long, contexts long, toxic int")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"), F.bit_count(F.bit_or(F.when(F.col("toxic") == 1, F.col("contexts")).otherwise(0))).alias("spread"))
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1.0)) - F.log((F.col("good") + 0.5) / (n[0] + 1.0))
    top = counts.filter("bad >= 4 AND spread >= 4").withColumn("odds", odds).filter("odds >= 1.5").orderBy(F.desc("odds"), "feature").select("feature", "odds", "bad").collect()
    if not top:
        return Model()
    numbers = {r["feature"]: i + 1 for i, r in enumerate(top)}
    strong = {i + 1 for i, r in enumerate(top) if r["odds"] >= 2.5}
    weights, bias, moves = _fit_windows(rows, numbers, lambda: _told_by_seeds(numbers, strong))
    for _ in range(turns):
        model = _model(top, weights, bias, moves)
        weights, bias, moves = _fit_windows(rows, numbers, lambda m=model: _told_by(m))
    model = _model(top, weights, bias, moves)
    told = rows.select("text", "toxic").mapInArrow(_summaries(model), "toxic int, x1 double, x2 double, x3 double").toPandas()
    x = np.column_stack((np.ones(len(told)), told[["x1", "x2", "x3"]].to_numpy()))
    # Classes count as in the whole training part, not as in the sample.
    share = {k: totals[k] / n[k] for k in (0, 1)}
    weight = told["toxic"].map(share).to_numpy(np.float64)
    model.score = fit_score(x, told["toxic"].to_numpy(np.float64), weight / weight.mean())
    return model


def _scored(model: Model, spans_from: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            lengths, counts, places, p = scorer.batch(texts)
            total = _squash(summary(lengths, counts, p) @ np.array(model.score)) if model.score else np.zeros(len(counts))
            ends = np.cumsum(counts)
            spans = [toxic_spans(t, at[own >= spans_from], own[own >= spans_from]) for t, at, own in ((t, at, p[end - n : end]) for t, at, n, end in zip(texts, places, counts.tolist(), ends.tolist()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(spans, kind)], ["doc_id", "score", "toxic_spans"])

    return score


def toxic_spans(text: str | None, words: np.ndarray, p: np.ndarray) -> list[dict]:
    """Places in a text, in code points, of words given by their numbers; words that follow each other make one span, of the greatest marginal."""
    if not len(words):
        return []
    wanted, out, last = dict(zip(words.tolist(), p.tolist())), [], -2
    for k, m in enumerate(_WORD.finditer(text)):
        if k in wanted:
            if last == k - 1:
                out[-1].update(end=m.end(), probability=max(out[-1]["probability"], wanted[k]))
            else:
                out.append({"start": m.start(), "end": m.end(), "probability": wanted[k]})
            last = k
    return out


def score(docs: DataFrame, model: Model, cut: float = 0.7, spans_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, held_out, score, predicted, toxic_spans`` (from and up to which code point, with the marginal)."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scored = base.mapInArrow(_scored(model, spans_from), "doc_id long, score double, toxic_spans array<struct<start:int,end:int,probability:double>>")
    held = F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 3 = 1"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "toxic_spans")
