"""The network against a plain one place by place, its gradient against differences, and accuracy on documents held out."""

import random
import zlib

import numpy as np
import pytest

from contactdq.llm import byte_net as B


def plain_logit(net, text):
    """Every place, chunk and unit one by one."""
    codes = list(text)
    vectors = lambda p: np.concatenate([net.bytes_[codes[i] if i < len(codes) else B.PAD] for i in range(p, p + B.WIDTH)])
    steps = max(1, -(-len(codes) // B.STEP))
    peaks = []
    for s in range(steps):
        places = [vectors(p) @ net.kernel + net.bias for p in range(s * B.STEP, min(len(codes), (s + 1) * B.STEP))]
        peaks.append(np.maximum(np.max(places, axis=0), 0) if places else np.zeros(B.FILTERS))
    units = []
    for s in range(max(1, steps - 1)):
        both = peaks[s : s + 2]
        filled = min(len(codes) - s * B.STEP, 2 * B.STEP) / (2 * B.STEP)
        units.append(np.maximum(np.concatenate((np.max(both, axis=0), [filled])) @ net.hidden + net.hidden_bias, 0))
    return float(np.max(units, axis=0) @ net.out + net.out_bias[0])


def doubled(net):
    """The same network in double precision, with biases that are not zero."""
    rng = np.random.default_rng(1)
    parts = [p.astype(np.float64) for p in net.parts()]
    for i in (2, 4, 6):
        parts[i] = rng.standard_normal(parts[i].shape) * 0.3
    return B.Net(*parts)


def texts(lengths, seed=2):
    rnd = random.Random(seed)
    return [bytes(rnd.randrange(256) for _ in range(n)) for n in lengths]


def test_logits_like_place_by_place(monkeypatch):
    net = doubled(B.new_net())
    some = texts([0, 1, 3, 59, 60, 61, 62, 63, 64, 65, 127, 128, 129, 190, 256, 700])
    want = [plain_logit(net, t) for t in some]
    assert np.allclose(B.logits(net, some), want, atol=1e-4)
    assert np.allclose([B.logits(net, [t])[0] for t in some], want, atol=1e-4)
    monkeypatch.setattr(B, "PIECE", 2 * B.STEP)  # the same where responses are held for two steps at once
    assert np.allclose(B.logits(net, some), want, atol=1e-4)


def test_gradient_like_differences():
    net = doubled(B.new_net())
    some = texts([0, 62, 64, 150, 300, 301])
    good, weight = np.array([1, 0, 1, 0, 1, 0.0]), np.array([1, 2, 0.5, 1, 1, 1.0])
    _, slopes = B.slopes(net, some, good, weight)
    rnd = random.Random(4)
    off = 0
    for part, slope in zip(net.parts(), slopes):
        flat, told = part.reshape(-1), slope.reshape(-1)
        for at in rnd.sample(range(len(flat)), min(12, len(flat))):
            old, losses = flat[at], []
            for step in (1e-3, -1e-3):
                flat[at] = old + step
                losses.append(B.slopes(net, some, good, weight)[0])
            flat[at] = old
            off += abs((losses[0] - losses[1]) / 2e-3 - told[at]) > 0.02 + 0.05 * abs(told[at])
    assert off <= 2  # a step may move a greatest response to another place


def corpus():
    rnd = random.Random(8)
    vocab = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(500):
        words, good = rnd.choices(vocab, k=rnd.randrange(40, 120)), i % 4 > 0
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 8 else words[:20] + [words[0]] * 60
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, score int")
    net = B.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return frame, dict((i, q) for i, q, _ in labels), net


def test_held_out_documents(spark, fitted):
    frame, labels, net = fitted
    got = B.score(frame, net).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(labels)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_labels_held_out_change_nothing(spark, fitted):
    frame, labels, net = fitted
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 1) for i, q in labels.items()]
    again = B.fit(frame, spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    assert all(np.array_equal(a, b) for a, b in zip(net.parts(), again.parts()))


def test_odd_rows(spark, fitted):
    net = fitted[2]
    junk = "abc defg hij " * 30_000 + "ZZZZ!! " * 40
    rows = [(None, "words"), (1, None), (1, ""), (2, "aé\U0001f600"), (3, junk), (3, junk), (4, junk[: 13 * 30_000])]
    got = B.score(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()
    assert len(got) == 7 and not [r for r in got if r["doc_id"] is None][0]["held_out"]
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[1]) == 1 and len(by[3]) == 1  # null as empty, repeated rows alike
    want = 1 / (1 + np.exp(-plain_logit(net, "aé\U0001f600".encode())))
    assert by[2].pop() == pytest.approx(want, abs=1e-4)
    assert by[3] != by[4]  # what stands at the end of a very long text counts
    assert B.score(spark.createDataFrame([], "doc_id long, text string"), net).count() == 0


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    kind = "doc_id long, quality int, toxic int"
    assert {r["score"] for r in B.score(docs, B.fit(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, None, 0), (None, 0, 0)], kind))).collect()} == {1.0}
    assert {r["score"] for r in B.score(docs, B.fit(docs, spark.createDataFrame([], kind))).collect()} == {0.5}
