"""The chain's marginals against a plain forward-backward, and accuracy on documents held out."""

import random
import zlib

import numpy as np

from contactdq.llm import toxicity as T


def plain_marginals(length, emissions, model):
    """All tokens one by one."""
    a, b, c = np.exp(model.moves)
    move = np.array([[1.0, a], [b, c]])
    light = np.ones((length, 2))
    for i in range(length):
        light[i, 1] = np.exp(model.bias + emissions.get(i, 0.0))
    forward, now = [], np.array([1.0, 0.0])
    for i in range(length):
        now = (now @ move) * light[i]
        forward.append(now := now / now.sum())
    out, now = np.zeros(length), np.ones(2)
    for i in range(length - 1, -1, -1):
        both = forward[i] * now
        out[i] = both[1] / both.sum()
        now = move @ (light[i] * now)
        now = now / now.sum()
    return out


def test_marginals_match_token_by_token():
    rnd = random.Random(3)
    model = T.Model({}, -4.0, (-0.7, -0.4, 0.6))
    gaps, emissions, counts, want = [], [], [], []
    for _ in range(12):
        length = rnd.randrange(60)
        marked = {i: rnd.uniform(-1, 7) for i in range(length) if rnd.random() < 0.2}
        places = sorted(marked)
        gaps += np.diff(places, prepend=-1).tolist() if places else []
        emissions += [marked[i] for i in places]
        counts.append(len(places))
        # What follows the last marked token weighs on it too, but only through unmarked tokens: cut the text there.
        want += plain_marginals(places[-1] + 1, marked, model)[places].tolist() if places else []
    got = T.marginals(np.array(gaps) - 1.0, np.array(emissions), np.array(counts), model)
    assert np.allclose(got, want, atol=1e-9)


def case():
    rnd = random.Random(12)
    vocab = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(500)]
    docs, labels = [], []
    for i in range(400):
        words, toxic = rnd.choices(vocab, k=rnd.randrange(30, 90)), i % 4 == 0
        for _ in range(6 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["Rotten", "zorkling", "zorkest", "vile."]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_documents(spark, documents):
    docs, labels = case()
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    odd = [(1000, None), (1001, ""), (None, "vile rotten zorkling vile"), (1002, "calm " * 20000), (5, docs[5][1])]
    model = T.fit(documents(docs), told)
    got = T.score(documents(docs + odd).selectExpr("*", "1 AS score"), model).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) > 0.97 * len(held)
    some = next(r for r in held if r.doc_id % 4 == 0)
    text = dict(docs)[some.doc_id]
    found = {w for x in some.toxic_spans for w in T.tokens(text[x["start"] : x["end"]])}
    assert found and found <= {"rotten", "zorkling", "zorkest", "vile"}
    assert {r.doc_id: r.predicted for r in got}[1002] == 0


def late_case():
    """Toxic documents open with 14 marked words; one word stands only after them."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(300)]
    docs, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        words = rnd.choices(["rotten", "vile", "nasty", "putrid", "wretched", "foul"], k=14) if toxic else []
        words += rnd.choices(vocab, k=100) + (["zorkling"] if toxic else []) + rnd.choices(vocab, k=3)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_late_marked_words_are_learned(spark, documents, monkeypatch):
    docs, labels = late_case()
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.fit(documents(docs), told, held_out=False)
    assert model.emission("zorkling") > 1
    row = T.score(documents([(1, docs[1][1] + " zorkling abc")]), model).first()
    assert [(docs[1][1] + " zorkling abc")[x["start"] : x["end"]] for x in row.toxic_spans] == ["zorkling"]
    monkeypatch.setattr(T, "DRIVER_WINDOWS", 0)
    monkeypatch.setattr(T.fit_chain, "__defaults__", (6, 0.15, 1e-4))
    far = T.fit(documents(docs), told, held_out=False)
    monkeypatch.setattr(T, "DRIVER_WINDOWS", 10**6)
    near = T.fit(documents(docs), told, held_out=False)
    assert far.weights.keys() == near.weights.keys() and np.allclose([far.weights[k] for k in near.weights], list(near.weights.values()))


def test_no_limit_on_features(spark, documents):
    rnd = random.Random(7)
    words = ["".join(rnd.choices("ijklmnopqr", k=8)) for _ in range(1200)]
    docs = [(i, " ".join(rnd.sample(words, 120))) for i in range(100)] + [(100 + i, f"calm text number {i} of all") for i in range(100)]
    told = spark.createDataFrame([(i, 1, int(i < 100)) for i, _ in docs], "doc_id long, quality int, toxic int")
    model = T.fit(documents(docs), told, held_out=False)
    assert len(model.weights) > 4000


def test_without_labels_every_score_is_zero(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in T.score(documents([(1, "a b")]), T.fit(documents([(1, "a b")]), none)).collect()] == [0.0]
    assert T.score(documents([]), T.Model()).count() == 0


def test_gradient_matches_all_paths():
    """The slope against differences of the log-likelihood, which sums over all 2 ** 9 taggings of a window."""
    rng = np.random.default_rng(4)
    n, features = 5, 7
    f = rng.integers(0, features + 1, (n, T.LENGTH, T.SLOTS)).astype(np.uint32)
    valid = np.ones((n, T.LENGTH), np.uint32)
    valid[1, :3] = valid[2, 6:] = 0
    f[valid == 0] = 0
    y = (rng.random((n, T.LENGTH)) < 0.4).astype(np.uint32) * valid
    many = np.array([1, 2, 1, 3, 1])
    windows = [np.concatenate((a.ravel(), b, c)).tobytes() for a, b, c in zip(f, y, valid)]
    theta = rng.normal(0, 0.5, features + 1 + 4)
    theta[0] = 0

    def likelihood(t):
        w, bias, moves, total = t[:-4], t[-4], np.array([[0.0, t[-3]], [t[-2], t[-1]]]), 0.0
        for a, own, ok, k in zip(f, y, valid, many):
            at = np.flatnonzero(ok)
            light = w[a[at].astype(int)].sum(axis=1) + bias

            def path(tags):
                return float((light * tags).sum() + sum(moves[i, j] for i, j in zip(([0] if at[0] else []) + tags, tags if at[0] else tags[1:])))

            every = [path([(p >> i) & 1 for i in range(len(at))]) for p in range(1 << len(at))]
            total += k * (path(own[at].astype(int).tolist()) - np.logaddexp.reduce(every))
        return total

    got = T.slopes(theta, windows, many)
    for i in range(1, len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert abs((likelihood(theta + step) - likelihood(theta - step)) / 2e-5 - got[i]) < 1e-5


def test_scores_match_token_by_token(spark, documents):
    """Whole documents, every token's marginal by the plain recursion, then the score's formula."""
    docs, labels = case()
    model = T.fit(documents(docs[:200]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = [(i, t) for i, t in docs[200:230]] + [(900, "Vile, VILE rotten!"), (901, ""), (902, None), (903, "\u0130x vile \U0001f600vile rotten")]
    for r in T.score(documents(texts), model).collect():
        text = dict(texts)[r.doc_id] or ""
        words = T.tokens(text)
        marks = {i: e for i, w in enumerate(words) if (e := model.emission(w))}
        p = plain_marginals(max(marks) + 1, marks, model)[sorted(marks)] if marks else np.zeros(0)
        x = T.summary(np.array([len(words)]), np.array([len(marks)]), p)[0]
        assert abs(1 / (1 + np.exp(-x @ np.array(model.score))) - r.score) < 1e-6
        assert {w for s in r.toxic_spans for w in T.tokens(text[s.start : s.end])} == {words[i] for i, q in zip(sorted(marks), p) if q >= 0.5}


def test_equal_texts_with_two_labels_are_toxic(spark, documents):
    docs = [(i, f"fine words here {i % 5}") for i in range(20)] + [(100 + i, "some text") for i in range(4)]
    told = spark.createDataFrame([(i, 1, int(i == 102)) for i, _ in docs] + [(7, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    rows, totals = T.training_rows(documents(docs), told, 100, held_out=False)
    assert {r.text: r.toxic for r in rows.collect()} == {"some text": 1, "fine words here 2": 1, **{f"fine words here {k}": 0 for k in (0, 1, 3, 4)}}
