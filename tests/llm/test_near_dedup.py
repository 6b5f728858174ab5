"""SetSketch registers, their estimate, and near-duplicate classes against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from contactdq.llm import near_dedup as N
from contactdq.llm import setsketch as S
from contactdq.llm.common import Scratch
from contactdq.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def brute_classes(docs):
    sets = [brute_set(t) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    low = {}
    for (i, _), c in zip(docs, label):
        low[c] = min(low.get(c, i), i)
    return Counter((i, len(s), low[c]) for (i, _), s, c in zip(docs, sets, label))


def case():
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    docs = [(1000 + i, " ".join(rnd.choices(vocab, k=rnd.randrange(3, 120)))) for i in range(60)]
    for base in range(4):
        words = rnd.choices(vocab, k=100)
        for i in range(12):
            own = list(words)
            for _ in range(rnd.randrange(4)):
                own[rnd.randrange(100)] = rnd.choice(vocab)
            docs.append((base * 100 + i, " ".join(own)))
    docs += [(2000, docs[5][1]), (2001, docs[5][1].upper()), (2002, docs[5][1]), (3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "One  Two"), (3005, "x " * 3000), (3006, "X " * 2000), (1005, docs[5][1])]
    return docs


def test_classes_match_all_pairs(documents):
    docs = case()
    got = N.classes(documents(docs)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(docs)
    kept = N.one_of_each(documents(docs)).collect()
    want = sorted([*{c for _, n, c in brute_classes(docs) if n}, 3000, 3001, 3002])
    assert sorted(r.doc_id for r in kept) == want


def test_open_pairs_are_all_that_reach_the_threshold(spark):
    """Edited copies of a few originals, shrunken and extended ones too, each its own component or one of few: no pair above the threshold is left out."""
    rnd = random.Random(17)
    rows = []
    for group in range(6):
        base = [rnd.getrandbits(62) for _ in range(rnd.randrange(8, 90))]
        for i in range(25):
            own = {x for x in base if rnd.random() > 0.3 * rnd.random()} | {rnd.getrandbits(62) for _ in range(rnd.randrange(1 + len(base) // 3))} | set(rnd.sample(base, min(3, len(base))))
            rows.append((group * 100 + i, (group * 100 + i) // rnd.choice([1, 5]), len(own), sorted(own)))
    live = spark.createDataFrame(rows, "item long, c long, n long, shingles array<long>")
    pairs, links = N.open_pairs(Scratch(spark), live, 75, hot=10_000)
    assert links is None
    got = {(r.a, r.b) for r in pairs.collect()}
    want = set()
    for i, (a, ca, _, x) in enumerate(rows):
        for b, cb, _, y in rows[:i]:
            both = len(set(x) & set(y))
            if ca != cb and 100 * both >= 75 * len(set(x) | set(y)):
                want.add((min(a, b), max(a, b)))
    assert want and want <= got and len(got) < 0.5 * len(rows) ** 2 / 6
    # With small keys for pairs and small blocks for the rest, pairs and links together join the same components.
    comp = {r[0]: r[1] for r in rows}
    for items in (7, 1024):
        N.BLOCK_ITEMS = items
        pairs, links = N.open_pairs(Scratch(spark), live, 75, hot=6)
        links = {(r.a, r.b) for r in links.collect()}
        assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for sets in [{r[0]: set(r[3]) for r in rows}] for a, b in links)
        few = {(r.a, r.b) for r in pairs.collect()}
        assert joined(comp, (few & want) | links) == joined(comp, want)


def joined(comp, links):
    """The least component of each one that links join."""
    low = {c: c for c in comp.values()}
    for _ in low:
        for a, b in links:
            both = min(low[comp[a]], low[comp[b]])
            low[comp[a]] = low[comp[b]] = low[low[comp[a]]] = low[low[comp[b]]] = both
    return low


@pytest.mark.parametrize("n", [100, 200, 400])
def test_parts_of_one_template_make_no_pairs(spark, n):
    """Sets that each keep a random 80 of 100 shingles of a template, and two that are alike: few pairs, and the one link is found."""
    rnd = random.Random(n)
    base = [rnd.getrandbits(62) for _ in range(300)]
    rows = [(i, i, sorted(x for x in base if rnd.random() < 0.8)) for i in range(n)]
    rows += [(n, n, rows[0][2][12:])]
    live = spark.createDataFrame([(i, c, len(x), x) for i, c, x in rows], "item long, c long, n long, shingles array<long>")
    pairs, links = N.open_pairs(Scratch(spark), live, 75)
    assert pairs.count() <= 4 * n
    want = {(a, b) for b, _, y in rows for a, _, x in rows[:b] if 100 * len(set(x) & set(y)) >= 75 * len(set(x) | set(y))}
    assert (0, n) in want
    assert joined({i: i for i, _, _ in rows}, {(r.a, r.b) for r in links.collect()}) == joined({i: i for i, _, _ in rows}, want)


def test_classes_of_a_template_group(documents):
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    docs = [(i, " ".join(w if rnd.random() < 0.96 else f"n{rnd.random()}" for w in base)) for i in range(120)]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in N.classes(documents(docs)).collect()) == brute_classes(docs)


def test_rows_that_repeat_a_thousand_times(documents):
    docs = [(7, "one two three four five six seven")] * 1500 + [(8, "One two three four five six seven")] * 1500
    got = N.classes(documents(docs)).collect()
    assert len(got) == 3000 and {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(7, 3, 7), (8, 3, 7)}
    assert [r.doc_id for r in N.one_of_each(documents(docs)).collect()] == [7]


def test_copies_edited_each_in_its_own_way(documents):
    """A hot group without its original: the copies lie on both sides of the threshold to each other."""
    rnd = random.Random(23)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(90):
        own = list(base)
        for _ in range(rnd.randrange(1, 9)):
            own[rnd.randrange(len(own))] = f"n{i}x{rnd.random()}"
        if i % 7 == 0:
            own = own[: rnd.randrange(60, 120)]
        docs.append((i, " ".join(own)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in N.classes(documents(docs)).collect()) == brute_classes(docs)


def test_recall_of_pairs_over_all_rows(spark):
    """Every row whose id is divisible by 20 against all rows: at least 0.9 of the pairs above the threshold share a bucket (and so a component)."""
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    sets = {i: brute_set(t) for i, t in docs}
    comp = {r.doc_id: r.component_id for r in N.classes(table(spark, "/root/testdata/sf0.001", "documents")).collect()}
    pairs = [(i, j) for i in sets if i % 20 == 0 for j in sets if i != j and (both := len(sets[i] & sets[j])) and 100 * both >= 75 * len(sets[i] | sets[j])]
    assert sum(comp[i] == comp[j] for i, j in pairs) >= 0.9 * len(pairs)


def test_clashing_names_and_very_long_texts(documents):
    long = " ".join(f"w{i}" for i in range(30000))
    docs = documents([(1, long), (2, long + " tail"), (3, "short one")]).selectExpr("*", "'mine' AS _at", "'x' AS _id", "7 AS _twin", "8 AS at", "9 AS item", "1 AS `a.b`", "map('k', doc_id) AS m")
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r._at, r._id, r._twin, r.item) for r in kept.collect()) == [(1, "mine", "x", 7, 9), (3, "mine", "x", 7, 9)]


def test_empty_table_and_null_ids(documents):
    assert N.classes(documents([])).count() == 0 and N.one_of_each(documents([])).count() == 0
    got = N.classes(documents([(None, "a b c d e f"), (None, "a b c d e f"), (4, "A b c d e f"), (None, "other words")])).collect()
    assert Counter(r.component_id for r in got) == Counter([4, 4, 4, None])
    assert sum(r.is_head for r in got) == 2


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2) + np.uint64(1)
    a, b = x[:2000], x[400:2600]
    ra, rb = S.registers(a), S.registers(b)
    assert (S.merged(ra, rb) == S.registers(x[:2600])).all()
    j, lead = S.estimate(ra[None], rb[None], np.array([2000.0]), np.array([2200.0]), 0.75)
    assert abs(j[0] - 1600 / 2600) < 0.1 and lead[0] > 0
    assert S.estimate(ra[None], ra[None], np.array([2000.0]), np.array([2000.0]), 0.75)[0][0] == 1
