"""Decontamination and substring dedup against plain Python."""

import hashlib
import random
import re
import time
from collections import Counter

from contactdq.llm import decontamination as D
from contactdq.llm import substring_dedup as B

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_contamination(docs, items, window):
    cut = [(i, w) for i, t in items for words in [ALNUM.findall(lower(t))] if words for size in [min(window, len(words))] for w in {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}]
    out = []
    for i, t in docs:
        words, hit, own = ALNUM.findall(lower(t)), set(), set()
        for item, w in cut:
            for k in range(len(words) - len(w) + 1):
                if tuple(words[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    own |= {str(item)} if item is not None else set()
        out.append((i, len(words), len(hit), tuple(sorted(own))))
    return Counter(out)


def contaminated_case():
    rnd = random.Random(2)
    vocab = ["the", "of", "a"] + [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rnd.choices(vocab, k=rnd.choice([1, 3, 6, 10, 11, 40])))) for k in range(12)] + [(12, None), (13, " .,"), (None, "zz yy xx"), (3, "one more text of three"), (14, "Ñandú-é \U0001f600 MiXed")]
    docs = []
    for i in range(60):
        words = rnd.choices(vocab, k=rnd.randrange(80))
        if i % 3 == 0:
            t = items[rnd.randrange(12)][1].split()
            words[10:10] = t
        docs.append((i, " ".join(words).upper() if i % 5 == 0 else ", ".join(words)))
    docs += [(100, None), (101, ""), (102, "x " * 3000 + items[4][1]), (None, items[5][1]), (5, docs[5][1]), (103, "a ñandú é \U0001f600 mixed zz-yy xx")]
    return docs, items


def test_contamination_matches_brute_force(spark, documents):
    docs, items = contaminated_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in D.contamination(documents(docs), bench).collect())
    assert got == brute_contamination(docs, items, 10)
    clean = D.clean_documents(documents(docs), bench)
    assert clean.columns == documents([]).columns and clean.count() == sum(n for (_, _, h, _), n in got.items() if not h)


def test_contamination_of_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.doc_id, r.n_hit) for r in D.contamination(documents([(1, "a b")]), none).collect()] == [(1, 0)]
    assert D.contamination(documents([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def brute_removed(docs, window):
    texts = [(i, WORD.findall(t or "")) for i, t in docs]
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, words in texts:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, rank(i)), rank(i))
    out = []
    for i, words in texts:
        gone = {p for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] < rank(i) for p in range(k, k + window)}
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(w for p, w in enumerate(words) if p not in gone).encode()).hexdigest()))
    return Counter(out)


def repeated_case():
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    passages = [rnd.choices(vocab, k=70) for _ in range(3)]
    docs = []
    for i in range(60):
        words = rnd.choices(vocab, k=rnd.randrange(150))
        for p in rnd.sample(passages, rnd.randrange(3)):
            at = rnd.randrange(len(words) + 1)
            words[at:at] = p[rnd.randrange(20) :]
        docs.append((i * 7 % 61, "\t ".join(words) if i % 2 else " ".join(words)))
    docs += [(200, docs[3][1]), (201, docs[3][1]), (3, docs[9][1]), (None, docs[4][1]), (202, "x " * 400), (203, "x " * 300), (204, None), (205, ""), (206, "é " * 49), (200, docs[3][1])]
    return docs


def test_substring_dedup_matches_brute_force(documents):
    docs = repeated_case()
    want = brute_removed(docs, 50)
    for split in (2048, 1):
        got = B.deduplicated(documents(docs), 50, split=split, with_text=split == 1)
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want
    assert B.deduplicated(documents([]), 50).count() == 0


def test_clean_documents_keep_clashing_columns(spark, documents):
    docs, items = contaminated_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ("_key", "_row", "_text", "_k1", "rid", "hits", "n_words")
    odd = documents(docs + docs[:5]).selectExpr("*", *(f"'mine' AS {c}" for c in names), "1 AS `a.b`")
    got = D.clean_documents(odd, bench, 10)
    assert got.columns == odd.columns and all(r[c] == "mine" for r in got.collect() for c in names)
    clean = Counter((i, n) for (i, n, hit, _), k in brute_contamination(docs + docs[:5], items, 10).items() for _ in range(k) if not hit)
    assert Counter((r.doc_id, len(ALNUM.findall(lower(r.text)))) for r in got.collect()) == clean
    assert D.clean_documents(documents([]), bench, 10).count() == 0


def test_rows_that_repeat_a_thousand_times(documents):
    """Two ids, repeated as often as each other, with a passage in common: the work grows with the rows."""
    passage = " ".join(f"p{i}" for i in range(80))
    docs = [(1, passage + " one")] * 1600 + [(2, "two " + passage + " and " + passage)] * 1600
    began = time.time()
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in B.deduplicated(documents(docs), 50, with_text=False).collect())
    assert got == {(1, 81, 0): 1600, (2, 162, 160): 1600}
    assert time.time() - began < 40
