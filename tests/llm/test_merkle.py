"""The manifest against plain hashing, with small buckets so that several rounds are needed."""

import hashlib
import random
import zlib

import pytest

from contactdq.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, g string, pos long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, tampered=False):
    doc_id, text, lang, source, n_chars = row
    text = text.replace("\n", "") if tampered and text is not None else text
    told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha(*told)


def plain_tree(nodes):
    """The root over some nodes, and for each of them (left, right) siblings by level."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(now) > 1:
        for i, a in enumerate(at):
            run = now[a // 3 * 3 : a // 3 * 3 + 3]
            paths[i].append(("".join(run[: a % 3]), "".join(run[a % 3 + 1 :])))
        now, at = [sha(*now[i : i + 3]) for i in range(0, len(now), 3)], [a // 3 for a in at]
    return now[0], paths


def plain_manifest(rows):
    of = {}
    for row in rows:
        of.setdefault(row[3], []).append(row)
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    for own in of.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    trees = {s: plain_tree([plain_leaf(r) for r in of[s]]) for s in names}
    root, upper = plain_tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper):
        for row, path in zip(of[s], trees[s][1]):
            path = path + above
            f = plain_leaf(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0)
            for left, right in path:
                f = sha(left, f, right)
            out.append((row[0], plain_leaf(row), trees[s][0], root, sha(*[x for p in path for x in p]), f, f == root))
    return sorted(out, key=str)


def got(spark, rows, levels):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 5) for r in rows], SCHEMA)
    return sorted(map(tuple, M.manifest(docs, levels).collect()), key=str)


def some_rows(n, sources, seed):
    rnd = random.Random(seed)
    texts = [None, "", "a\nb\n", "one line", "ü\n€ \U0001f600\n", "\n", "long " * 50_000 + "\n"]
    weights = [1 if s else 3 for s in sources]  # the first, empty or null, is hot
    return [(i if rnd.random() < 0.97 else None, rnd.choice(texts), rnd.choice(["en", None]), rnd.choices(sources, weights)[0], rnd.choice([None, 3])) for i in rnd.sample(range(-5, 10 * n), n)]


@pytest.mark.parametrize("n,levels", [(1, 1), (2, 1), (40, 1), (95, 2), (300, 7)])
def test_manifest_like_plain_hashing(spark, n, levels):
    rows = some_rows(n, [None, "", "b", "B", "ä", "a" * 70, *map(str, range(12))], n)
    assert got(spark, rows, levels) == plain_manifest(rows)


def test_repeated_rows_and_tables_of_several_task_fulls(spark, monkeypatch):
    rows = [(i // 4, f"t{i % 2}\n", None, "s" if i % 3 else None, 1) for i in range(400)]
    monkeypatch.setattr(M, "HELD", 30)
    assert got(spark, rows, 1) == plain_manifest(rows)


def test_empty_table(spark):
    assert got(spark, [], 7) == []
    assert M.manifest(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
