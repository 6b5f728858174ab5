"""Encoding, token files and packing: equality with the library, exact round trips, and how full the bins get."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contactdq.llm import packing as P
from contactdq.llm import token_files as T
from contactdq.llm.encoding import Encoder, encoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n x", "a  b \t\n c　d\x85e", "don't  DON'T 12345", "é é \U0001f600‍", " lead and trail ", "x" * 3000, "\x1c\x1f a\x00b", "A  B C  ", "token = \"24be64\"### | 1.5"]


def whole(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts():
    rnd = random.Random(6)
    texts = ODD + ["".join(rnd.choices("ab Z9'.\n\t 　é́\x1c", k=80)) for _ in range(200)]
    for path, keeps in ((WORDS, False), (BYTES, True)):
        full = Tokenizer.from_file(path)
        for t in texts:
            assert encoder(path, keeps).ids(t).tolist() == full.encode(t or "", add_special_tokens=False).ids, (path, t)


def test_random_texts_of_odd_characters_give_the_library_s_ids():
    """Letters whose lower case has a mark, combining marks, every kind of space, line ends, contractions, special tokens and their look-alikes."""
    rnd = random.Random(41)
    odd = list("abIZ9'. \n\t,!<|=>sSd") + ["  ", "\n\n", "\r\n", "'s", "'LL", "don't", "word", " the", "KOCAEL\u0130.", "\xe9", "\u0130", "\u0131", "\u03a3", "\u03c3\u03c2", "\xdf", "\u1e9e", "\ufb01", "e\u0301", "\u0301", "\u0307", "\u0338", "\u0345"]
    odd += ["\u3000", "\xa0", "\x85", "\u1680", "\u180e", "\u2003", "\u200b", "\u200d", "\u2028", "\u2060", "\ufeff", "\x1c", "\x1f", "\x0b", "\x0c", "\x00", "\u1100\u1161", "\u212b", "\u0967", "\xbd", "\U0001f44d\U0001f3fd", "\u4e2d"]
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "|>"]
    for path, keeps in ((WORDS, False), (BYTES, True)):
        full, own = Tokenizer.from_file(path), Encoder(path, keeps, cached=5000)
        for turn in range(60):
            texts = ["".join(rnd.choices(odd + special * (turn % 3 == 0), k=rnd.randrange(40))) for _ in range(100)]
            got = own.batch(pa.array([None, *texts]))
            assert len(got[0]) == 0 and all(g.tolist() == full.encode(t, add_special_tokens=False).ids for g, t in zip(got[1:], texts)), (path, turn)
    assert encoder(WORDS, False).ids("KOCAEL\u0130.").tolist() == [1313, 772, 6292, 136, 229, 269]


def test_added_tokens_end_a_segment():
    texts = ["one\n\n<|endoftext|>two", "<|endoftext|>", "a  \n<|startoftext|> b", "x<|endoftext|><|endoftext|>\n\n y", "é \t<|endoftext|>\u3000z", "one\n\n<|ENDOFTEXT|>two", "<|endof text|>"]
    assert encoder(BYTES, True).ids(texts[0]).tolist() == [505, 628, 50256, 11545]
    for path, keeps in ((WORDS, False), (BYTES, True)):
        for t in texts:
            assert encoder(path, keeps).ids(t).tolist() == whole(path, t), (path, t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(100, 140), max_size=300), st.sampled_from([50.0, 95.0, 100.0]))
def test_blocks_round_trip(values, percentile):
    ids = np.array(values, np.uint32)
    assert T.unpack_block(b"pad" + T.pack_block(ids, percentile), 3).tolist() == values


def test_blocks_packed_together_are_those_packed_alone():
    rnd = np.random.default_rng(3)
    for n, high in ((0, 9), (1, 9), (1024, 1), (5000, 2), (70_000, 49_408), (4096, 2**32)):
        ids = rnd.integers(0, high, n).astype(np.uint32)
        ids[::997] = high - 1
        raw = T.pack_file(ids, np.zeros(0, T._DOCUMENT))
        alone = b"".join(T.pack_block(ids[i : i + 1024]) for i in range(0, n, 1024))
        assert raw[4 : 4 + len(alone)] == alone and (T.unpack_file(raw, T.read_index(raw)[0]) == ids).all()


def test_files_seek_by_block():
    rnd = np.random.default_rng(1)
    ids = rnd.integers(0, 49408, 5000).astype(np.uint32)
    raw = T.pack_file(ids, np.array([(5, 1, 0, 5000)], T._DOCUMENT))
    for a, n in ((0, 5000), (1023, 2), (4999, 1), (2048, 1024), (7, 0)):
        assert (T.read_tokens(raw, a, n) == ids[a : a + n]).all()


def case():
    rnd = random.Random(8)
    docs = [(i * 13 % 101, " ".join(rnd.choices(["alpha", "beta", "Gamma,", "delta\n"], k=rnd.randrange(400)))) for i in range(101)]
    return docs + [(500 + i, t) for i, t in enumerate(ODD)] + [(600, "word " * 5000), (None, "no id"), (3, "again"), (3, "again")]


def test_token_files_round_trip(spark, documents):
    docs = case()
    files = T.write_files(documents(docs), WORDS, 2, file_tokens=4000)
    got = T.read_files(spark, files).collect()
    want = Counter()
    for i, t in docs:
        ids = np.array([*whole(WORDS, t), 2], "<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i))
    assert files.count() > 2 and T.read_files(spark, T.write_files(documents([]), WORDS, 2)).count() == 0


def test_packing_is_whole_and_tight(documents):
    docs = case()
    got = P.pack(documents(docs), BYTES, 2, task_bins=16).collect()
    pieces = defaultdict(list)
    for i, t in docs:
        ids = np.array([*whole(BYTES, t), 2], "<u4")
        at = 0
        for k, n in enumerate(P.cut_lengths(len(ids))):
            pieces[(i, k, at, n, zlib.crc32(ids[at : at + n].tobytes()))].append(1)
            at += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter({k: len(v) for k, v in pieces.items()})
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 2
    assert P.pack(documents([]), BYTES, 2).count() == 0


def test_packing_over_many_tasks_leaves_few_half_full_bins(spark, documents):
    rnd = random.Random(12)
    docs = documents([(i, "word " * rnd.randrange(1, 900)) for i in range(1500)]).repartition(90)
    got = P.pack(docs, BYTES, 2, task_bins=8).collect()
    fills = Counter()
    for r in got:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 1024 and sum(2 * f <= 1024 for f in fills.values()) <= 1
    assert len(fills) <= 1.1 * sum(fills.values()) / 1024
    hot = documents([(None, "same text " * 30)] * 300 + [(7, "x " * 3000)] * 3).selectExpr("*", "1 AS piece", "2 AS bin", "3 AS pieces")
    assert sum(r.length for r in P.pack(hot, BYTES, 2).collect()) == 300 * (len(whole(BYTES, "same text " * 30)) + 1) + 3 * (len(whole(BYTES, "x " * 3000)) + 1)


def test_hot_ids_are_spread_and_ordered(spark, documents):
    docs = [(None, f"text {i % 40} " * 20) for i in range(400)] + [(5, f"five {i}") for i in range(400)] + [(i, "x") for i in range(100)]
    files = T.write_files(documents(docs).selectExpr("*", "1 AS part", "2 AS first"), WORDS, 2, file_tokens=500)
    assert files.groupBy("part").count().count() > 1
    got = sorted(T.read_files(spark, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 400 + sorted(i for i, _ in docs if i is not None)
    again = sorted(T.read_files(spark, T.write_files(documents(docs[::-1]), WORDS, 2)).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == [tuple(r) for r in again]


def test_best_fit_keeps_every_item():
    rnd = random.Random(9)
    fills = [rnd.randrange(1, 1024) for _ in range(3000)]
    bins = P.best_fit(fills)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and all(sum(fills[i] for i in b) <= 1024 for b in bins)
    assert len(bins) <= 1.02 * sum(fills) / 1024
