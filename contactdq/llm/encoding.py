"""Whole texts to token ids with a public tokenizer file.

A text is cut only where the file's own splitting must end a piece whatever stands around, each piece is encoded by the library, and
pieces seen before come from a bounded cache. So the ids are those of encoding the whole text. The cuts, and why they are safe:

- A file that drops white space and lower-cases (``keeps_space=False``): at ASCII white space, which no piece of its pattern holds and no
  normalisation joins with a neighbour. A-Z are lower-cased beforehand, but not in texts with combining marks, which may join with one case of a letter only.
- A byte-level file that keeps it (``keeps_space=True``): before a space or line end that follows a character that is no white space.
  Every piece of its pattern ends there, and the look-ahead for white space does not reach back. Characters that some
  definition of white space holds count as such; where one stands before a space or line end the text is cut by a slower pattern that leaves them together.
- Both: between a Latin letter whose lower case is one letter and ASCII punctuation. A run of letters is always taken to its end, and punctuation joins with what follows alone.

A text that holds one of the file's added tokens, which end a segment before any splitting, is encoded whole.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed: ASCII white space, all characters that Unicode or some regular expression engine counts as white space or did so once, letters, punctuation, combining marks.
_ASCII = r"\t-\r "
_SPACE = "\\t-\\r \x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_LETTER, _PUNCTUATION = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}", r"!-/:-@\[-`{-~"
_MARKS = r"\x{300}-\x{36F}"
_RUNS = re.compile(rf"[{_ASCII}]*[^{_ASCII}]+(?:(?<=[{_SPACE}])[{_ASCII}]+[^{_ASCII}]+)*(?:(?<=[{_SPACE}])[{_ASCII}]+)?|[{_ASCII}]+")
_CUT = "\x00"


class Encoder:
    """A tokenizer file with a cache of pieces; made once in each Python worker. The cache holds a few dozen bytes for each piece."""

    def __init__(self, path: str, keeps_space: bool, cached: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keeps_space, self.cached = Tokenizer.from_file(path), keeps_space, cached
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        added = "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in self.added)
        self.odd = "|".join([f"(?i:{added})"] * bool(added) + ([rf"[{_SPACE}][ \n]|\x00"] if keeps_space else [f"[{_MARKS}]"]))
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        # Known pieces by number; where the ids of each end; all ids one after another.
        self.known, self.ends, self.store = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, self.kind)

    def _learn(self, fresh: pa.Array) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(fresh.to_pylist(), add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        ids = np.fromiter(chain.from_iterable(found), self.kind, int(ends[-1]))
        self.known = pa.concat_arrays([self.known, fresh])
        self.ends, self.store = np.concatenate((self.ends, self.ends[-1] + ends)), np.concatenate((self.store, ids))

    def _pieces_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and where those of each end."""
        if len(self.known) > self.cached:
            # The half that was learned first stays: frequent pieces come early.
            keep = self.cached // 2
            self.known, self.ends, self.store = self.known[:keep], self.ends[: keep + 1], self.store[: self.ends[keep]]
        coded = pieces.dictionary_encode()
        found, before = pc.index_in(coded.dictionary, value_set=self.known), len(self.known)
        numbers = pc.fill_null(found, -1).to_numpy()
        if found.null_count:
            self._learn(coded.dictionary.filter(pc.is_null(found)))
            numbers = np.where(numbers < 0, before - 1 + np.cumsum(numbers < 0), numbers)
        each = numbers[coded.indices.to_numpy()]
        starts = self.ends[:-1][each]
        sizes = self.ends[1:][each] - starts
        ends = np.cumsum(sizes)
        places = np.repeat(starts - (ends - sizes), sizes)
        places += np.arange(len(places))
        return self.store[places].astype(np.uint32), ends

    def _split(self, texts: pa.Array) -> pa.Array:
        cut = pc.replace_substring_regex(texts, f"([{_LETTER}])([{_PUNCTUATION}])", rf"\1{_CUT if self.keeps_space else ' '}\2")
        if not self.keeps_space:
            return pc.ascii_split_whitespace(pc.ascii_lower(cut))
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(cut, " ", _CUT + " "), "\n", _CUT + "\n"), _CUT)

    def _alone(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self._pieces_ids(pa.array(_RUNS.findall(text), pa.string()))[0]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of whole texts, without special tokens; none for null or empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            lists = self._split(texts.filter(pa.array(~odd)) if odd.any() else texts)
            flat, ends = self._pieces_ids(lists.flatten())
            bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))]
            for i, a, b in zip(plain.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                out[i] = flat[a:b]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._alone(texts[i].as_py())
        pa.default_memory_pool().release_unused()
        return out

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of one whole text."""
        return self.batch(pa.array([text], pa.string()))[0]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool) -> Encoder:
    """One encoder for each worker process and file; tokenizers' own threads stay off, as tasks fill the cores."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, keeps_space)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, keeps_space)
    return _encoders[key]
