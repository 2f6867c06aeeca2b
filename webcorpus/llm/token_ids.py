"""Token ids of whole texts, by the tokenizers library, with each distinct word of a slice encoded at most once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import split_words

#: Words whose ids a worker keeps (as one Arrow array and one flat array of ids), words of one call of the library.
MOST_WORDS, WORDS_AT_ONCE = 600_000, 4096
#: Bytes of text that are encoded together.
SLICE_BYTES = 8 << 20
#: Between words of one call: a character that no text should have; words with it are encoded by themselves.
MARK = "\x01"
_ENCODERS: dict[int, Encoder] = {}


class Encoder:
    """ids(texts): equal to ``encode(text, add_special_tokens=False).ids`` of each text.

    For tokenizers that part texts at white space and drop it: then the ids of a text are those of its blank-separated
    words, one after another. Words of ASCII letters are folded to lower case first where the tokenizer does that too.
    """

    def __init__(self, content: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.fold = '"Lowercase"' in content
        mark = self._by_itself([MARK])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self._keep(pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    @staticmethod
    def of(content: str) -> Encoder:
        key = hash(content)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(content)
        return _ENCODERS[key]

    def _keep(self, words: pa.Array, flat: np.ndarray, lengths: np.ndarray, uses: np.ndarray) -> None:
        self.words, self.flat, self.lengths, self.uses = words, flat, lengths, uses

    def _by_itself(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the number of each word's."""
        out, lengths = [], []
        for i in range(0, len(words), WORDS_AT_ONCE):
            part = words[i : i + WORDS_AT_ONCE]
            odd = self.mark is None or any(MARK in w or "<|" in w or not w for w in part)
            if not odd:
                joined = f" {MARK} ".join(part)
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                at = np.flatnonzero(ids == self.mark)
                odd = len(at) != len(part) - 1
            if odd:
                each = self._by_itself(part)
                out += each
                lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
            else:
                out.append(np.delete(ids, at))
                lengths.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), (np.concatenate(lengths) if lengths else np.zeros(0, np.int64))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids (one more than texts), and the ids of all texts (uint32)."""
        offsets, tokens = split_words(texts)
        if self.fold and len(tokens):
            plain = pc.and_(pc.string_is_ascii(tokens), pc.invert(pc.match_substring(tokens, "<|")))
            tokens = pc.if_else(plain, pc.ascii_lower(tokens), tokens)
        encoded = tokens.dictionary_encode()
        index = encoded.indices.to_numpy(zero_copy_only=False)
        if not len(index):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint32)
        words = encoded.dictionary
        place = pc.index_in(words, value_set=self.words) if len(self.words) else pa.nulls(len(words), pa.int32())
        known = place.is_valid().to_numpy(zero_copy_only=False)
        fresh = words.filter(pc.is_null(place))
        flat, count = self._encode(fresh.to_pylist())
        # ids of the kept words, then of the new ones
        at = np.empty(len(words), np.int64)
        at[known] = place.drop_null().to_numpy()
        at[~known] = len(self.words) + np.arange(len(fresh))
        self.uses[at[known]] += 1
        flat, count = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, count])
        starts = np.cumsum(count) - count
        where = at[index]
        each = count[where]
        ends = np.concatenate([[0], np.cumsum(each)])
        kind = np.int32 if max(len(flat), ends[-1]) < 1 << 31 else np.int64
        pick = np.arange(ends[-1], dtype=kind)
        pick += np.repeat((starts[where] - ends[:-1]).astype(kind), each)
        self._remember(pa.concat_arrays([self.words, fresh.cast(pa.string())]), flat, count, np.concatenate([self.uses, np.ones(len(fresh), np.int64)]))
        out = flat[pick]
        pa.default_memory_pool().release_unused()
        return ends[offsets], out

    def _remember(self, words: pa.Array, flat: np.ndarray, lengths: np.ndarray, uses: np.ndarray) -> None:
        """Keeps the words; when there are too many, the half that most slices used (uses then age)."""
        if len(words) > MOST_WORDS:
            best = np.sort(np.argsort(-uses, kind="stable")[: MOST_WORDS // 2])
            starts = np.cumsum(lengths) - lengths
            n = lengths[best]
            pick = np.arange(int(n.sum())) + np.repeat(starts[best] - (np.cumsum(n) - n), n)
            words, flat, lengths, uses = words.take(pa.array(best)), flat[pick], n, uses[best] // 2
        self._keep(words, flat, lengths, uses)


def with_end(offsets: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with id ``end`` after each text."""
    n = len(offsets) - 1
    out = np.empty(len(ids) + n, np.uint32)
    ends = offsets[1:] + np.arange(n)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask], out[ends] = ids, end
    return offsets + np.arange(n + 1), out
