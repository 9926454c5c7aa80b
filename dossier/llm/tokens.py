"""Exact token ids at the cost of one model call per distinct piece of text.

A tokenizer of the ``tokenizers`` library first cuts a text into pieces and then runs its BPE model over each.
Here the pieces of a block are cut by array operations over bytes, equal pieces are found by hash, and only
pieces that this worker has not met before go through the library's model; their ids are kept for later blocks
(at most ``KEEP`` pieces, then the store starts anew, which changes no result).  Only runs of ASCII characters
and Latin letters of two bytes are cut this way.  Words with anything else go to the whole tokenizer, and so do
documents with white space outside ASCII.  Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .text import _LOWER, U64, Block

KEEP = 1_500_000
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[32, *range(9, 14)]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = _ODD  # an apostrophe may begin a contraction


def _byte_chars() -> dict[int, str]:
    """The usual printable stand-ins for bytes: bytes that print stay, the others move up from code point 256 in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


_CHARS = str.maketrans({chr(b): c for b, c in _byte_chars().items()})
_OPEN: dict[str, "PieceTokenizer"] = {}


def open_tokenizer(path: str) -> "PieceTokenizer":
    """One tokenizer per worker process and path, with its store of pieces."""
    if path not in _OPEN:
        _OPEN[path] = PieceTokenizer(path)
    return _OPEN[path]


class PieceTokenizer:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        spec = json.loads(self.whole.to_str())
        self.words = spec["model"].get("end_of_word_suffix") == "</w>"  # white space dropped, lower case; else byte level with leading spaces
        self.model = self.whole.model
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and where each text's begin (one more than there are texts)."""
        block = Block(texts)
        raw = _LOWER[block.raw] if self.words else block.raw
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(block.n + 1, np.int64)
        kind = _CLASS[raw]
        lead = np.flatnonzero(raw == 0xC3)
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        if self.words:
            up = lead[raw[lead + 1] < 0x9F]
            raw[up + 1] += 32
        block.raw = raw
        odd_words = self._odd_words(block, kind)
        starts, ends, odd = (self._word_pieces if self.words else self._byte_pieces)(block, kind, odd_words)
        hashes = block.hash_spans(starts, ends)
        keys, place, which = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(block, keys, starts[place], ends[place], odd[place])
        slot = np.searchsorted(self.keys, keys)
        at, size = self.at[slot][which], self.size[slot][which]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(at - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        offsets = np.concatenate([[0], stop])[np.searchsorted(starts, block.offsets)]
        return self._wide(texts, block, ids, offsets)

    def _odd_words(self, block: Block, kind: np.ndarray) -> np.ndarray:
        """By byte: part of a word with a character that is not cut by class."""
        bad = np.concatenate([[0], np.cumsum(kind == _ODD)])
        words = bad[block.ends] > bad[block.starts]
        edge = np.zeros(len(kind) + 1, np.int8)
        edge[block.starts[words]] += 1
        edge[block.ends[words]] -= 1
        return np.cumsum(edge)[:-1] > 0

    def _inner(self, block: Block, kind: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Places inside ordinary words where the class changes."""
        cut = np.zeros(len(kind), bool)
        cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] != _SPACE) & (kind[:-1] != _SPACE) & ~odd[1:]
        return cut

    def _word_pieces(self, block: Block, kind: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = self._inner(block, kind, odd)
        cut[1:] |= (kind[1:] == _DIGIT) & (kind[:-1] == _DIGIT) & ~odd[1:]
        cut[block.starts] = True
        starts = np.flatnonzero(cut)
        word = np.searchsorted(block.starts, starts, "right") - 1
        ends = block.ends[word]
        if len(starts):
            ends[:-1] = np.minimum(ends[:-1], starts[1:])
        return starts, ends, odd[starts]

    def _byte_pieces(self, block: Block, kind: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, raw = len(kind), block.raw
        cut = self._inner(block, kind, odd)
        cut[block.offsets[:-1][block.offsets[:-1] < n]] = True
        # Of the white space between two words, all but the last character is a piece; a last blank leads the next word.
        first, last = block.starts, np.zeros(len(block.starts), bool)
        begin = np.repeat(block.offsets[:-1], block.counts)
        inside = first > begin
        cut[first[inside] - 1] = True
        last[inside] = raw[first[inside] - 1] != 32
        cut[first[last]] = True
        cut[block.ends[block.ends < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        return starts, ends, odd[starts] | odd[ends - 1]

    def _learn(self, block: Block, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> None:
        if len(self.keys) > KEEP:
            self._clear()
        slot = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[slot] != keys) if len(self.keys) else np.arange(len(keys))
        if not len(new):
            return
        raw, run, flat, size = block.raw.tobytes(), self.model.tokenize, [], []
        for a, b, o in zip(starts[new].tolist(), ends[new].tolist(), odd[new].tolist()):
            ids = self.whole.encode(raw[a:b].decode(), add_special_tokens=False).ids if o else [t.id for t in run(raw[a:b].decode("latin-1").translate(_CHARS))]
            flat += ids
            size.append(len(ids))
        size = np.array(size, np.int64)
        keys = np.concatenate([self.keys, keys[new]])
        at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        order = np.argsort(keys)
        self.keys, self.at, self.size = keys[order], at[order], np.concatenate([self.size, size])[order]
        self.flat = np.concatenate([self.flat, np.array(flat, np.uint32)])

    def _wide(self, texts: pa.Array, block: Block, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents with white space beyond ASCII, through the whole tokenizer (byte level only)."""
        if self.words:
            return ids, offsets
        r = block.raw
        two, three = np.append(r[1:], 0), np.append(r[2:], [0, 0])[: len(r)]
        wide = (r == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (r == 0xE1) & (two == 0x9A) & (three == 0x80) | (r == 0xE3) & (two == 0x80) & (three == 0x80)
        wide |= (r == 0xE2) & ((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F))
        if not wide.any():
            return ids, offsets
        docs = np.unique(np.searchsorted(block.offsets, np.flatnonzero(wide), "right") - 1)
        parts = np.split(ids, offsets[1:-1])
        for d in docs.tolist():
            parts[d] = np.array(self.whole.encode(texts[d].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
