"""Text similarity and Unicode folding where no built-in function exists: Arrow batches, never row by row calls."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


_HYPHENATED = re.compile(r"-\s*\n\s*")
_NO_WORD = re.compile(r"[^a-z0-9\s]")
_BARE = re.compile(r"[^a-z0-9]")
_NO_NAME = re.compile(r"[^A-Za-z\s'-]")


def fold(text: str | None) -> str:
    """Lower case without marks and punctuation, words hyphenated across lines joined, one blank between words."""
    t = unicodedata.normalize("NFKD", text or "")
    t = _HYPHENATED.sub("", "".join(ch for ch in t if not unicodedata.combining(ch)).lower())
    return " ".join(_NO_WORD.sub(" ", t).split())


def last_name(text: str | None) -> str:
    """The last word of a name as bare letters."""
    t = unicodedata.normalize("NFKD", (text or "").replace("\u2019", "'").replace("\u2018", "'"))
    parts = _NO_NAME.sub(" ", "".join(ch for ch in t if not unicodedata.combining(ch))).split()
    return parts[-1].lower().replace("-", "").replace("'", "") if parts else ""


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table as the bits of one number."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        same = row & masks.get(c, 0)
        row = ((row + same) | (row - same)) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    """100 less the insertions and deletions between two texts in percent of both lengths."""
    return 200.0 * subsequence(a, b) / (len(a) + len(b)) if a or b else 0.0


def token_set(a: str, b: str) -> float:
    """Shared words against shared words with either side's rest; the best of the three comparisons, 100 if one side has no rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (one and two):
        return 100.0
    gap = 1 if both else 0
    left, right = len(both) + gap + len(one), len(both) + gap + len(two)
    same = len(both) + gap + subsequence(one, two)  # a common beginning is part of every longest subsequence
    best = 200.0 * same / (left + right)
    return max(best, 200.0 * len(both) / (len(both) + left), 200.0 * len(both) / (len(both) + right)) if both else best


def partial(a: str, b: str) -> float:
    """The shorter text against the window of the longer one, of its length or cut off at an end, that has the most in common.

    The measure is 200 x longest common subsequence / both lengths; all windows step through the shorter text's bits at once.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(a, b)


def _windows(a: str, b: str) -> float:
    codes = {c: i + 1 for i, c in enumerate(dict.fromkeys(a))}  # 0: in none of a's places
    common = _window_common(a, codes, np.array([codes.get(c, 0) for c in b]))
    start = np.arange(len(common)) - (len(a) - 1)
    length = np.minimum(start + len(a), len(b)) - np.maximum(start, 0)
    return float((200.0 * common / (len(a) + length)).max())


def title_ratio(a: str, b: str) -> float:
    """The better of the shared words and of the best window without blanks; both texts folded, 0 if either is empty."""
    if not a or not b:
        return 0.0
    words = token_set(a, b)
    return words if words >= 100.0 else max(words, partial(a.replace(" ", ""), b.replace(" ", "")))


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    return text.map(fold)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = a.map(fold), b.map(fold)
    return pd.Series([round(title_ratio(p, q), 2) for p, q in zip(x, y)], dtype="float64")


@F.pandas_udf(StringType())
def surname(name: pd.Series) -> pd.Series:
    return name.map(last_name)


def word_score(words: str, title: str) -> float:
    """How well a citation key's title words fit a title: by words, by the best window, and by that without separators."""
    low = title.lower()
    return max(token_set(words, low), partial(words, low), partial(_BARE.sub("", words.lower()), _BARE.sub("", low)))


def partial_many(a: str, texts: list[str]) -> np.ndarray:
    """partial(a, t) of every text: those no shorter than ``a`` in one pass, laid end to end with gaps that no window spans."""
    out = np.zeros(len(texts))
    m = len(a)
    long = [i for i, t in enumerate(texts) if m and len(t) > m]
    for i, t in enumerate(texts):
        if m and len(t) <= m:
            out[i] = partial(a, t)
    if long:
        gap = "\0" * (m - 1)
        size = np.array([len(texts[i]) for i in long])
        begin = np.concatenate([[0], np.cumsum(size + m - 1)[:-1]])  # of each text's windows
        joined = np.frombuffer(gap.join(texts[i] for i in long).encode("utf-32-le"), np.uint32)
        codes = {ord(c): i + 1 for i, c in enumerate(dict.fromkeys(a))}
        keys = np.array(sorted(codes), np.uint32)
        at = np.minimum(np.searchsorted(keys, joined), len(keys) - 1)
        symbols = np.where(keys[at] == joined, np.array([codes[int(k)] for k in keys])[at], 0)
        common = _window_common(a, codes, symbols)
        start = np.arange(len(common)) - np.repeat(begin, size + m - 1) - (m - 1)
        length = np.minimum(start + m, np.repeat(size, size + m - 1)) - np.maximum(start, 0)
        out[long] = np.maximum.reduceat(200.0 * common / (m + length), begin)
    return out


def _window_common(a: str, codes: dict, symbols: np.ndarray) -> np.ndarray:
    """Longest common subsequence of ``a`` with each window of its length, those that only begin or end inside the text too."""
    m, n, words = len(a), len(symbols), -(-len(a) // 64)
    masks = np.zeros((len(codes) + 1, words), np.uint64)
    for i, c in enumerate(a):
        masks[codes.get(c, codes.get(ord(c), 0)), i // 64] |= np.uint64(1 << i % 64)
    text = np.zeros(n + 2 * (m - 1), np.int64)
    text[m - 1 : m - 1 + n] = symbols
    count = n + m - 1
    v = [np.full(count, 2**64 - 1, np.uint64) for _ in range(words)]
    for j in range(m):
        at = text[j : j + count]
        carry = np.zeros(count, np.uint64)
        for k in range(words):
            u = v[k] & masks[at, k]
            one = v[k] + u
            two = one + carry
            carry = ((one < u) | (two < carry)).astype(np.uint64)
            v[k] = two | (v[k] - u)
    common = np.zeros(count, np.int64)
    for k in range(words):
        here = min(64, m - 64 * k)
        common += here - np.bitwise_count(v[k] & np.uint64((1 << here) - 1)).astype(np.int64)
    return common


#: Places for pairs of characters; two pairs that share one only raise a bound.
PAIRS = 1_024
#: Bounds are computed in single precision.
ROUNDING = 1e-3


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of every pair of neighbouring characters."""
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), size)
    inside = owner[1:] == owner[:-1]
    return owner[1:][inside], ((codes[:-1] * np.uint32(2654435761) + codes[1:] * np.uint32(40503)) >> np.uint32(7))[inside] % np.uint32(PAIRS)


def _window_bound(shared: np.ndarray, m: np.ndarray) -> np.ndarray:
    """At most partial() of two texts, the shorter of length ``m``, that share so many pairs of characters.

    l characters in common with a window of length w leave l - 1 - (m - l) - (w - l) of them beside each other in both, so
    3 l <= shared + 1 + m + w, and l <= w <= m: 200 l / (m + w) is largest where both hold at once.
    """
    w = np.minimum(m, (shared + 1 + m) / 2)
    return np.where(m > 0, 200 * w / np.maximum(m + w, 1), 0) + np.float32(ROUNDING)


class Titles:
    """Titles folded once, to be scored against several keys' words."""

    def __init__(self, titles: list[str]):
        self.low = [t.lower() for t in titles]
        self.bare = [_BARE.sub("", t) for t in self.low]
        self._index = None

    def scores(self, words: str, which: np.ndarray | None = None, by_words: np.ndarray | None = None) -> np.ndarray:
        """word_score(words, t) of every title, or of those at the places ``which``; where ``by_words`` bounds token_set below the rest, that isn't computed."""
        low, bare = (self.low, self.bare) if which is None else ([x[i] for i in which] for x in (self.low, self.bare))
        best = np.maximum(partial_many(words, low), partial_many(_BARE.sub("", words.lower()), bare))
        for i, t in enumerate(low):
            if by_words is None or by_words[i] >= best[i]:
                best[i] = max(best[i], token_set(words, t))
        return best

    def bounds(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """At least word_score(words, t), and at least token_set: a row per title, a column per words."""
        if self._index is None:
            maps = []
            for texts in (self.low, self.bare):
                has = np.zeros((len(texts), PAIRS), np.float32)
                has[_pairs(texts)] = 1
                maps.append((has, np.array([len(t) for t in texts], np.float32)[:, None]))
            where: dict[str, list[int]] = {}
            sets = [set(t.split()) for t in self.low]
            for i, s in enumerate(sets):
                for w in s:
                    where.setdefault(w, []).append(i)
            self._index = maps, where, np.array([sum(len(w) + 1 for w in s) - 1 for s in sets], np.float32)[:, None]
        maps, where, right = self._index
        bare = [_BARE.sub("", w.lower()) for w in many]
        best, pairs = [], []
        for texts, (has, size) in zip((many, bare), maps):
            times = np.zeros((len(texts), PAIRS), np.float32)
            np.add.at(times, _pairs(texts), 1)
            pairs.append(has @ times.T)
            best.append(_window_bound(pairs[-1], np.minimum(size, np.array([len(t) for t in texts], np.float32)[None, :])))
        # token_set: common words and a longest subsequence of the rests; where two words meet, pairs may be new.
        sets = [set(w.split()) for w in many]
        left = np.array([sum(len(w) + 1 for w in s) - 1 for s in sets], np.float32)[None, :]
        shared = np.zeros((len(self.low), len(many)), np.float32)  # common words, each with a blank
        for k, s in enumerate(sets):
            for w in s:
                shared[where.get(w, []), k] += len(w) + 1
        one, two, both = left - shared, right - shared, np.maximum(shared - 1, 0)
        met = np.array([2 * len(s) + 1 for s in sets], np.float32)[None, :]
        rest = np.minimum(np.minimum(one, two), (pairs[0] + met + one + two) / 3)
        total = np.maximum(left + right, 1)
        words = np.maximum(200 * (shared + rest) / total, 200 * both / np.maximum(both + np.minimum(left, right), 1))
        words = np.where((shared > 0) & ((one < 0) | (two < 0)), 100, words)
        words[(right < 0)[:, 0]] = 0
        words[:, (left < 0)[0]] = 0
        words = words + np.float32(ROUNDING)
        return np.maximum(np.maximum(best[0], best[1]), words), words

    def best_two(self, words: str, bound: np.ndarray, by_words: np.ndarray, which: np.ndarray, floor: float | None = None, lead: float = 10.0, most: int | None = None) -> list[tuple[int, float]]:
        """Places and scores of the two best titles among the places ``which``, best bounds first until the others can't matter.

        The best score is exact.  The second is if it decides: where it may be less than ``lead`` behind or, with a ``floor``, reaches that;
        titles below the floor don't count then.  ``most``: stop after so many titles, so both are scores but maybe not the best ones.
        """
        if floor is not None:
            which = which[bound[which] >= floor]
        if most is not None and len(which) > most:
            which = which[np.argpartition(-bound[which], most - 1)[:most]]
        which = which[np.argsort(-bound[which], kind="stable")]
        top: list[tuple[float, int]] = []
        done, step = 0, 8
        while done < len(which):
            if len(top) == 2:
                (best, _), (second, _), next_ = *top, bound[which[done]]
                need = floor if floor is not None else best - lead
                if next_ < best and (second > need + 1e-9 or floor is not None or next_ < need - 1e-9):
                    break
            here = which[done : done + step]
            found = [(float(s), int(i)) for s, i in zip(self.scores(words, here, by_words[here]), here) if floor is None or s >= floor]
            top = sorted(top + found, key=lambda x: -x[0])[:2]
            done, step = done + step, step * 4
        return [(i, s) for s, i in top]


def word_scores(words: str, titles: list[str]) -> np.ndarray:
    return Titles(titles).scores(words)
