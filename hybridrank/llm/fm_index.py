"""A bidirectional FM-index over delimited words and the search for all words one error away.

The text is every word with a delimiter before it, read as a circle. A wavelet matrix of its last column
(and of that of the reversed text) gives the interval of suffix ranks of a pattern that is made longer
by one symbol at its left (or right), for many patterns at once, together with how many symbols below
that one the interval holds; that keeps the other direction's interval in step.
"""

from __future__ import annotations

import numpy as np

DELIMITER = 0


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Places of a circular text in order of what follows them, by doubling the compared length.

    Words of one index differ, so places are told apart within about two words.
    """
    rank, size, n = text.astype(np.int64), 1, len(text)
    while True:
        key = rank * (n + 2) + np.roll(rank, -size)
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1 or size >= n:
            return order
        size *= 2


class _Column:
    """A wavelet matrix of the last column: counts of a symbol, and of those below it, in intervals."""

    def __init__(self, last: np.ndarray, bits: int) -> None:
        self.bits, self.zeros, self.start_of_ones = bits, [], []
        for b in range(bits - 1, -1, -1):
            one = (last >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            self.start_of_ones.append(int((~one).sum()))
            last = np.concatenate([last[~one], last[one]])
        symbols = np.arange(1 << bits)
        self.base = self._trace(symbols, np.zeros(1 << bits, np.int64))

    def _trace(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            z = self.zeros[level][at].astype(np.int64)
            at = np.where(symbol >> (self.bits - 1 - level) & 1, self.start_of_ones[level] + at - z, z)
        return at

    def narrowed(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """How many ``symbol`` stand before ``low`` and before ``high``, and how many smaller ones between."""
        smaller = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            z_low, z_high = self.zeros[level][low].astype(np.int64), self.zeros[level][high].astype(np.int64)
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            smaller += np.where(one, z_high - z_low, 0)
            ones = self.start_of_ones[level]
            low, high = np.where(one, ones + low - z_low, z_low), np.where(one, ones + high - z_high, z_high)
        return low - self.base[symbol], high - self.base[symbol], smaller

    def symbols(self, low: np.ndarray, high: np.ndarray):
        """Every symbol in each interval: which interval, the symbol, its counts before, and smaller ones between."""
        which, symbol, smaller = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for level in range(self.bits):
            z_low, z_high = self.zeros[level][low].astype(np.int64), self.zeros[level][high].astype(np.int64)
            ones = self.start_of_ones[level]
            some0, some1 = z_high > z_low, high - z_high > low - z_low
            which = np.concatenate([which[some0], which[some1]])
            symbol = np.concatenate([symbol[some0] << 1, symbol[some1] << 1 | 1])
            smaller = np.concatenate([smaller[some0], (smaller + z_high - z_low)[some1]])
            low, high = np.concatenate([z_low[some0], (ones + low - z_low)[some1]]), np.concatenate([z_high[some0], (ones + high - z_high)[some1]])
        return which, symbol, low - self.base[symbol], high - self.base[symbol], smaller


class States:
    """Patterns in progress: the query, how many of its symbols are used, both intervals."""

    def __init__(self, query, low, other, size) -> None:
        self.query, self.low, self.other, self.size = query, low, other, size

    def pick(self, which) -> States:
        return States(self.query[which], self.low[which], self.other[which], self.size[which])

    @staticmethod
    def joined(parts: list[States]) -> States:
        return States(*[np.concatenate([getattr(p, k) for p in parts]) for k in ("query", "low", "other", "size")])


class BidirectionalIndex:
    """The index of distinct words (arrays of code points, none empty), in the order given."""

    def __init__(self, words: list[np.ndarray]) -> None:
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate(words) if words else np.zeros(0, np.int64)
        self.alphabet = np.unique(flat)
        symbols = np.searchsorted(self.alphabet, flat) + 1
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        text = np.zeros(int(sizes.sum()) + len(words), np.int64)
        inside = np.ones(len(text), bool)
        inside[starts] = False
        text[inside] = symbols
        bits = max(1, int(len(self.alphabet)).bit_length())
        self.rank_to_place = suffix_ranks(text)
        backward = text[::-1]
        self.columns = [_Column(text[self.rank_to_place - 1], bits), _Column(backward[suffix_ranks(backward) - 1], bits)]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        self.word_at = np.full(len(text), -1, np.int64)
        self.word_at[starts] = np.arange(len(words))
        self.n = len(text)

    def symbols_of(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; one that no indexed word has gives -1."""
        at = np.searchsorted(self.alphabet, points)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == points[known]
        return np.where(known, at + 1, -1)

    def all(self, queries: np.ndarray) -> States:
        zero = np.zeros(len(queries), np.int64)
        return States(queries, zero, zero.copy(), np.full(len(queries), self.n, np.int64))

    def extend(self, states: States, symbol: np.ndarray, right: bool) -> States:
        """Each pattern with its symbol at the left (or right) end; patterns that don't occur fall away."""
        own, other = (states.other, states.low) if right else (states.low, states.other)
        some = symbol >= 0
        low, high, smaller = self.columns[right].narrowed(np.maximum(symbol, 0), own, own + states.size)
        some &= high > low
        own, other, size = self.before[np.maximum(symbol, 0)] + low, other + smaller, high - low
        return (States(states.query, other, own, size) if right else States(states.query, own, other, size)).pick(some)

    def extend_by_any(self, states: States, right: bool) -> tuple[States, np.ndarray]:
        """Each pattern with every symbol that occurs at its left (or right) end, but the delimiter."""
        own, other = (states.other, states.low) if right else (states.low, states.other)
        which, symbol, low, high, smaller = self.columns[right].symbols(own, own + states.size)
        word = symbol != DELIMITER
        which, symbol = which[word], symbol[word]
        own, other, size = self.before[symbol] + low[word], other[which] + smaller[word], (high - low)[word]
        return (States(states.query[which], other, own, size) if right else States(states.query[which], own, other, size)), symbol

    def words(self, states: States) -> np.ndarray:
        """The words of patterns that begin and end with a delimiter."""
        return self.word_at[self.rank_to_place[states.low]]


def one_error(index: BidirectionalIndex, queries: list[np.ndarray], first: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(query, word)`` for words made from a query by replacing, or adding, one symbol in one of its halves.

    ``first``: the first half (n // 2 symbols) matches exactly, up to its delimiter at the left, and the
    second is followed to the right with the one error; else the other way round. An added symbol never
    equals the one that would be used next, so that each word is found in one way only.
    """
    sizes = np.array([len(q) for q in queries], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    symbols = index.symbols_of(np.concatenate(queries) if queries else np.zeros(0, np.int64))
    half = sizes // 2
    exact, rest = (half, sizes - half) if first else (sizes - half, half)

    def symbol(states: States, used: np.ndarray | int, exact_part: bool) -> np.ndarray:
        """The next symbol of each state; the exact half goes outwards from the middle as well."""
        q = states.query
        at = half[q] - 1 - used if first == exact_part else half[q] + used
        return symbols[offsets[q] + at]

    matched = []
    states = index.all(np.arange(len(queries)))
    for used in range(int(exact.max(initial=0)) + 1):
        ended = exact[states.query] == used
        matched.append(index.extend(states.pick(ended), np.full(int(ended.sum()), DELIMITER), right=not first))
        states = states.pick(~ended)
        states = index.extend(states, symbol(states, used, True), right=not first)
    exact_yet, wrong, out = States.joined(matched), index.all(np.zeros(0, np.int64)), []
    for used in range(int(rest.max(initial=0)) + 1):
        ended = rest[wrong.query] == used
        out.append(index.extend(wrong.pick(ended), np.full(int(ended.sum()), DELIMITER), right=first))
        wrong = wrong.pick(~ended)
        wrong = index.extend(wrong, symbol(wrong, used, False), right=first)  # has used one symbol more
        branched, new = index.extend_by_any(exact_yet, right=first)
        ended = rest[branched.query] == used
        out.append(index.extend(branched.pick(ended), np.full(int(ended.sum()), DELIMITER), right=first))  # added at the end
        branched, new = branched.pick(~ended), new[~ended]
        expected = symbol(branched, used, False)
        other = new != expected
        branched, expected = branched.pick(other), expected[other]
        wrong = States.joined([wrong, branched, index.extend(branched, expected, right=first)])  # replaced; added before it
        exact_yet = exact_yet.pick(rest[exact_yet.query] > used)
        exact_yet = index.extend(exact_yet, symbol(exact_yet, used, False), right=first)
    found = States.joined(out)
    return found.query, index.words(found)
