"""Maximal periodic runs of words, found by splitting texts at words that are too rare to repeat.

A run of period q and at least 2 q words holds each of its words again q places away. So a word that has no
equal at most half a segment away, inside that segment, is in no run of it: it splits the segment. Smaller
segments make more words too rare, so this is repeated until nothing changes. Only what survives is
scanned, lag by lag: places that agree with those q further on are found by prefix hashes of windows that
any run of that period must cover, and every run found is compared word by word.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .files import slices
from .kernels import blocks, is_word_byte, mix64, powers, runs_of

#: Rounds in which all segments are split together; what still changes then is split one by one.
ROUNDS = 24
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest earlier and later place of the same word (-1 and ``len(words)``: none)."""
    n = len(words)
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _split_one(start: int, end: int, before: np.ndarray, after: np.ndarray, least: int) -> list[tuple[int, int]]:
    """As :func:`segments` for one segment, looking for a rare word from both ends at once.

    The work on a segment is paid by the smaller of its two parts, so any segment takes n log n steps.
    """
    out, open_ = [], [(start, end)]
    while open_:
        s, e = open_.pop()
        if e - s < least:
            continue
        half = (e - s) // 2
        rare = lambda i: not (before[i] >= s and i - before[i] <= half or after[i] < e and after[i] - i <= half)  # noqa: B023, E731
        at = next((p for k in range((e - s + 1) // 2) for p in (s + k, e - 1 - k) if rare(p)), None)
        if at is None:
            out.append((s, e))
        else:
            open_ += [(s, at), (at + 1, e)]
    return out


def segments(starts: np.ndarray, ends: np.ndarray, before: np.ndarray, after: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of segments that are left once every word too rare in its own part has split it."""
    done = []
    for _ in range(ROUNDS):
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        sizes = ends - starts
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
        s, e, half = np.repeat(starts, sizes), np.repeat(ends, sizes), np.repeat(sizes // 2, sizes)
        b, a = before[place], after[place]
        common = (b >= s) & (place - b <= half) | (a < e) & (a - place <= half)
        cuts = np.add.reduceat(~common, offsets[:-1])
        done.append((starts[cuts == 0], ends[cuts == 0]))
        first, last = runs_of(common & np.repeat(cuts > 0, sizes), offsets)
        starts, ends = place[first], place[last - 1] + 1
    else:
        rest = [p for s, e in zip(starts.tolist(), ends.tolist(), strict=True) for p in _split_one(s, e, before, after, least)]
        done.append((np.array([p[0] for p in rest], np.int64), np.array([p[1] for p in rest], np.int64)))
    done = done or [(starts[:0], ends[:0])]
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


class _Equal:
    """How far places agree with those some lag further on, by prefix hashes and binary search.

    Equal words have equal hashes, so an extent is never too short; that it isn't too long is for the
    caller to compare.
    """

    def __init__(self, words: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            up, self.down = powers(len(words))
            codes = mix64(words.astype(np.uint64) + np.uint64(1)) * up[: len(words)]
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes)])

    def _hash(self, starts: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[starts + size] - self.sums[starts]) * self.down[starts]

    def at(self, places: np.ndarray, lag: int, size) -> np.ndarray:
        return self._hash(places, size) == self._hash(places + lag, size)

    def extent(self, places: np.ndarray, lag: int, most: np.ndarray, back: bool) -> np.ndarray:
        low, high = np.zeros(len(places), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.at(places - mid if back else places, lag, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def periodic_runs(words: np.ndarray, offsets: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of every maximal run, with its smallest period q, of max(least, 2 q) words or more.

    ``words`` are numbers that stand for words, of texts that begin and end at ``offsets``; runs don't
    cross from one into the next. In order of start, then period.

    A lag q costs the places of one window in each segment of at least 2 q words, so a segment of n words
    takes n log n steps. Places inside a run of a period that divides q are passed over: they repeat it.
    """
    before, after = neighbours(words)
    starts, ends = segments(offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64), before, after, least)
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that a lag's segments come first
    starts, ends = starts[order], ends[order]
    sizes, equal = ends - starts, _Equal(words)
    inside = np.full(len(words), -1, np.int32)  # of the runs over a place, the longest one found so far
    found: list[tuple[int, int, int]] = []
    periods: dict[tuple[int, int], list[int]] = defaultdict(list)
    run_end, run_size, run_period = np.zeros(64, np.int64), np.zeros(64, np.int64), np.ones(64, np.int64)
    for q in range(1, int(sizes[0]) // 2 + 1 if len(sizes) else 1):
        n = int(np.searchsorted(-sizes, -max(2 * q, least), "right"))
        window = (max(q, least - q) + 1) // 2  # any run's places of agreement cover one of these
        many = (sizes[:n] - q) // window
        which = np.repeat(np.arange(n), many)
        place = starts[which] + (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)) * window
        hit = equal.at(place, q, window)
        if not hit.any():
            continue
        place, which = place[hit], which[hit]
        run = inside[place]
        known = (run >= 0) & (run_end[run] >= place + window + q) & (q % run_period[run] == 0)
        place, which = place[~known], which[~known]
        if not len(place):
            continue
        first = place - equal.extent(place, q, place - starts[which], True)
        last = place + q + equal.extent(place, q, ends[which] - q - place, False)
        for s, e in sorted(set(zip(first.tolist(), last.tolist(), strict=True))):
            if e - s < max(least, 2 * q) or any(q % p == 0 for p in periods[s, e]):
                continue
            agree = words[s : e - q] == words[s + q : e]
            parts = [(s, e)]
            if not agree.all():  # hashes that were equal by chance
                begin, end = runs_of(agree, np.array([0, len(agree)]))
                parts = [(s + int(x), s + int(y) + q) for x, y in zip(begin, end, strict=True) if y - x + q >= max(least, 2 * q)]
            for x, y in parts:
                if any(q % p == 0 for p in periods[x, y]):
                    continue
                periods[x, y].append(q)
                if len(found) == len(run_end):
                    run_end, run_size, run_period = (np.concatenate([r, r]) for r in (run_end, run_size, run_period))
                run_end[len(found)], run_size[len(found)], run_period[len(found)] = y, y - x, q
                longest = inside[x:y]
                inside[x:y] = np.where((longest >= 0) & (run_size[longest] >= y - x), longest, len(found))
                found.append((x, y, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts as one array, and where each text's words begin and end in it."""
    kept = is_word_byte()[data]
    starts, ends = runs_of(kept, offsets)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    bytes_ = np.ascontiguousarray(data[kept])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(bytes_)])
    return words, np.searchsorted(starts, offsets)


def scan(texts: pa.Array, least: int) -> pa.StructArray:
    counts, runs, run_offsets, collapsed = [], [], [0], []
    for _, data, offsets in blocks(texts):
        words, at = words_of(data, offsets)
        numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int32)
        drop = np.zeros(len(words), bool)
        found = periodic_runs(numbers, at, least)
        of_text = np.searchsorted(at, [r[0] for r in found], "right") - 1 if found else []
        of_each: dict[int, list] = defaultdict(list)
        for (s, e, q), t in zip(found, of_text, strict=True):
            of_each[int(t)].append((s - int(at[t]), e - s, q))
            drop[s + q : e] = True
        kept = np.flatnonzero(~drop)
        lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(kept, at), pa.int64()), words.take(pa.array(kept)) if len(kept) < len(words) else words)
        collapsed.append(pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())))
        counts.append(np.diff(at))
        for t in range(len(at) - 1):
            runs += of_each.get(t, [])
            run_offsets.append(len(runs))
    flat = pa.StructArray.from_arrays([pa.array([r[k] for r in runs], pa.int64()) for k in range(3)], fields=list(RUN))
    n = pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())
    texts_out = pa.concat_arrays(collapsed).cast(pa.large_string()).cast(pa.string()) if collapsed else pa.array([], pa.string())
    return pa.StructArray.from_arrays([n, pa.ListArray.from_arrays(pa.array(run_offsets, pa.int32()), flat), texts_out], names=["n_words", "runs", "collapsed"])


def repeated_stretches(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, runs, collapsed``, over each whole text.

    Words are maximal runs of anything but ASCII white space. ``runs`` lists every stretch of words with
    smallest period q and at least ``max(least, 2 q)`` words that no neighbouring word extends, by start, then
    period; ``collapsed`` joins by single spaces the words that no run contains after its first q.

    Null and empty texts have no words, no runs and an empty ``collapsed``; repeated rows give equal
    rows; an empty table gives no rows; null ids stay. Other columns are not read. Nothing is shuffled. A
    batch is worked through in blocks of half a MB, a longer text is a block of its own: of each word
    its bytes and some ten numbers are held.
    """

    def stretches(batches):
        for batch in slices(batches):
            found = scan(batch.column("text"), least)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found.flatten()], names=["doc_id", *(f.name for f in found.type)])

    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(stretches, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {RESULT}")
