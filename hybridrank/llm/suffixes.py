"""Removal of long byte strings that occur earlier, with a suffix sort that compares by hashes.

Sorting every suffix of a corpus is not needed to find the strings of ``length`` bytes that repeat. Every
such string holds an anchor: of its ``GRAM``-byte substrings the one with the least hash. Equal strings
have equal anchors at equal places, so a document's strings fall into runs with one anchor each, and
strings can only be equal if their anchors are.

1. Runs are keyed by their anchors' bytes; a run whose key occurs once anywhere is done.
2. Runs that agree from end to end are one; the earliest stands for all.
3. Runs with one key that differ are resolved by a suffix sort: all their suffixes of ``length`` bytes or
   more, grouped by key and place of the anchor, are merge-sorted. Two suffixes are compared by
   finding their common extension by binary search over prefix polynomial hashes, then one byte.
   Neighbours that agree in ``length`` bytes are held against each other byte by byte.
4. Of each string the earliest place stays; every other place in a run of a repeated key goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, id_or_last, id_or_null, partitions, text_or_empty, written
from .files import slices
from .kernels import PrefixHash, blocks, byte_codes, mix64, powers

#: Bytes of an anchor; bits of a packed place for the count of a run's strings and the anchor's offset.
GRAM, SMALL = 36, 7
#: Bits for a string's start.
START = 31
#: A text is anchored in pieces of so many bytes; suffix-sorted at once are about so many bytes.
PIECE, CHUNK = 1 << 22, 1 << 20
#: Runs of one key, all different, beyond which their strings are dealt out one by one.
CROWD = 4096


def pack(start, count, offset):
    return (start << (2 * SMALL)) | (count << SMALL) | offset


class Anchors:
    """Runs of strings that share an anchor."""

    def __init__(self, length: int) -> None:
        self.length, self.window = length, length - GRAM + 1
        self.codes = byte_codes()
        self.up, self.down = powers(1 << 20)

    def of(self, data: np.ndarray, offsets: np.ndarray):
        """For each run: text, first start in ``data``, number of strings, anchor's offset, key, hash of the whole run."""
        length, n = self.length, len(data)
        empty = np.zeros(0, np.int64)
        if n < length:
            return empty, empty, empty, empty, empty, empty
        if n >= len(self.up):
            self.up, self.down = powers(2 * n)
        with np.errstate(over="ignore"):
            hashes = PrefixHash(data, self.codes, self.up, self.down)
            grams = mix64((hashes.sums[GRAM:] - hashes.sums[:-GRAM]) * self.down[: n + 1 - GRAM])
            low = np.uint64((1 << 24) - 1)
            least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
            covered = 1
            while covered < self.window:
                step = min(covered, self.window - covered)
                least = np.minimum(least[:-step], least[step:])
                covered += step
            sizes = np.diff(offsets)
            many = np.maximum(sizes - (length - 1), 0)
            ends = np.cumsum(many)
            if not len(ends) or not ends[-1]:
                return empty, empty, empty, empty, empty, empty
            starts = np.repeat(offsets[:-1] - (ends - many), many) + np.arange(ends[-1])
            at = (least[starts] & low).astype(np.int64)
            new = np.ones(len(starts), bool)
            new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(starts)))
            begin, anchor = starts[first], at[first]
            run = mix64(hashes.of(begin, begin + count + (length - 1)) + count.astype(np.uint64))
            text = np.searchsorted(ends, first, "right")
        return text, begin - offsets[text], count, anchor - begin, grams[anchor].view(np.int64), run.view(np.int64)


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """A block as it is, or a very long text in overlapping pieces: where it begins, bytes, offsets."""
    if len(offsets) > 2 or len(data) <= PIECE + length:
        yield 0, data, offsets
        return
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE + length - 1]
        yield at, piece, np.array([0, len(piece)])


RUNS = "key long, run long, doc long, twin long, place long"


def _runs(length: int):
    def find(batches):
        kernel, seen = Anchors(length), {}
        for batch in slices(batches, 4096):
            doc, twin = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "twin"))
            keep = []
            for k, (d, sha, n) in enumerate(zip(doc.tolist(), batch.column("sha").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                # a copy adds nothing to an earlier one that this task has already told of
                if n >= length and seen.get(sha, NO_ID + 1) > d:
                    seen[sha] = d
                    keep.append(k)
            if len(seen) > 1 << 20:
                seen.clear()
            if not keep:
                continue
            doc, twin = doc[keep], twin[keep]
            for row, data, offsets in blocks(batch.column("text").take(pa.array(keep))):
                for base, piece, ends in _pieces(data, offsets, length):
                    text, begin, count, offset, key, run = kernel.of(piece, ends)
                    columns = [key, run, doc[row + text], twin[row + text], pack(begin + base, count, offset)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in RUNS.split(", ")])

    return find


class SuffixSort:
    """Sorts suffixes of ``data`` by their first ``length`` bytes, within groups."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        self.data, self.length = data, length
        with np.errstate(over="ignore"):
            up, down = powers(len(data))
            self.hash = PrefixHash(data, byte_codes(), up, down)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` have in common, ``length`` at most, by their hashes."""
        common = np.zeros(len(a), np.int64)
        with np.errstate(over="ignore"):
            for bit in range(self.length.bit_length() - 1, -1, -1):
                longer = common + (1 << bit)
                fits = np.minimum(longer, self.length)
                same = self.hash.of(a + common, a + fits) == self.hash.of(b + common, b + fits)
                common = np.where(same & (longer <= self.length), longer, common)
        return common

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at ``a`` sorts before that at ``b``; ``ties`` where both are equal."""
        common = self.extension(a, b)
        at = np.minimum(common, self.length - 1)
        return np.where(common == self.length, ties, self.data[a + at] < self.data[b + at])

    def sort(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of ``places`` by group, then suffix: merges of ever longer runs, all groups at once.

        An item's place in a merge is its place in its own run plus the number of items of the other
        run that go before it, found by binary search.
        """
        order = np.argsort(group, kind="stable")
        ordered = group[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(order)))
        start, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        width = 1
        while len(sizes) and width < sizes.max():
            at = np.flatnonzero(size > width)
            local = at - start[at]
            left = (local // width) % 2 == 0
            pair = local // (2 * width) * (2 * width)
            low = np.minimum(np.where(left, pair + width, pair), size[at])
            high = np.minimum(np.where(left, pair + 2 * width, pair + width), size[at])
            own, base = places[order[at]], low
            lo, hi = low.copy(), high
            while True:
                busy = np.flatnonzero(lo < hi)
                if not len(busy):
                    break
                middle = (lo[busy] + hi[busy]) // 2
                other = places[order[start[at[busy]] + middle]]
                goes = self.before(other, own[busy], ~left[busy])
                lo[busy] = np.where(goes, middle + 1, lo[busy])
                hi[busy] = np.where(goes, hi[busy], middle)
            to = start[at] + pair + local % width + (lo - base)
            merged = order.copy()
            merged[to] = order[at]
            order, width = merged, 2 * width
        return order

    def classes(self, places: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``places``' order, and a class number for each in it: equal in group and first ``length`` bytes."""
        order = self.sort(places, group)
        new = np.ones(len(order), bool)
        strings = np.lib.stride_tricks.sliding_window_view(self.data, self.length) if len(order) else None
        ordered = group[order]
        for at in range(0, len(order) - 1, 1 << 14):
            k = np.arange(at, min(at + (1 << 14), len(order) - 1))
            near = strings[places[order[at : k[-1] + 2]]]
            differs = near[:-1] != near[1:]
            where, rows = differs.argmax(1), np.arange(len(k))
            unequal = differs[rows, where]
            same_group = ordered[k] == ordered[k + 1]
            if (same_group & unequal & (near[rows, where] > near[rows + 1, where])).any():  # a collision of hashes has misled the sort
                return self._by_bytes(places, group)
            new[k + 1] = unequal | ~same_group
        return order, np.cumsum(new)

    def _by_bytes(self, places: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = self.data.tobytes()
        keys = [(g, raw[p : p + self.length]) for g, p in zip(group.tolist(), places.tolist(), strict=True)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        new = [True] + [keys[a] != keys[b] for a, b in zip(order, order[1:])]  # noqa: B905
        return np.array(order, np.int64), np.cumsum(new[: len(order)])


def earliest(keys: np.ndarray, docs: np.ndarray, twins: np.ndarray, places: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings in runs (``texts``) with equal keys: each different one's earliest place, as runs of (doc, twin, place)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    count = sizes - (length - 1)
    ends = np.cumsum(count)
    run = np.repeat(np.arange(len(texts)), count)
    inner = np.arange(ends[-1]) - (ends - count)[run]
    offset = (places[run] & ((1 << SMALL) - 1)) - inner
    _, group = np.unique(keys, return_inverse=True)
    order, cls = SuffixSort(data, length).classes((np.cumsum(sizes) - sizes)[run] + inner, group[run] * (1 << SMALL) + offset)
    first_place = pack((places >> (2 * SMALL))[run] + inner, 0, 0)
    owner, twin, where = docs[run][order], twins[run][order], first_place[order]
    by = np.lexsort((where, twin, owner, cls))
    firsts = by[np.append(True, cls[by][1:] != cls[by][:-1])]
    owner, twin, where = owner[firsts], twin[firsts], where[firsts]
    by = np.lexsort((where, twin, owner))
    owner, twin, where = owner[by], twin[by], where[by]
    new = np.ones(len(by), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (twin[1:] != twin[:-1]) | (where[1:] != where[:-1] + (1 << (2 * SMALL)))
    # a merged run may be longer than the packed count can tell
    index = np.arange(len(by))
    new |= (index - np.maximum.accumulate(np.where(new, index, 0))) % ((1 << SMALL) - 1) == 0
    at = np.flatnonzero(new)
    return owner[at], twin[at], where[at] | (np.diff(np.append(at, len(by))) << SMALL)


def _resolve(length: int):
    """Rows (key, doc, twin, place, data) sorted by key to earliest places (doc, twin, place), some whole keys at a time."""

    def flush(rows):
        keys, docs, twins, places, texts = zip(*rows, strict=True)
        found = earliest(np.array(keys), np.array(docs), np.array(twins), np.array(places), list(texts), length)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["doc", "twin", "place"])

    def resolve(batches):
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "twin", "place", "data")), strict=True):
                if held >= CHUNK and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield flush(rows)

    return resolve


def _cut(length: int):
    """Texts with lists of runs to the runs' bytes; strings of crowded keys one by one."""

    def cut(batches):
        for batch in slices(batches, 256):
            out = []
            for doc, twin, text, runs in zip(batch.column("doc").to_pylist(), batch.column("twin").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                for r in runs:
                    place = r["place"]
                    start, count = (place >> (2 * SMALL)) & ((1 << START) - 1), (place >> SMALL) & ((1 << SMALL) - 1)
                    if not r["crowded"]:
                        out.append((r["key"], doc, twin, place, text[start : start + count + length - 1], False))
                        continue
                    out += [(r["key"], doc, twin, pack(s, 1, 0), text[s : s + length], True) for s in range(start, start + count)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "doc", "twin", "place", "data", "crowded"])

    return cut


def _remove(length: int, with_text: bool):
    """Texts with their runs (and, negated, their earliest places) to what is left of them."""

    def remove(batches):
        for batch in slices(batches, 256):
            out = []
            for doc, twin, text, marks in zip(batch.column("doc").to_pylist(), batch.column("twin").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("marks").to_pylist(), strict=True):
                n = len(text)
                marks = np.array(marks, np.int64)
                places = np.where(marks < 0, ~marks, marks)
                start, count = (places >> (2 * SMALL)) & ((1 << START) - 1), (places >> SMALL) & ((1 << SMALL) - 1)
                change = np.zeros(n + 1, np.int64)
                sign = np.where(marks < 0, -1, 1)
                np.add.at(change, start, sign)
                np.add.at(change, start + count, -sign)
                later = np.flatnonzero(np.cumsum(change)[:-1] > 0)
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, later, 1)
                np.add.at(cover, later + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
                left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((doc, twin, int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "twin", "n_removed", "n_spans", "kept_sha256", "kept"])

    return remove


def repeated_strings(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes that stay).

    Removed is every byte inside a string of ``length`` bytes that also starts earlier: in a document with
    a smaller id, or before it in the same one; strings are judged on the input. A null text counts as
    empty, a null id as larger than all. Rows that repeat id and text are one document and get its
    result; texts that share an id are ordered by a 64-bit hash of the text. Texts shorter than ``length`` stay as they
    are; an empty table gives no rows. Other columns are not read. ``length`` is 64 to 120.

    Nothing is gathered on the driver, and no key's rows are gathered in a task beyond ``CROWD``: counts
    per key and the earliest of equal runs are aggregated before they move, the join that brings the
    counts back can split a key that a third of all documents share.
    """
    spark = docs.sparkSession
    if not GRAM + 28 <= length <= 120:
        raise ValueError("length must be 64 to 120")
    rows = docs.select(id_or_last(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumns({"twin": F.xxhash64("text"), "sha": F.sha2("text", 256), "n": F.octet_length("text").cast("long")})

    runs = rows.mapInArrow(_runs(length), RUNS)
    # written, so that both sides of the join come from exchanges that can be split where a key is frequent
    repeated = written(runs.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key"), "run-keys")
    places = written(runs.join(repeated, "key"), "runs")

    one_of = F.min(F.struct("doc", "twin", "place")).alias("first")
    different = places.groupBy("key", "run").agg(one_of)
    different = written(different, "run-firsts")
    kinds = written(different.groupBy("key").agg(F.count("*").alias("kinds")), "run-counts")
    judged = written(different.join(kinds, "key").select("key", "kinds", "first.doc", "first.twin", "first.place"), "run-kinds")
    plain = judged.filter("kinds = 1").select("doc", "twin", "place")

    texts = rows.select("doc", "twin", "text")
    wanted = judged.filter("kinds > 1").groupBy("doc", "twin").agg(F.collect_list(F.struct("key", "place", (F.col("kinds") > CROWD).alias("crowded"))).alias("runs"))
    strings = written(
        texts.join(wanted, ["doc", "twin"]).mapInArrow(_cut(length), "key long, doc long, twin long, place long, data binary, crowded boolean"),
        "run-strings",
    )
    grouped = strings.filter("not crowded").repartition(partitions(spark), "key").sortWithinPartitions("key")
    sorted_out = grouped.select("key", "doc", "twin", "place", "data").mapInArrow(_resolve(length), "doc long, twin long, place long")
    crowded = strings.filter("crowded").groupBy("data").agg(one_of).select("first.doc", "first.twin", "first.place")

    stays = plain.unionByName(sorted_out).unionByName(crowded).select("doc", "twin", (-F.col("place") - 1).alias("mark"))
    marks = places.select("doc", "twin", F.col("place").alias("mark")).unionByName(stays)
    marks = marks.groupBy("doc", "twin").agg(F.collect_set("mark").alias("marks"))
    result = "doc long, twin long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    changed = written(texts.join(marks, ["doc", "twin"]).mapInArrow(_remove(length, with_text), result).dropDuplicates(["doc", "twin"]), "string-removals")

    copies = rows.select("doc", "twin", "sha", "n")
    firsts = copies.filter(F.col("n") >= length).groupBy("sha").agg(F.min("doc").alias("first_doc"), F.count("*").alias("copies")).filter("copies > 1")
    firsts = written(firsts, "copies")
    every = copies.join(firsts, "sha", "left").join(changed, ["doc", "twin"], "left")
    copy = F.coalesce(F.col("first_doc") < F.col("doc"), F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    out = every.select(
        id_or_null(F.col("doc")).alias("doc_id"), F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    return out
