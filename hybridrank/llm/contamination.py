"""Benchmark passages in documents, found with a suffix automaton of the benchmark's words.

The automaton accepts every run of words of every item. A document's words stream through it once; at
each word the state and the matched length are those of the longest run of item words that ends there.
Where that length reaches a window, the window's words are hit.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, whole_rows, written

#: Item words in one automaton at most (about 130 MB in a process); more items are taken in several rounds.
AUTOMATON_WORDS = 200_000
RESULT = "n_words long, hits binary, items array<string>, cleaned string"


def _table() -> bytes:
    """A-Z to a-z; all ASCII but letters and digits to a space."""
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 0x20 for b in range(256))


TABLE = _table()


def words(text: str | bytes) -> list[bytes]:
    return (text.encode("utf-8") if isinstance(text, str) else text).translate(TABLE).split()


class Automaton:
    """Generalised suffix automaton over words.

    ``ends[s]``: shortest matched length at state ``s`` that completes a window, 0 if none does.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        for _, text in items:
            last = 0
            for w in text:
                last = self._extend(last, w)
        self.long: dict[int, set[str]] = {}  # items by state of a full window
        self.short: dict[int, dict[int, set[str]]] = {}  # whole short items, by state and length
        for item, text in items:
            state = 0
            for k, w in enumerate(text):
                state = self.next[state][w]
                if k + 1 >= window:
                    while self.length[self.link[state]] >= window:
                        state = self.link[state]
                    self.long.setdefault(state, set()).add(item)
            if 0 < len(text) < window:
                while self.length[self.link[state]] >= len(text):
                    state = self.link[state]
                self.short.setdefault(state, {}).setdefault(len(text), set()).add(item)
        self.ends = [0] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            own = [self.ends[self.link[s]]] if self.link[s] >= 0 else []
            own += [*self.short.get(s, ())] + [window] * (self.length[s] >= window)
            self.ends[s] = min((x for x in own if x), default=0)

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another item has been here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def items_at(self, state: int, matched: int) -> tuple[int, set[str]]:
        """Of the windows that end here: the longest's length, and the items."""
        longest, items = 0, set()
        while state > 0:
            below = self.length[self.link[state]]
            if matched >= self.window > below:
                longest = max(longest, self.window)
                items |= self.long.get(state, set())
            for n, own in self.short.get(state, {}).items():
                if n <= matched:
                    longest = max(longest, n)
                    items |= own
            state, matched = self.link[state], below
        return longest, items

    def scan(self, text: list[bytes]) -> tuple[bytearray | None, set[str]]:
        """A mark for each word (none, if nothing is hit) and the items whose windows occur."""
        follow, link, length, ends = self.next, self.link, self.length, self.ends
        marks, items, state, matched, seen = None, set(), 0, 0, {}
        for i, w in enumerate(text):
            to = follow[state].get(w)
            if to is None:
                if not state:
                    continue
                state = link[state]
                while state > 0 and w not in follow[state]:
                    state = link[state]
                to = follow[state].get(w)
                if to is None:
                    state = matched = 0
                    continue
                matched = length[state]
            state, matched = to, matched + 1
            if ends[state] and matched >= ends[state]:
                key = (state, min(matched, self.window))
                if key not in seen:
                    seen[key] = self.items_at(state, matched)
                n, own = seen[key]
                items |= own
                marks = marks if marks is not None else bytearray(len(text))
                marks[i + 1 - n : i + 1] = b"\x01" * n
        return marks, items


def without_hits(text: bytes, marks: bytes) -> str:
    """The text without each run of hit words (from its first word's first byte to its last word's last)."""
    out, at = [], 0
    for word, hit in zip(re.finditer(rb"[^ ]+", text.translate(TABLE)), marks, strict=True):
        if hit:
            out.append(text[at : word.start()] if not out or not inside else b"")
            at, inside = word.end(), True
        else:
            inside = False
    return b"".join([*out, text[at:]]).decode("utf-8")


def scanner(spark, automaton: Automaton):
    """A column function from text to ``RESULT``; the automaton's size is bounded by ``AUTOMATON_WORDS``."""
    sent = spark.sparkContext.broadcast(vars(automaton))  # plain values: workers need no copy of this package to read them

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        own, out = Automaton.__new__(Automaton), []
        own.__dict__ = sent.value
        for text in texts.cast(pa.binary()).to_pylist():
            split = words(text)
            marks, items = own.scan(split)
            out.append((len(split), bytes(marks) if marks is not None else None, sorted(items), without_hits(text, marks) if marks is not None else None))
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.string()), pa.string()]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["n_words", "hits", "items", "cleaned"])

    once = scan.asNondeterministic()  # else a filter on its result would scan the text a second time
    return lambda column: once(F.coalesce(column.cast("string"), F.lit("")))


def automata(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", most: int = AUTOMATON_WORDS):
    """Automata that together hold all items, each of about ``most`` words; built one after the other. Repeated rows count once."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), text_or_empty(text_col).alias("text")).distinct()
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    rounds = max(1, -(-total // most))
    for k in range(rounds):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(rounds)) == k)
        rows = sorted(((i if i is not None else "null"), t) for i, t in part.collect())
        yield Automaton([(i, words(t)) for i, t in rows], window)




def _found(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """``docs`` with ``__r``: the scan's result over all automata, one after the other."""
    spark = docs.sparkSession

    @F.arrow_udf(RESULT)
    def union(texts: pa.Array, *results: pa.Array) -> pa.Array:
        rows = []
        for text, *rs in zip(texts.cast(pa.binary()).to_pylist(), *(r.to_pylist() for r in results), strict=True):
            hit = [r["hits"] for r in rs if r["hits"] is not None]
            marks = bytes(map(max, zip(*hit, strict=True))) if len(hit) > 1 else hit[0] if hit else None
            rows.append({"n_words": rs[0]["n_words"], "hits": marks, "items": sorted({i for r in rs for i in r["items"]}), "cleaned": without_hits(text, marks) if marks is not None else None})
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("cleaned", pa.string())]))

    out = None
    for automaton in automata(benchmark, window, item_col, item_text_col):
        scan = scanner(spark, automaton)(F.col(text_col))
        if out is None:
            out = docs.withColumn("__r", scan)
            continue
        # written between rounds, so that no task holds more than one automaton
        out = written(out, "window-hits").withColumn("__next", scan)
        out = out.withColumn("__r", union(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "__r", "__next")).drop("__next")
    return out


def _columns(window_share: int) -> dict:
    n_hit = F.coalesce(F.length(F.regexp_replace(F.hex("__r.hits"), "0", "")), F.lit(0)).cast("long")
    return {"__n_hit": n_hit, "__contaminated": (n_hit > 0) & (n_hit * window_share >= F.col("__r.n_words"))}


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, items, n_items, items_sha256, contaminated, cleaned``.

    Words are letters, digits and non-ASCII characters after A-Z were lower-cased. A window is
    ``window`` words of an item, or the whole of a shorter one. Words inside any occurrence of a window
    are hit; a document is contaminated when hit words are at least one in ``share`` of its words.
    ``cleaned`` is the text without its hit runs, null where nothing is hit. Null and empty texts have no
    words; items without words match nothing; items that share an id count once, a null id as ``null``;
    repeated rows get equal results; an empty table gives no rows. Other columns are not read.

    Documents are not shuffled. An automaton holds a bounded number of item words; a benchmark
    of more is scanned in several passes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _found(rows, benchmark, window, "text", item_col, item_text_col).withColumns(_columns(share))
    joined = F.array_join(F.array_sort("__r.items"), ",")
    return found.select(
        "doc_id", F.col("__r.n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.col("__r.items").alias("items"),
        F.size("__r.items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"),
        F.col("__contaminated").alias("contaminated"), F.col("__r.cleaned").alias("cleaned"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows. Of the others' texts each run of hit words is cut out; all else is as it was."""
    rows = docs.select(whole_rows(docs), F.col(text_col).cast("string").alias("text"))
    found = _found(rows, benchmark, window, "text", item_col, item_text_col).withColumns(_columns(share)).filter(~F.col("__contaminated"))
    text = F.coalesce(F.col("__r.cleaned"), F.col(f"row.`{text_col}`")).alias(text_col)
    return found.select(*[text if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
