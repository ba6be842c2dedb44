"""Spelling variants: words of a corpus grouped under the frequent word they are one error away from.

Of two words one error apart, one half of the shorter is whole at the start or the end of the other.
So words are dealt to blocks by their halves, each block gets a bidirectional FM-index of its words, and each
query matches a half exactly and follows the other with one error (see ``fm_index``). Halves that many words
share are split into squares of index words and queries, so no block grows with the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .files import slices
from .fm_index import BidirectionalIndex, one_error

#: Entries of a block, about; a half that more entries share is split.
BLOCK = 8192
#: Words whose counts a task holds before it passes them on.
HELD = 1 << 18
PAIRS = "word string, n long, near string, near_n long"


def counted_words(docs: DataFrame, least_length: int = 6, typo_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: how often each word of ``least_length`` code points or more occurs in all texts.

    Words are maximal runs of ``A-Z a-z U+00C0-U+00FF``, A-Z made small. With ``typo_every``, a run loses its
    letter number h % length when that divides h, the checksum (crc32) of ``id:run``; what is left counts.
    Null and empty texts have no words; every row counts, repeated ones too; a null id is written as
    nothing; an empty table gives no rows.
    """
    run = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def count(batches):
        held: Counter = Counter()

        def passed_on():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in slices(batches):
            texts = batch.column("text").cast(pa.large_binary())
            for key, text in zip(batch.column("id").to_pylist(), texts, strict=True):
                own = Counter(run.findall(text.as_py().lower().decode("utf-8")))  # bytes: A-Z only
                if typo_every:
                    start = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for word, n in own.items():
                        h = zlib.crc32(word.encode("utf-8"), start)
                        if h % typo_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least_length:
                            held[word] += n
                else:
                    held.update(own)
                if len(held) >= HELD:
                    yield passed_on()
        yield passed_on()

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cells(vocabulary: DataFrame, least_length: int, share: int) -> DataFrame:
    """``(word, n, side, cell, indexed, query)``: the blocks' rows. Side 0 are first halves, 1 second ones.

    Every word of m symbols asks for words that begin with its first m // 2 symbols, or end with the others,
    and is to be found under its own halves and those of words that are one symbol shorter.
    """
    m, word = F.char_length("word"), F.col("word")
    half = lambda size: F.floor(size / 2).cast("int")
    entry = lambda side, part, query: F.struct(F.lit(side).alias("side"), part.alias("half"), F.lit(query).alias("query"))
    own = [entry(0, F.left(word, half(m)), True), entry(1, F.right(word, m - half(m)), True)]
    shorter = F.when(m % 2 == 0, entry(0, F.left(word, half(m) - 1), False)).otherwise(entry(1, F.right(word, half(m)), False))
    entries = vocabulary.select("word", "n", F.inline(F.when(m > least_length, F.array(*own, shorter)).otherwise(F.array(*own))))
    crowded = entries.groupBy("side", "half").agg(F.count("*").alias("entries")).filter(F.col("entries") > share)
    crowded = crowded.select("side", "half", F.ceil(F.col("entries") / share).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    row = lambda i, j, indexed, query: F.struct(F.xxhash64("side", "half", i, j).alias("cell"), F.lit(indexed).alias("indexed"), query.alias("query"))
    other = F.col("other")
    dealt = F.when(F.col("parts") == 1, F.array(row(part, part, True, F.col("query")))).otherwise(
        F.array(row(part, other, True, F.lit(False)), row(other, part, False, F.col("query")))
    )
    split = entries.join(crowded, ["side", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return split.select("word", "n", "side", F.inline(dealt)).filter("indexed or query")


def near_words(vocabulary: DataFrame, least_length: int = 6, share: int = BLOCK) -> DataFrame:
    """``(word, n, near, near_n)``: all ordered pairs of distinct words one inserted, deleted or replaced code point apart.

    ``vocabulary(word, n)`` has each word once, of ``least_length`` >= 2 code points or more.
    """
    blocks = max(1, -(-3 * vocabulary.count() // share))
    cells = _cells(vocabulary, least_length, share).withColumn("block", F.pmod("cell", F.lit(blocks)).cast("int"))

    def search(table: pa.Table) -> pa.Table:
        coded = table.column("word").combine_chunks().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        count = np.zeros(len(words), np.int64)
        count[at] = table.column("n").to_numpy()
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64) for w in words]
        sizes = np.array([len(p) for p in points])
        side, asked = table.column("side").to_numpy(), table.column("query").to_numpy()
        indexed = np.unique(at[table.column("indexed").to_numpy()])
        pairs = [np.zeros((0, 2), np.int64)]
        if len(indexed):
            index = BidirectionalIndex([points[i] for i in indexed])
            for half in (0, 1):
                queries = np.unique(at[asked & (side == half)])
                if len(queries):
                    q, w = one_error(index, [points[i] for i in queries], first=half == 0)
                    pairs.append(np.stack([queries[q], indexed[w]], axis=1))
        found = np.concatenate(pairs)
        longer = found[sizes[found[:, 0]] != sizes[found[:, 1]]]
        a, b = np.concatenate([found, longer[:, ::-1]]).T
        name = coded.dictionary.cast(pa.string())
        return pa.table({"word": name.take(pa.array(a)), "n": count[a], "near": name.take(pa.array(b)), "near_n": count[b]})

    found = cells.groupBy("block").applyInArrow(search, PAIRS)
    # by word only: the groups by word that follow need no other shuffle
    return found.repartition("word").groupBy("word", "near").agg(F.first("n").alias("n"), F.first("near_n").alias("near_n")).select("word", "n", "near", "near_n")


def _last(forms: DataFrame) -> DataFrame:
    """``(word, root)``: where following ``forms(word, form)`` ends. Each round doubles the steps taken.

    A form occurs some times as often as the word, so chains are short and have no loops.
    """
    steps = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        more = written(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        steps = more.select("word", "root")
        if not more.filter("moved").limit(1).count():
            return steps


def variants(words: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, share: int = BLOCK) -> DataFrame:
    """One row per word of ``words(word, n)`` that occurs ``least_count`` times: ``word, form, root, n, n_near, form_n``.

    Near words differ by one inserted, deleted or replaced code point. ``form`` is the near word with the largest n
    (ties: the first in code-point order), if it occurs ``times`` times as often as the word, else null;
    ``root`` is the word that forms lead to in the end, the word itself without a form. An empty table
    gives no rows; shorter words and nulls are left out; other columns are not read.
    """
    kept = words.filter((F.col("n") >= least_count) & (F.char_length("word") >= least_length)).select("word", "n")
    vocabulary = written(kept, "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_words(vocabulary, least_length, share).groupBy("word").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.less") >= times * F.col("n")
    formed = written(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    roots = _last(formed.filter(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
