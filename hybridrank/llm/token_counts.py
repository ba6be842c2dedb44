"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton of the vocabulary names every piece that ends at a character; the best score
up to there, and how many pieces it takes, follow from those of the places where these pieces begin.
Nothing else is kept: no lattice, no back pointers, no pieces.
"""

from __future__ import annotations

import re
import sys
import types

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the tokenizer: how much an unknown character scores below the worst piece, and the mark
# for a space.
UNKNOWN_PENALTY = 10.0
MARK = "▁"

#: Words a worker remembers, and the length of the longest that it does.
MEMORY_WORDS, MEMORY_LENGTH = 1 << 19, 64


class Counter:
    """Counts pieces of texts.

    A text is cut before a mark that follows another character, where no piece goes on from one to the
    other: such parts are independent, and their counts are remembered. With a vocabulary that has pieces
    across (or no piece for the mark alone) texts are not cut.

    Of equal scores for the same place the piece that begins first stays, an unknown character comes
    last. Unknown characters next to each other are one token, or a token for each byte when the
    vocabulary has pieces for all bytes.
    """

    def __init__(self, pieces: list[tuple[str, float]], by_bytes: bool = False) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.by_bytes = by_bytes
        across = re.compile(f"[^{MARK}]{MARK}")
        self.part = None if any(across.search(p) for p, _ in pieces) or MARK not in dict(pieces) else re.compile(f"{MARK}+[^{MARK}]*")
        self.memory: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Pieces of ``text``, marks included."""
        n = len(text)
        found: list[list] = [[] for _ in range(n)]
        if len(self.automaton):
            for end, piece in self.automaton.iter(text):
                found[end].append(piece)
        best, count, fused = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            top, pieces, unknown, single = None, 0, False, False
            for length, score in found[end]:  # longest first
                total = best[end + 1 - length] + score
                if top is None or total > top:
                    top, pieces = total, count[end + 1 - length] + 1
                single = single or length == 1
            if not single:
                total = best[end] + self.unknown
                if top is None or total > top:
                    own = len(text[end].encode("utf-8")) if self.by_bytes else int(not fused[end])
                    top, pieces, unknown = total, count[end] + own, True
            best[end + 1], count[end + 1], fused[end + 1] = top, pieces, unknown
        return count[n]

    def text(self, text: str) -> int:
        """Pieces of a whole text whose spaces are marks in front of words (the text's start is one too)."""
        if not text:
            return 0
        text = text.replace(" ", MARK)
        text = text if text.startswith(MARK) else MARK + text
        memory, total = self.memory, 0
        for w in self.part.findall(text) if self.part else [text]:
            n = memory.get(w)
            if n is None:
                n = self.word(w)
                if len(w) <= MEMORY_LENGTH:
                    if len(memory) >= MEMORY_WORDS:
                        memory.clear()
                    memory[w] = n
            total += n
        return total


def pieces_of(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces that texts can hold, with their scores, of a sentencepiece model file, and whether it has a piece for every byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain], sum(model.is_byte(i) for i in ids) == 256


def counted(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens``, over each whole text.

    ``vocabulary`` is the path of a sentencepiece model file that every worker can open; its pieces and
    scores are used as a unigram vocabulary. Empty and null texts have no tokens, repeated rows equal
    counts; an empty table gives no rows. Other columns are not read. Nothing is shuffled, and a worker
    remembers a bounded number of words.
    """

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        kept = sys.modules.setdefault("_hybridrank_llm_kept", types.ModuleType("_hybridrank_llm_kept"))
        counter = kept.__dict__.get(("counter", vocabulary))
        if counter is None:
            counter = kept.__dict__[("counter", vocabulary)] = Counter(*pieces_of(vocabulary))
        return pa.array([counter.text(t) for t in texts.to_pylist()], pa.int64())

    return docs.select(F.col(id_col).alias("doc_id"), count(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("n_tokens"))
