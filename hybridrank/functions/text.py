"""Text → tokens as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the word pattern (runs of Unicode letters/digits on lower-cased text).
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# Same tokens, found by splitting on the complement (measured faster than extracting matches).
SEPARATOR_PATTERN = r"[^\p{L}\p{N}]+"

#: Tokens of a piece of a text.
PIECE_TOKENS = 64


def doc_text(title: Column | str | None, text: Column | str) -> Column:
    """``title + " " + text`` with missing parts as empty strings (not ``concat_ws``)."""
    t = F.lit("") if title is None else F.coalesce(_col(title), F.lit(""))
    return F.concat(t, F.lit(" "), F.coalesce(_col(text), F.lit("")))


def tokens(text: Column | str) -> Column:
    """Lower-case word tokens of ``text`` as ``array<string>`` (maximal runs of ``TOKEN_PATTERN``)."""
    return F.array_remove(F.split(F.lower(_col(text)), SEPARATOR_PATTERN), "")


def token_pieces(text: Column | str, most: int = PIECE_TOKENS) -> Column:
    """:func:`tokens` in pieces of at most ``most``, in order, as an array of arrays; a text without tokens has one, empty piece.

    A row per piece (``posexplode``; place 0 begins a text) bounds what an Arrow batch of so many rows
    holds, however long the texts are.
    """
    # the outer transform names the tokens, so that they are found once per text and not once per piece
    cut = F.transform(
        F.array(tokens(text)),
        lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(t), F.lit(1)) - 1) / most).cast("int")), lambda i: F.slice(t, i * most + 1, most)),
    )
    return F.element_at(cut, 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
