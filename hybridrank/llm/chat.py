"""Chat formatting: records of any known layout become turns, turns become text with a loss mask.

The nested field paths that a record has are hashed; the hash selects the declarative mapping that turns
such records into ``(role, text)`` rows. Typed tables are told by their schema, once; records of mixed
layouts (JSON lines) row by row. Built from DataFrame functions only.

The template marks a turn as ``<|im_start|>role``, a line feed, the text and ``<|im_end|>`` with a line
feed. Inside roles and texts every ``<|`` gets a backslash between its characters (and ``<\\|`` one
more), so no text can hold a control string, and taking one away gives the text back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, partitions

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"

#: Turns in a piece; a longer conversation is several pieces, which no one task has to gather.
PIECE = 64
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How records of one layout become turns.

    ``turns`` lists what a record says in order: ``(role, path)`` for a field's text (skipped when the
    record lacks it or it is null and ``optional`` names it), or ``(path, role field, text field)`` for
    an array of messages. ``names`` maps its role names to canonical ones. A layout's paths are those
    that ``turns`` reads; ``optional`` paths belong to the layout whether present or not.
    """

    name: str
    turns: tuple[tuple[str, ...], ...]
    optional: tuple[str, ...] = ()
    names: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def paths(self) -> frozenset[str]:
        out = set()
        for t in self.turns:
            out |= {t[1]} if len(t) == 2 else {f"{t[0]}[].{t[1]}", f"{t[0]}[].{t[2]}"}
        return frozenset(out)

    @property
    def fingerprints(self) -> list[str]:
        """Hashes of the path sets that records of this layout may have."""
        sets = [self.paths - set(self.optional)]
        for p in self.optional:
            sets += [s | {p} for s in sets]
        return [fingerprint(s) for s in sets]


# Field names of layouts in common use.
NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn_rows", (("role", "text"),), optional=("turn",)),
    Layout("messages", (("messages", "role", "content"),), names=NAMES),
    Layout("shared_conversations", (("conversations", "from", "value"),), names=NAMES),
    Layout("prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("prompt_completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("question_answer", (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("nested_dialog", (("dialog.messages", "role", "content"),), names=NAMES),
)
ROW_PATHS = frozenset({"turn", "role", "text"})


def fingerprint(paths) -> str:
    """The first 16 hex digits of the sha256 of the sorted paths, a line each."""
    return hashlib.sha256("".join(f"{p}\n" for p in sorted(paths)).encode()).hexdigest()[:16]


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """All nested field paths of a schema; ``[]`` stands for the elements of an array."""
    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            out += [path, *schema_paths(f.dataType, path)]
        return out
    return schema_paths(schema.elementType, f"{prefix}[]") if isinstance(schema, T.ArrayType) else []


def _known(layouts) -> list[str]:
    return sorted({p for layout in layouts for p in (*layout.paths, *layout.optional)})


def layout_of(schema: T.StructType, layouts=LAYOUTS) -> Layout:
    """The layout of a typed table: paths that no layout reads don't count."""
    own, known = set(schema_paths(schema)), set(_known(layouts))
    code = fingerprint(ROW_PATHS if ROW_PATHS <= own else own & known)
    if code == fingerprint(ROW_PATHS):
        return layouts[0]
    for layout in layouts:
        if code in layout.fingerprints:
            return layout
    raise ValueError(f"no layout has the paths {sorted(own & known)}")


def _json_path(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path.split("."))


def record_fingerprint(record: Column, layouts=LAYOUTS) -> Column:
    """The same hash of the known paths that a variant holds, null values included; of arrays the first element tells."""

    def there(path: str) -> Column:
        outer, _, inner = path.partition("[].")
        step = _json_path(outer) + (f"[0]['{inner}']" if inner else "")
        return F.try_variant_get(record, step, "variant").isNotNull()

    lines = [F.when(there(p), F.lit(f"{p}\n")).otherwise(F.lit("")) for p in _known(layouts) if p not in ROW_PATHS]
    return F.left(F.sha2(F.concat(*lines), 256), F.lit(16))


def _role(role: Column, names: dict[str, str]) -> Column:
    if not names:
        return role
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), role), role)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))


def _mapped(layout: Layout, text, messages) -> Column:
    """A record's turns; ``text(path)`` and ``messages(path, role, text)`` read it."""
    parts = []
    for t in layout.turns:
        if len(t) == 3:
            parts.append(F.coalesce(F.transform(messages(*t), lambda m: _turn(_role(m["role"], layout.names), m["text"])), F.array().cast(TURNS)))
        else:
            turn = F.array(_turn(F.lit(t[0]), text(t[1])))
            parts.append(F.when(text(t[1]).isNull(), F.array().cast(TURNS)).otherwise(turn) if t[1] in layout.optional else turn)
    return F.concat(*parts)


def record_turns(record: Column, layouts=LAYOUTS) -> Column:
    """The turns of a variant: the mapping of each layout that the fingerprint of the record selects, else null."""
    text = lambda path: F.try_variant_get(record, _json_path(path), "string")

    def messages(path: str, role: str, said: str) -> Column:
        each = F.try_variant_get(record, _json_path(path), "array<variant>")
        return F.transform(each, lambda m: F.struct(*[F.try_variant_get(m, _json_path(p), "string").alias(n) for p, n in ((role, "role"), (said, "text"))]))

    code, out = record_fingerprint(record, layouts), F.lit(None).cast(TURNS)
    for layout in layouts:
        if layout.name != "turn_rows":
            out = F.when(code.isin(layout.fingerprints), _mapped(layout, text, messages)).otherwise(out)
    return out


def turns_of(table: DataFrame, id_col: str = "conv_id", record_col: str | None = None, layouts=LAYOUTS) -> DataFrame:
    """``(conv_id, turn, role, text)`` of a table of any known layout.

    Without ``record_col`` the schema's fingerprint selects one mapping for the whole table; with it, that
    JSON text's fingerprint selects one for each row. A record whose layout isn't known raises when it is read.
    """
    conv = F.col(id_col).cast("long").alias("conv_id")
    if record_col is not None:
        turns = record_turns(F.parse_json(F.col(record_col)), layouts)
        known = F.coalesce(turns, F.raise_error(F.concat(F.lit("no layout for the record "), F.col(record_col))).cast(TURNS))
        return table.select(conv, F.posexplode(known).alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")
    layout = layout_of(table.schema, layouts)
    if layout.name == "turn_rows":
        return table.select(conv, F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    known = {p for p in schema_paths(table.schema)}
    text = lambda path: F.col(path) if path in known else F.lit(None).cast("string")
    messages = lambda path, role, said: F.transform(F.col(path), lambda m: F.struct(m[role].alias("role"), m[said].alias("text")))
    return table.select(conv, F.posexplode(_mapped(layout, text, messages)).alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_written(role: Column) -> Column:
    """A role in one line."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_read(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _pieces(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, piece, said)`` with at most ``PIECE`` turns each: of conversations that are one piece, and of longer ones.

    Row counts tell long conversations apart; those are ordered by a range exchange, which splits one
    conversation over tasks, and cut where they stand. All others move once, by conversation.
    """
    order = ["turn", "role", "text"]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    long = turns.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > PIECE).select(F.col("conv_id").alias("long_id"))
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    said = F.array_sort(F.collect_list(F.struct(*order))).alias("said")
    short_pieces = rows.join(long, is_long, "left_anti").groupBy("conv_id").agg(said).withColumn("piece", F.lit(0).cast("long"))
    keys = ["conv_id", "turn", "role", "check"]
    placed = (
        rows.join(long, is_long, "left_semi")
        .withColumn("check", F.xxhash64("text"))
        .repartitionByRange(partitions(turns.sparkSession), *keys)
        .sortWithinPartitions(*keys, "text")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("piece", F.floor(F.col("at") / PIECE).cast("long"))
    )
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", *order))), lambda t: F.struct(*[t[c].alias(c) for c in order]))
    return short_pieces, placed.groupBy("conv_id", "piece").agg(in_order.alias("said"))


def _formatted(pieces: DataFrame) -> DataFrame:
    """``(conv_id, piece, formatted, loss)`` of ``(conv_id, piece, said)``."""
    body = F.transform("said", lambda t: F.struct(
        F.concat(F.lit(START), _role_written(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("text"), (t["role"] == TRAINED_ROLE).alias("trained")
    ))
    tail = END + "\n"
    sized = pieces.select("conv_id", "piece", body.alias("turns"))
    size = lambda t: (F.char_length(t["head"]) + F.char_length(t["text"]) + len(tail)).cast("long")

    def spans(turns: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(turns, F.lit(1), i), F.lit(0).cast("long"), lambda s, t: s + size(t))
        at = F.transform(turns, lambda t, i: F.struct((before(i) + F.char_length(t["head"])).alias("start"), F.char_length(t["text"]).cast("long").alias("length"), t["trained"].alias("trained")))
        return F.transform(F.filter(at, lambda s: s["trained"]), lambda s: F.struct(s["start"], s["length"]))

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(tail))), "")
    return sized.select("conv_id", "piece", text.alias("formatted"), let(F.col("turns"), spans).alias("loss"))


def formatted(turns: DataFrame) -> DataFrame:
    """``(conv_id, piece, formatted, loss)``: the text of each conversation and the code points that are trained on.

    ``turns(conv_id, turn, role, text)`` may come in any order. A conversation of at most ``PIECE`` turns is
    one row; a longer one is several, in order of ``piece``. ``loss`` lists ``(start, length)`` of every
    assistant text, escaped, in code points of its row, from 0. Turns are ordered by number, then role, then
    text or (in long conversations) its hash; a null number comes first, null roles and texts are empty, rows
    without conv_id are one conversation, repeated rows are turns of their own. An empty table gives no
    rows; other columns are not read.
    """
    short, long = _pieces(turns)
    return _formatted(short).unionByName(_formatted(long))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, ``array<struct<role, text>>``, in order."""
    bodies = F.filter(F.split(text, r"<\|im_start\|>"), lambda b: b != "")
    role = lambda b: F.substring_index(b, "\n", 1)
    inner = lambda b: F.substr(b, F.char_length(role(b)) + 2, F.char_length(b) - F.char_length(role(b)) - 1 - len(END + "\n"))
    return F.transform(bodies, lambda b: F.struct(_role_read(role(b)).alias("role"), unescaped(inner(b)).alias("text")))


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under the loss mask, one after the other."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def _read(pieces: DataFrame) -> DataFrame:
    turns = read_turns(F.col("formatted"))
    all_said = lambda ts: F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return pieces.select(
        "conv_id", "piece", F.char_length("formatted").cast("long").alias("formatted_chars"),
        let(turns, lambda ts: F.struct(F.size(ts).cast("long").alias("n"), all_said(ts).alias("said"))).alias("read"),
        read_loss(F.col("formatted"), F.col("loss")).alias("learnt"),
    ).select("conv_id", "piece", "formatted_chars", F.col("read.n").alias("n_turns"), "read.said", "learnt")


def _digests(read: DataFrame) -> DataFrame:
    return read.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )


def checked(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted text: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    The digests are of ``role, \\n, text, \\n`` of each turn and of all text under the loss mask. A digest
    needs a conversation's whole text in one row (at most 2 GB); it is put together from its pieces.
    """
    short, long = (_read(_formatted(p)) for p in _pieces(turns))
    in_order = F.array_sort(F.collect_list(F.struct("piece", "said", "learnt")))
    whole = long.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), in_order.alias("parts"))
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    whole = whole.select("conv_id", "n_turns", "formatted_chars", joined("said").alias("said"), joined("learnt").alias("learnt"))
    return _digests(short).unionByName(_digests(whole))
