"""Chat formatting as relational expressions: gather, merge, escape, concatenate; and reading back.

A conversation is one text.  Adjacent turns of one role form a block
``<turn ROLE>PART<part>PART<end>``; every part is one row of the table.  Inside roles
and parts a backslash is written ``\\\\``, ``<`` is ``\\l`` and ``>`` is ``\\g``, so a ``<``
in the output always begins a control string and reading back is exact.  The loss mask
is a list of spans (start, length in code points) over the parts of assistant turns.

Defined results: rows of a conversation are ordered by turn, role and text, nulls first,
and equal rows stay; null text is empty; null roles read back as empty; a null
conversation id is a conversation of its own; an empty table gives an empty table.
Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, MIDDLE, PART, END = "<turn ", ">", "<part>", "<end>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: pairs of backslashes cut the text, so no other pair can begin inside one."""
    pieces = F.split(text, r"\\\\")
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(plain, "\\")


def _blocks(turns: Column) -> Column:
    """Blocks of adjacent equal roles.

    The first turn of every block is where the role differs from the turn before;
    a block is the slice up to the next such place.
    """
    size = F.size(turns)
    places = F.filter(
        F.sequence(F.lit(1), size),
        lambda i: (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]),
    )
    return F.transform(
        places,
        lambda at, k: F.struct(
            F.element_at(turns, at)["role"].alias("role"),
            F.transform(
                F.slice(turns, at, F.coalesce(F.get(places, k + 1), size + 1) - at), lambda t: t["text"]
            ).alias("parts"),
        ),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` from rows ``conv_id, turn, role, text``."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    item = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    in_order = F.array_sort(F.collect_list(item))  # by the texts themselves; escaped ones sort otherwise
    written_out = F.transform(in_order, lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    gathered = turns.groupBy("conv_id").agg(written_out.alias("_turns"))
    blocks = gathered.select("conv_id", _blocks(F.col("_turns")).alias("_blocks"))
    written = F.transform(
        "_blocks",
        lambda b: F.concat(F.lit(TURN), b["role"], F.lit(MIDDLE), F.array_join(b["parts"], PART), F.lit(END)),
    )
    # The parts of all blocks, each with its block's opening where it is the first.
    pieces = F.flatten(
        F.transform(
            "_blocks",
            lambda b: F.transform(
                b["parts"],
                lambda p, i: F.struct(
                    F.when(i == 0, F.length(b["role"]) + len(TURN) + len(MIDDLE)).otherwise(len(PART)).alias("lead"),
                    F.length(p).alias("length"),
                    F.when(i == F.size(b["parts"]) - 1, len(END)).otherwise(0).alias("tail"),
                    (b["role"] == LEARNED).alias("learned"),
                ),
            ),
        )
    )
    flat = blocks.select("conv_id", F.array_join(written, "").alias("formatted"), pieces.alias("_pieces"))
    return flat.select("conv_id", "formatted", _learned(F.col("_pieces")).alias("loss_spans"))


def _learned(pieces: Column) -> Column:
    """Spans of learned parts; starts are running sums of the lengths before."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + p["lead"]
        span = F.array(F.struct(begin.alias("start"), p["length"].alias("length")))
        return F.struct((begin + p["length"] + p["tail"]).alias("at"), F.when(p["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step, lambda s: s["spans"])


def turns_of(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: array of ``role, text``."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")

    def parts(block: Column) -> Column:
        head = F.instr(block, MIDDLE)
        role = F.substring(block, F.lit(len(TURN) + 1), head - len(TURN) - 1)
        body = F.substring(block, head + 1, F.length(block))
        return F.transform(F.split(body, PART), lambda p: F.struct(unescape(role).alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, parts))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest columns taken from the output of ``format_conversations``."""
    turns, mask = F.col("_read"), F.col("_mask")
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        turns_of(F.col("formatted")).alias("_read"),
        masked_text(F.col("formatted"), F.col("loss_spans")).alias("_mask"),
    )
    return read.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(mask).cast("long").alias("loss_chars"),
        F.sha2(mask.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
