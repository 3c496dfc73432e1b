"""Chat formatting with Spark expressions only.

Template: a block holds neighbouring turns of one role,

    <s>ROLE<c>TEXT<t>TEXT...</s>

Inside roles and texts every `<` is followed by an inserted backslash, so that no control
string can occur there; taking out one backslash after each `<` restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick

OPEN, CONTENT, TURN, CLOSE = "<s>", "<c>", "<t>", "</s>"
TRAINED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(c, F.lit("<"), F.lit("<\\"))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit("<\\"), F.lit("<"))


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have one
    order and are all kept. Null texts and null roles are empty strings. Rows with a null
    conv_id form one conversation. An empty table gives no rows; other columns are ignored.
    segments is an array of (piece, loss) whose pieces joined are the formatted string; loss
    marks the texts of the trained role. A conversation is one value of the result, so its
    size is bound by that of a Spark string; nothing else is gathered.
    """
    t = pick(rows, conv_id=conv_id, turn=turn, role=role, text=text).select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    turns = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(value: Column, loss) -> Column:
        return F.struct(value.alias("piece"), loss.alias("loss"))

    def segments(ts: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            before, after = F.get(ts, i - 1)["role"], F.get(ts, i + 1)["role"]
            lead = F.when(before.eqNullSafe(x["role"]), F.lit(TURN)).otherwise(
                F.concat(F.lit(OPEN), escape(x["role"]), F.lit(CONTENT))
            )
            tail = F.when(after.eqNullSafe(x["role"]), F.lit("")).otherwise(F.lit(CLOSE))
            return F.array(
                piece(lead, F.lit(False)),
                piece(escape(x["text"]), x["role"] == TRAINED),
                piece(tail, F.lit(False)),
            )

        return F.flatten(F.transform(ts, of))

    out = turns.select("conv_id", let(F.col("turns"), segments).alias("segments"))
    return out.select("conv_id", F.array_join(F.col("segments.piece"), "").alias("formatted"), "segments")


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as an array of (role, text)."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")

    def of(block: Column) -> Column:
        parts = F.split(block, CONTENT, -1)
        return let(
            F.struct(
                unescape(F.substring(F.get(parts, F.lit(0)), len(OPEN) + 1, 2**31 - 1)).alias("role"),
                F.split(F.get(parts, F.lit(1)), TURN, -1).alias("texts"),
            ),
            lambda p: F.transform(p["texts"], lambda x: F.struct(p["role"].alias("role"), unescape(x).alias("text"))),
        )

    return F.flatten(F.transform(blocks, of))


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_conversations: digests of turns and trained text."""
    read = formatted.select("conv_id", "formatted", "segments", parse_turns(F.col("formatted")).alias("turns"))

    def all_turns(ts: Column) -> Column:
        line = F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
        return F.sha2(F.array_join(line, ""), 256)

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["piece"]))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        all_turns(F.col("turns")).alias("turns_sha256"),
        F.array_join(masked, "").alias("trained"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )
