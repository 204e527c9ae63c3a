"""Chat formatting by perspective rotation: each participant in turn is the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
NOBODY = "unknown"


def rotate(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each participant of each conversation, seen from that participant.

    (conv, perspective, n_turns, rendered, mask_starts, mask_ends, n_target_chars):
    `rendered` holds every turn as `<|im_start|>HEAD\\nTEXT<|im_end|>\\n`.  HEAD is
    `assistant` for the perspective's own turns, `system` for system turns and
    `user name=SPEAKER` for all others.  The masks are the character ranges, end
    excluded, that a model in the perspective's place has to produce: its own
    turns' TEXT with the end mark.  A conversation of system turns only has no
    participant and no row.

    Turns are ordered by number (nulls first), then by speaker, then text, so
    ties are settled and repeated rows stay, next to each other.  A null speaker
    is `unknown`, a null text is empty, and rows of a null conversation are one
    conversation.  Marks inside a text are broken by a zero-width space after
    `<`, so that no text can open or close a turn.  Other columns are not read.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"<(\|im_(?:start|end)\|>)", "<​$1")
    speaker = F.regexp_replace(F.coalesce(F.col(speaker_col).cast("string"), F.lit(NOBODY)), r"[\r\n]+|<(?=\|im_)", " ")
    rows = df.select(F.col(conv_col), F.struct(F.col(turn_col).cast("bigint").alias("turn"), speaker.alias("speaker"), clean.alias("text")).alias("m"))
    talk = rows.groupBy(conv_col).agg(F.array_sort(F.collect_list("m"), lambda a, b: _order(a, b)).alias("turns"))
    people = F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda m: m["speaker"]), lambda s: s != SYSTEM)))
    each = talk.select(conv_col, "turns", F.explode(people).alias("perspective"))
    head = lambda m: F.when(m["speaker"] == SYSTEM, F.lit(SYSTEM)).when(m["speaker"] == F.col("perspective"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), m["speaker"]))
    said = F.transform("turns", lambda m: F.struct((m["speaker"] == F.col("perspective")).alias("own"), F.concat(F.lit(START), head(m), F.lit("\n")).alias("head"), F.concat(m["text"], F.lit(END)).alias("body")))
    each = each.select(conv_col, "perspective", said.alias("said"))
    # where each turn's body begins and ends: one pass that carries the length so far
    spans = F.aggregate(
        "said",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<own:boolean,a:bigint,b:bigint>>").alias("spans")),
        lambda x, m: F.struct(
            (x["at"] + F.char_length(m["head"]) + F.char_length(m["body"]) + 1).cast("bigint").alias("at"),
            F.concat(x["spans"], F.array(F.struct(m["own"].alias("own"), (x["at"] + F.char_length(m["head"])).cast("bigint").alias("a"), (x["at"] + F.char_length(m["head"]) + F.char_length(m["body"])).cast("bigint").alias("b")))).alias("spans"),
        ),
        lambda x: F.filter(x["spans"], lambda s: s["own"]),
    )
    out = each.select(conv_col, "perspective", F.size("said").cast("bigint").alias("n_turns"), F.array_join(F.transform("said", lambda m: F.concat(m["head"], m["body"], F.lit("\n"))), "").alias("rendered"), spans.alias("own"))
    return out.select(conv_col, "perspective", "n_turns", "rendered", F.col("own")["a"].alias("mask_starts"), F.col("own")["b"].alias("mask_ends"), F.aggregate("own", F.lit(0).cast("bigint"), lambda x, s: x + s["b"] - s["a"]).alias("n_target_chars"))


def _order(a, b):
    """Nulls first, then turn, speaker, text."""
    out = F.lit(0)
    for field in ("text", "speaker"):
        out = F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(out)
    return F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1).when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(out)
