"""Chat formatting into budgeted, turn-aligned windows, with DataFrame functions only.

Template of a turn: `<|im_start|>role\ntext<|im_end|>\n`. Control strings inside a text are escaped: a
backslash goes after each `<` that `|` or a backslash follows, so `<|` occurs in the output as the
template's own only, and taking the backslash out again restores every text. Roles are percent-encoded.

Windows. A turn costs ceil(bytes / bytes_per_token) + turn_tokens tokens, of its text as it is written. What a window may hold of new
turns is window_tokens less history_tokens and the conversation's system turn, a quarter of window_tokens at least. The prefix sum of
costs before a turn, divided by half of that, numbers the stretch that the turn starts in; a turn that costs more than the half stands alone
behind the others of its stretch. So a window never exceeds window_tokens, with two exceptions that no cut between turns could mend: a turn that alone
is larger than what a window may hold, and a system turn over three quarters of a window less history. Windows are numbered without
gaps. The first system turn of a conversation opens
each window that does not hold it as new. Turns of the preceding window that lie within its last
history_tokens are repeated before the new ones. Only new assistant turns carry the loss: their text's span,
in code points of the formatted window, is in `loss_spans`; a repeated target is masked.

The prefix sums have two levels (blocks of BLOCK turns, then turns in a block), so a conversation with very
many turns is spread over many tasks; a window is assembled from as many turns as its budget admits.

Defined results: null text or role counts as empty; rows without a conv_id are one conversation; null turn sorts first; rows that share conv_id and turn
are ordered by role and text and all stay; an empty table gives no window; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
BLOCK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<([\\|])", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\([\\|])", r"<$1")


def chat_windows(
    turns: DataFrame, window_tokens: int = 2048, history_tokens: int = 256, bytes_per_token: int = 4, turn_tokens: int = 4
) -> DataFrame:
    """conv_id, window, formatted and loss_spans (start, length: code points) and new_turns (which turns are new)."""
    cost = lambda text: (F.ceil(F.octet_length(escape(text)) / bytes_per_token) + turn_tokens).cast("long")
    rows = turns.select(
        # Rows without an id are a conversation too; equi-joins need a value for it.
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"),
        F.col("conv_id").isNotNull().alias("known"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sized = rows.select(
        "*",
        F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK).alias("block"),
        cost(F.col("text")).alias("cost"),
    )
    blocks = sized.groupBy("conv_id", "known", "block").agg(
        F.sum("cost").alias("block_cost"),
        F.count(F.lit(1)).alias("block_rows"),
        F.min(F.when(F.col("role") == "system", F.struct("turn", "role", "text"))).alias("block_system"),
    )
    earlier = W.partitionBy("conv_id", "known").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_id", "known")
    starts = blocks.select(
        "conv_id", "known", "block",
        F.coalesce(F.sum("block_cost").over(earlier), F.lit(0)).alias("cost_before"),
        F.coalesce(F.sum("block_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.min("block_system").over(whole).alias("system"),
    )
    inside = W.partitionBy("conv_id", "known", "block").orderBy("turn", "role", "text")
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = sized.join(starts, ["conv_id", "known", "block"]).select(
        "conv_id", "known", "role", "text", "system",
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("pos"),
        (F.col("cost_before") + F.sum("cost").over(running)).alias("until"),
        F.col("cost"),
        (F.struct("turn", "role", "text") == F.col("system")).alias("same_as_system"),
    )
    room = F.greatest(F.lit(window_tokens - history_tokens) - F.coalesce(cost(F.col("system.text")), F.lit(0)), F.lit(window_tokens // 4))
    half = F.greatest(F.expr("1L"), F.floor(room / 2))
    # Turns start at most `half` apart in a stretch, so its last small one ends within `room`; a large one can only be its last.
    placed = placed.withColumn("part", F.floor((F.col("until") - F.col("cost")) / half) * 2 + (F.col("cost") > half).cast("int"))
    parts = placed.groupBy("conv_id", "known", "part").agg(F.max("until").alias("part_until"))
    order = W.partitionBy("conv_id", "known").orderBy("part")
    numbered = parts.select(
        "conv_id", "known", "part", "part_until",
        (F.row_number().over(order) - 1).alias("window"),
        F.lead("part").over(order).isNotNull().alias("has_next"),
    )
    new = placed.join(numbered, ["conv_id", "known", "part"])
    repeated = F.col("has_next") & (F.col("part_until") - (F.col("until") - F.col("cost")) <= history_tokens)
    copies = F.array(
        F.struct(F.col("window").alias("window"), F.lit(True).alias("new")),
        F.when(repeated, F.struct((F.col("window") + 1).alias("window"), F.lit(False).alias("new"))),
    )
    shown = new.select(
        "conv_id", "known", "role", "text", "pos", "system", "same_as_system",
        F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("copy"),
    ).select("conv_id", "known", "role", "text", "pos", "system", "same_as_system", "copy.*")
    head = F.concat(F.lit(START), F.replace(F.url_encode("role"), F.lit("+"), F.lit("%20")), F.lit("\n"))
    pieces = shown.select(
        "conv_id", "known", "window", "pos", "new", "system", "same_as_system",
        head.alias("head"), escape(F.col("text")).alias("body"),
        (F.col("new") & (F.col("role") == "assistant")).alias("target"),
    )
    gathered = pieces.groupBy("conv_id", "known", "window").agg(
        F.sort_array(F.collect_list(F.struct("pos", "new", "head", "body", "target"))).alias("turns"),
        F.first("system").alias("system"),
        F.bool_or("same_as_system").alias("holds_system"),
    )
    lead = F.when(
        F.col("system").isNotNull() & ~F.coalesce("holds_system", F.lit(False)),
        F.concat(F.lit(START + "system\n"), escape(F.col("system.text")), F.lit(END)),
    ).otherwise("")
    formatted = F.concat(
        "lead", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    )
    empty = F.array().cast("array<struct<start:int,length:int>>")
    walk = F.aggregate(
        "turns",
        F.struct((F.length("lead") + 0).alias("at"), empty.alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(
                t["target"],
                F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )
    flags = F.transform("turns", lambda t: t["new"])
    return gathered.withColumn("lead", lead).select(
        F.when(F.col("known"), F.col("conv_id")).alias("conv_id"), "window", formatted.alias("formatted"), walk["spans"].alias("loss_spans"),
        F.when(F.col("lead") != "", F.concat(F.array(F.lit(False)), flags)).otherwise(flags).alias("new_turns"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns and the digests of what the formatted windows say, per conversation.

    The digests are over a whole conversation's text, which one row must then hold; they exist for checking.
    """
    turn = F.split("formatted", r"<\|im_start\|>")
    turns = F.zip_with(
        F.slice(turn, 2, F.greatest(F.size(turn) - 1, F.lit(0))), "new_turns", lambda t, n: F.when(n, t)
    )
    said = F.transform(
        F.filter(turns, lambda t: t.isNotNull()),
        lambda t: F.concat(
            F.url_decode(F.substring_index(t, "\n", 1)), F.lit("\n"),
            unescape(F.substring(t, F.locate("\n", t) + 1, F.length(t) - F.locate("\n", t) - len(END))), F.lit("\n"),
        ),
    )
    target = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"])))
    each = windows.select(
        "conv_id", "window", said.alias("said"), F.array_join(target, "").alias("loss"), F.length("formatted").cast("long").alias("chars")
    ).select("conv_id", "window", F.size("said").alias("n"), F.array_join("said", "").alias("said"), "loss", "chars")
    whole = each.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("all"),
        F.sum("chars").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id", "n_turns", "formatted_chars",
        F.array_join(F.col("all.said"), "").alias("said"), F.array_join(F.col("all.loss"), "").alias("loss"),
    ).select(
        "conv_id", "n_turns",
        F.sha2(F.encode("said", "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
