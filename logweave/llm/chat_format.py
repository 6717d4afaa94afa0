r"""Chat formatting with budgeted windows. DataFrame functions only.

Prefix sums of turn tokens choose windows at turn ends. S = budget - history is the room for what does not come from history. The
opening system turns (s tokens) are repeated in every window if 2 s <= S. A turn over S / 4 has a window of its own. The
others go by the cell of the token line in which they start; cells are S - s - m wide, m the longest of these turns of the
conversation, so what starts in a cell takes S - s tokens at most. A turn with its own window parts the cell around it.
Every window also repeats the turns before it that lie wholly within `history` tokens, fewer where its own turns leave less room.
Tokens are counted on the formatted turns, so a window's text keeps to the budget. Exceptions: a single turn over the budget stands
alone, with nothing repeated; where a single turn leaves no room for the system turns, they are left out. Only new assistant
turns are under the loss mask: each assistant text is a target once.

Prefix sums run in two levels, by blocks of turns and then within a block, so that a very long conversation is spread over
tasks; only the digests that a caller asks for gather a conversation.

Template of a turn: `<s>` role `\n` text `</s>\n`. Roles are URL-encoded. In texts a backslash is doubled and a backslash is
put after the first character of every control string, so that no control string is left and the original can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Control strings without their first character, as a pattern. Fixed values.
_TAIL = r"(?=/?s>|/?INST\]|<?/?SYS>>|\|im_start\||\|im_end\|)"
_ESCAPE = r"([<\[])" + _TAIL
_UNESCAPE = r"([<\[])\\" + _TAIL
TURN_END = "</s>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _ESCAPE, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _UNESCAPE, "$1"), F.lit("\\\\"), F.lit("\\"))


def token_estimate(text: Column) -> Column:
    """Words of ASCII letters and digits, and other characters but white space; at least one."""
    return F.greatest(F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]")), F.lit(1)).cast("bigint")


def _turns(conv: DataFrame, block: int, longest: int) -> DataFrame:
    """Formatted turns with their rank, their token interval [lo, hi) within the conversation and the turns over `longest` tokens before them."""
    t = conv.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("t", F.concat(F.lit("<s>"), F.url_encode("role"), F.lit("\n"), escape(F.col("text")), F.lit(TURN_END)))
    t = t.withColumn("tokens", token_estimate(F.col("t"))).withColumn("alone", (F.col("tokens") > longest).cast("bigint"))
    t = t.withColumn("blk", F.floor(F.coalesce("turn", F.lit(-1)) / block))
    inner = W.partitionBy("conv_id", "blk").orderBy("turn", "role", "text")
    so_far = inner.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("rank_in", F.row_number().over(inner).cast("bigint")).withColumn("hi_in", F.sum("tokens").over(so_far)).withColumn("alone_in", F.sum("alone").over(so_far))
    blocks = t.groupBy("conv_id", "blk").agg(F.sum("tokens").alias("b_tokens"), F.count("*").alias("b_rows"), F.sum("alone").alias("b_alone"))
    outer = W.partitionBy("conv_id").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.select(F.col("conv_id").alias("_c"), F.col("blk").alias("_b"), *[F.coalesce(F.sum(x).over(outer), F.lit(0)).alias(y) for x, y in (("b_tokens", "b_lo"), ("b_rows", "b_rank"), ("b_alone", "b_before"))])
    t = t.join(before, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("blk") == F.col("_b")))
    hi = F.col("b_lo") + F.col("hi_in")
    return t.select("conv_id", "role", "t", "tokens", "alone", (F.col("b_rank") + F.col("rank_in")).alias("pos"), (hi - F.col("tokens")).alias("lo"), hi.alias("hi"), (F.col("b_before") + F.col("alone_in") - F.col("alone")).alias("before"))


def format_windows(conversations: DataFrame, budget: int = 512, history: int = 128, block: int = 256) -> DataFrame:
    """One row per window: conv_id, window (number of its first new turn), text, tokens, n_repeated (turns at its start that are repeated), loss_spans.

    loss_spans are code-point intervals [start, stop) of `text`. Turns go by turn number, then role, then text. Null text or
    role: empty. A null conv_id is a conversation of its own. Repeated rows are further turns. No turns: no window. Other
    columns are not read.
    """
    room = budget - history
    if history < 0 or room < 4:
        raise ValueError("the budget must exceed the history by four tokens or more")
    t = _turns(conversations, block, room // 4)
    other = F.col("role") != "system"
    per = t.groupBy("conv_id").agg(F.min(F.when(other, F.col("pos"))).alias("first_other"), F.min(F.when(other, F.col("lo"))).alias("s"), F.coalesce(F.max(F.when(F.col("alone") == 0, F.col("tokens"))), F.lit(0)).alias("m"))
    held = (F.col("s") > 0) & (2 * F.col("s") <= room)
    per = per.select(F.col("conv_id").alias("_c"), F.when(held, F.col("first_other")).otherwise(0).alias("first_other"), F.when(held, F.col("s")).otherwise(0).alias("s"), "m")
    per = per.withColumn("width", room - F.col("s") - F.col("m"))
    t = t.join(per.select("_c", "width"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    t = t.withColumn("cell", F.when(F.col("alone") == 1, 0).otherwise(F.floor(F.col("lo") / F.col("width")))).withColumn("part", 2 * F.col("before") + F.col("alone"))
    heads = t.groupBy("conv_id", "part", "cell").agg(F.min("lo").alias("w_lo"), F.min("pos").alias("window"), F.sum("tokens").alias("new"))
    heads = heads.withColumnsRenamed({"conv_id": "_k", "part": "_part", "cell": "_cell"})
    own = t.join(heads.select("_k", "_part", "_cell", "window"), F.col("conv_id").eqNullSafe(F.col("_k")) & (F.col("part") == F.col("_part")) & (F.col("cell") == F.col("_cell")))
    own = own.select("conv_id", "window", "pos", "role", "t", F.lit(True).alias("new"))
    heads = heads.join(per, F.col("_k").eqNullSafe(F.col("_c"))).drop("_c")
    fits = F.col("s") + F.col("new") <= budget
    heads = heads.select("_k", "window", "w_lo", "first_other", F.when(fits, F.col("s")).otherwise(0).alias("s"), F.least(F.lit(history), F.greatest(budget - F.col("new") - F.when(fits, F.col("s")).otherwise(0), F.lit(0))).alias("past"))
    opening = t.where("role = 'system'").select("conv_id", "role", "t", "pos")
    system = heads.where("s > 0").join(opening, F.col("_k").eqNullSafe(F.col("conv_id")) & (F.col("pos") < F.col("window")) & (F.col("pos") < F.col("first_other")))
    system = system.select("conv_id", "window", "pos", "role", "t", F.lit(False).alias("new"))
    # a turn is history of the windows that start in [hi, lo + history]; those lie in a fixed number of cells
    wide = max(history, 1)
    reach = t.where(F.col("hi") <= F.col("lo") + history).withColumn("at", F.explode(F.sequence(F.floor(F.col("hi") / wide), F.floor((F.col("lo") + history) / wide))))
    starts = heads.where("past > 0").withColumn("_at", F.floor(F.col("w_lo") / wide))
    past = reach.join(starts, F.col("conv_id").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_at")) & F.col("w_lo").between(F.col("hi"), F.col("lo") + F.col("past")))
    past = past.select("conv_id", "window", "pos", "role", "t", F.lit(False).alias("new"))
    # an opening system turn may also be recent history: once is enough
    rows = own.unionByName(system).unionByName(past)
    rows = rows.groupBy("conv_id", "window").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("pos", "role", "t", "new")))).alias("turns"))
    rows = rows.withColumn("parts", F.transform("turns", lambda x: F.struct(x["t"].alias("t"), x["new"].alias("new"), (x["role"] == "assistant").alias("target"), (F.length(F.url_encode(x["role"])) + 4).alias("skip"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["t"])
        span = F.struct((acc["at"] + x["skip"]).alias("start"), (end - len(TURN_END)).alias("stop"))
        return F.struct(end.alias("at"), F.when(x["new"] & x["target"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.col("parts.t"), "")
    return rows.select(
        "conv_id", "window", text.alias("text"), token_estimate(text).alias("tokens"), F.size(F.filter("parts", lambda x: ~x["new"])).alias("n_repeated"),
        F.aggregate("parts", start, add, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """One row per window, read back from its text: conv_id, window, turns (role and text of the new turns), loss (texts under the mask)."""
    pieces = F.slice(F.split("text", TURN_END, -1), 1, F.size(F.split("text", TURN_END, -1)) - 1)
    fresh = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - F.col("n_repeated"), F.lit(0)))
    cut_at = lambda x: F.locate("\n", x)
    turns = F.transform(fresh, lambda x: F.struct(F.url_decode(F.substring(x, F.lit(4), cut_at(x) - 4)).alias("role"), unescape(F.substring(x, cut_at(x) + 1, F.length(x))).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["stop"] - s["start"])))
    return windows.select("conv_id", "window", turns.alias("turns"), loss.alias("loss"), F.length("text").cast("bigint").alias("chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows: read back from the windows' texts."""
    read = read_windows(windows)
    part = F.struct("window", F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("t"), F.array_join("loss", "").alias("l"))
    rows = read.groupBy("conv_id").agg(F.sum(F.size("turns")).cast("bigint").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"), F.array_sort(F.collect_list(part)).alias("p"))
    loss = F.array_join(F.col("p.l"), "")
    return rows.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("p.t"), ""), 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
