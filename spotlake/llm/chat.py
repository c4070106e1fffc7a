r"""Operator 6: chat formatting into budgeted windows, in DataFrame functions only.

A turn is formatted as `<s>role\ntext</s>\n`. Control strings inside a text get a backslash after their first character (one
more if there are some already), so none is left to be read as a mark, and taking one backslash away restores the text.

Prefix sums of turn tokens deal the turns of a conversation to stretches: a turn belongs to the stretch in which its prefix falls,
stretches being half of the room that the budget leaves beside the system turn. A stretch is one span, or two if it is over that room:
its last turn, which alone can reach beyond its end, is then a span of its own. So spans break at turns only. A window is a span led by
the conversation's first turn, if that is a system turn and the window has room for it, and by up to `history` turns from before the
span as far as the budget allows. What a window repeats comes first and is counted in n_repeated; assistant turns are targets in the
window that they belong to and masked where they are repeated.

No window is over the budget but that of a turn that is over it alone, for a turn is never cut. The system turn is missing only from
windows that are within the budget without it and would be over it with it: those of one long turn, and those after a system turn of over
half a budget.
Tokens are an estimate by a regex unless the caller gives a token count.

Prefix sums are taken in blocks of turn numbers and then over blocks, and history and system turns come by joins on the
place in the conversation, so no task holds a whole conversation.

Null text counts as empty, a null role as the empty role, a null turn comes first. Rows without a conversation id form one
conversation. Turns with the same number are kept, in the order of role and text. Columns besides the four named aren't
carried. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.common import cut

OPEN, CLOSE = "<s>", "</s>\n"
#: What else marks turns for common readers; escaped too.
_CONTROL = r"/?s>|/?INST\]|</?SYS>>|\|"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*)({_CONTROL})", rf"([<\[])\\(\\*)({_CONTROL})"
#: Tokens that a turn costs besides its text; turns in a block.
OVERHEAD, BLOCK = 4, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, r"$1$2$3")


def _role(role: Column) -> Column:
    """A header is one line: backslashes and newlines of a role are escaped besides control strings."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """An estimate that needs no vocabulary: runs of up to six letters, digits one by one, other characters one by one."""
    return F.regexp_count(text, F.lit(r"\p{L}{1,6}|[^ \t\n\x0B\f\r\p{L}]"))


def _placed(chats: DataFrame, count) -> DataFrame:
    """chats with at (place from 0), prefix (tokens before the turn) and system_tokens (of the first turn, if that is a system turn)."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62)))
    rows = chats.select(conv.alias("conv"), "conv_id", turn.alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", count(F.col("text")).cast("long") + OVERHEAD).withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = Window.partitionBy("conv").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.min_by(F.struct("role", "tokens"), F.struct("turn", "role", "text")).alias("first")
    blocks = rows.groupBy("conv", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"), first)
    opening = F.first("first").over(order.rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum0"), opening.alias("opening"))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    at, prefix = F.row_number().over(inside) - 1, F.coalesce(F.sum("tokens").over(earlier), F.lit(0))
    placed = rows.withColumn("at", at).withColumn("prefix", prefix).join(blocks, ["conv", "block"])
    system = F.when(F.col("opening.role") == "system", F.col("opening.tokens")).alias("system_tokens")
    return placed.select("conv", "conv_id", "role", "text", "tokens", (F.col("at") + F.col("n0")).alias("at"), (F.col("prefix") + F.col("sum0")).alias("prefix"), system)


def format_windows(chats: DataFrame, budget: int = 1024, history: int = 2, count=tokens) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, window, formatted, n_repeated, loss_spans (array of start, stop in characters), tokens.

    count: a column function from a text to its tokens; a turn costs OVERHEAD more.
    """
    system_tokens = F.coalesce("system_tokens", F.lit(0))
    room = F.when(system_tokens <= budget // 2, F.lit(budget) - system_tokens).otherwise(F.lit(budget))
    stretch = Window.partitionBy("conv", "stretch")  # a stretch holds at most budget / OVERHEAD turns
    marked = _placed(chats, count).withColumn("room", room).withColumn("stretch", F.floor(F.col("prefix") / F.floor(F.col("room") / 2)))
    over = F.sum("tokens").over(stretch) > F.when(F.col("stretch") == 0, budget).otherwise(F.col("room"))
    apart = over & (F.col("at") == F.max("at").over(stretch))
    marked = marked.withColumn("window", F.col("stretch") * 2 + apart.cast("int"))
    head = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    piece = F.struct("at", F.concat(head, body, F.lit(CLOSE)).alias("piece"), F.length(head).alias("head"), F.length(body).alias("body"), (F.col("role") == "assistant").alias("target"))
    turns = cut(marked.select("conv", "conv_id", "window", "at", "tokens", "role", piece.alias("p")))
    own = turns.groupBy("conv", "window").agg(F.min("at").alias("first"), F.sum("tokens").alias("own_tokens"))
    system = turns.where((F.col("at") == 0) & (F.col("role") == "system")).select("conv", F.col("tokens").alias("system_tokens"), F.col("p").alias("system"))
    windows = own.join(system, "conv", "left").where("window > 0")
    fits = (F.col("own_tokens") + F.col("system_tokens") <= budget) | (F.col("own_tokens") > budget)
    windows = windows.withColumn("system", F.when(fits, F.col("system"))).withColumn("system_tokens", F.when(fits, F.col("system_tokens")))
    kept = F.coalesce(F.col("system_tokens"), F.lit(0)).alias("kept")
    back = windows.select("conv", "window", "first", (F.lit(budget) - F.col("own_tokens") - kept).alias("room"), F.col("system").isNotNull().alias("led"), F.explode(F.sequence(F.lit(1), F.lit(history))).alias("h"))
    back = back.select("conv", "window", "room", "h", "led", (F.col("first") - F.col("h")).alias("at")).where("at >= int(led)")
    source = turns.select(F.col("conv").alias("conv"), F.col("at").alias("at"), F.col("tokens").alias("tokens"), F.col("p").alias("p"))
    back = back.join(source, ["conv", "at"])
    run = F.sum("tokens").over(Window.partitionBy("conv", "window").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    back = back.withColumn("run", run).where("run <= room").select("conv", "window", F.lit(1).alias("kind"), "p", "tokens")
    lead = windows.where(F.col("system").isNotNull()).select("conv", "window", F.lit(0).alias("kind"), F.col("system").alias("p"), F.col("system_tokens").alias("tokens"))
    parts = turns.select("conv", "window", F.lit(2).alias("kind"), "p", "tokens").unionByName(lead).unionByName(back)
    grouped = parts.groupBy("conv", "window").agg(
        F.sort_array(F.collect_list(F.struct("kind", "p"))).alias("parts"),
        F.count_if(F.col("kind") < 2).cast("int").alias("n_repeated"),
        F.sum("tokens").alias("tokens"),
    )
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]["piece"])).alias("at"),
            F.when((x["kind"] == 2) & x["p"]["target"], F.concat(acc["out"], F.array(F.struct((acc["at"] + x["p"]["head"]).alias("start"), (acc["at"] + x["p"]["head"] + x["p"]["body"]).alias("stop")))))
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    formatted = F.array_join(F.transform("parts", lambda x: x["p"]["piece"]), "")
    ids = turns.where("at = 0").select("conv", "conv_id")
    return grouped.select("conv", "window", formatted.alias("formatted"), "n_repeated", spans.alias("loss_spans"), "tokens").join(ids, "conv").select("conv_id", "window", "formatted", "n_repeated", "loss_spans", "tokens")


def read_back(windows: DataFrame) -> DataFrame:
    """A row per window: conv_id, window, turns (array of role, text: those that it doesn't repeat), targets (array of text under the mask)."""
    marks = F.split("formatted", CLOSE, -1)
    own = F.slice(marks, F.col("n_repeated") + 1, F.greatest(F.size(marks) - 1 - F.col("n_repeated"), F.lit(0)))
    turns = F.transform(own, lambda t: F.struct(_unrole(F.substring_index(F.substring(t, F.lit(len(OPEN) + 1), F.length(t)), "\n", 1)).alias("role"), unescape(F.substring(t, F.locate("\n", t) + 1, F.length(t))).alias("text")))
    targets = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    return windows.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").alias("chars"))
