"""Chat formatting in budgeted windows.

Prefix sums of turn tokens part a conversation into stretches of turns, and each stretch into windows, filled
turn by turn. A window has the system turn, a little history repeated from before it, and its own turns; all
of them together keep to the budget. Only its own assistant turns lie under the loss mask, so every target
counts once.

The template writes a turn as ``<turn:ROLE>`` newline, text, ``</turn>`` newline, and a repeated one with
``again`` for ``turn``. Inside roles and texts ``~``, ``<`` and ``>`` are written ``~0``, ``~1`` and ``~2``, so
no text can hold a marker, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tokens of a window; turns repeated in it from before, and their tokens.
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 256, 2, 64
#: Budgets of a stretch, whose turns one task holds at once.
STRETCH = 64
END = "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit(">"), F.lit("~2"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~2"), F.lit(">")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def turn_tokens(text: Column) -> Column:
    """An estimate: a token for each four code points, and four for the markers."""
    return F.ceil(F.char_length(text) / 4).cast("long") + 4


def _piece(turn: Column, again: Column) -> Column:
    return F.concat(F.when(again, F.lit("<again:")).otherwise(F.lit("<turn:")), escape(turn["role"]), F.lit(">\n"), escape(turn["text"]), F.lit(END))


def _windows(ahead: Column, own: Column, system: Column, budget: int, turns: int, tokens: int) -> Column:
    """Windows of a stretch as array<struct<at, history, size>>: place of the first own turn, turns repeated before it, own turns.

    A turn goes to the window before it while the budget lasts; a fresh window repeats the turns just
    before it as far as all three bounds allow.
    """
    taken = F.coalesce(system["tokens"], F.lit(0).cast("long"))

    def repeated(tail: Column, load: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            fits = acc["open"] & (acc["sum"] + x <= tokens) & (taken + load + acc["sum"] + x <= budget)
            return F.struct(F.when(fits, acc["sum"] + x).otherwise(acc["sum"]).alias("sum"), (acc["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

        return F.aggregate(F.reverse(tail), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open")), step)

    def step(acc: Column, t: Column) -> Column:
        load = t["tokens"]
        fits = (acc["at"] > 0) & (acc["used"] + load <= budget)
        before = repeated(acc["tail"], load)
        fresh = F.struct((acc["at"] + 1).alias("at"), before["n"].alias("history"))
        longer = F.concat(acc["tail"], F.array(load))
        tail = F.when(F.size(longer) > turns, F.slice(longer, F.greatest(F.size(longer) - turns + 1, F.lit(1)), turns)).otherwise(longer)
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(fits, acc["used"] + load).otherwise(taken + load + before["sum"]).alias("used"),
            tail.alias("tail"),
            F.when(fits, acc["marks"]).otherwise(F.concat(acc["marks"], F.array(fresh))).alias("marks"),
        )

    none = F.expr("cast(array() as array<struct<at: int, history: int>>)")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("used"), F.transform(ahead, lambda t: t["tokens"]).alias("tail"), none.alias("marks"))
    marks = F.aggregate(own, zero, step, lambda acc: acc["marks"])
    following = lambda i: F.coalesce(F.get(marks, i + 1)["at"], F.size(own) + 1)
    sized = F.transform(marks, lambda m, i: F.struct(m["at"].alias("at"), m["history"].alias("history"), (following(i) - m["at"]).alias("size")))
    only_system = F.array(F.struct(F.lit(1).alias("at"), F.lit(0).alias("history"), F.lit(0).alias("size")))
    return F.when(F.size(own) > 0, sized).otherwise(only_system)


def format_conversations(df: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, tokens: str | None = None) -> DataFrame:
    """Windows ``(conv_id, window, formatted, loss)`` of the turns ``(conv_id, turn, role, text)``.

    ``window`` grows along a conversation, not without gaps. ``loss`` lists the spans (start, end in code
    points, end exclusive) of the window's own assistant texts in ``formatted``. The tokens of all turns of
    a window, the system turn and repeated ones included, are at most ``budget``; only a window of a single turn
    of its own that leaves no room (beside the system turn) can exceed it. It repeats nothing else. No turn
    is cut or dropped. ``tokens`` names a column with each turn's tokens; without it, or where it is null,
    they are estimated by ``turn_tokens``.

    A first turn of role ``system`` is retained in every window if it takes half the budget at most; a longer
    one, and later system turns, are turns like others. Up to ``history_turns`` turns before a window are repeated
    in it, of at most ``history_tokens`` tokens together.

    Null texts and roles are empty. Turns are ordered by turn (nulls first), then role and text;
    repeated rows are turns of their own. A null conv_id is a conversation like any other. Other
    columns are not read. An empty table gives no windows.

    One task holds the turns of a stretch of STRETCH budgets at once, however long the conversation is;
    only their running sum goes along the whole conversation, and spills.
    """
    load = turn_tokens(F.coalesce(F.col("text"), F.lit("")))
    load = load if tokens is None else F.coalesce(F.col(tokens).cast("long"), load)
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), load.alias("tokens"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(w))
    rows = rows.withColumn("system", (F.col("n") == 1) & (F.col("role") == "system") & (F.col("tokens") <= budget // 2))
    rows = rows.withColumn("load", F.when(F.col("system"), 0).otherwise(F.col("tokens")))
    before = F.sum("load").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("load")
    rows = rows.withColumn("stretch", F.floor(before / (STRETCH * budget)).cast("long"))
    rows = rows.withColumn("last", F.max("stretch").over(Window.partitionBy("conv_id")))

    ahead = [F.col("stretch"), *(F.lead("stretch", d).over(w) for d in range(1, history_turns + 1))]
    rows = rows.withColumn("ahead", F.array(*ahead))
    place = lambda stretch, ahead: F.struct(stretch.alias("stretch"), ahead.alias("ahead"))
    later = F.filter(F.transform(F.sequence(F.lit(1), F.lit(history_turns)), lambda d: F.when(F.get("ahead", d) > F.get("ahead", d - 1), F.get("ahead", d))), lambda x: x.isNotNull()) if history_turns else F.array().cast("array<long>")
    everywhere = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda k: place(k, F.lit(False)))
    own = F.concat(F.array(place(F.col("stretch"), F.lit(False))), F.transform(later, lambda k: place(k, F.lit(True))))
    placed = rows.select("conv_id", "n", "role", "text", "tokens", "system", F.explode(F.when(F.col("system"), everywhere).otherwise(own)).alias("p"))
    turn = F.struct("n", "p.ahead", "role", "text", "tokens")
    grouped = placed.groupBy("conv_id", "p.stretch").agg(F.max(F.when(F.col("system"), turn)).alias("system"), F.array_sort(F.collect_list(F.when(~F.col("system"), turn))).alias("turns"))

    grouped = grouped.withColumn("lead", F.filter("turns", lambda t: t["ahead"]))
    windows = _windows(F.col("lead"), F.filter("turns", lambda t: ~t["ahead"]), F.col("system"), budget, history_turns, history_tokens)
    each = grouped.select("*", F.posexplode(windows).alias("k", "w"))
    each = each.select(
        "conv_id", "system", (F.shiftleft("stretch", 32) + F.col("k")).alias("window"), F.col("w.history").alias("history"),
        F.slice("turns", F.size("lead") + F.col("w.at") - F.col("w.history"), F.col("w.history") + F.col("w.size")).alias("turns"),
    )
    top = F.when(F.col("system").isNotNull(), _piece(F.col("system"), F.col("window") > 0)).otherwise("")
    pieces = F.transform("turns", lambda t, i: F.struct(_piece(t, i < F.col("history")).alias("piece"), (F.char_length(escape(t["text"]))).alias("body"), ((t["role"] == "assistant") & (i >= F.col("history"))).alias("target")))
    each = each.select("conv_id", "window", top.alias("top"), pieces.alias("pieces"))
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")

    def step(acc: Column, x: Column) -> Column:
        after = acc["at"] + F.char_length(x["piece"])
        end = after - len(END)
        span = F.array(F.struct((end - x["body"]).alias("start"), end.alias("end")))
        return F.struct(after.alias("at"), F.when(x["target"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    loss = F.aggregate("pieces", F.struct(F.char_length("top").alias("at"), none.alias("loss")), step, lambda acc: acc["loss"])
    return each.select("conv_id", "window", F.concat("top", F.array_join("pieces.piece", "")).alias("formatted"), loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, parsed from ``formatted`` and ``loss`` alone.

    ``(conv_id, turns array<struct<role, text>>, loss_text, formatted_chars)``: repeated turns are left
    out, and loss_text joins the unescaped spans in order.
    """
    written = F.split(F.col("formatted"), END, -1)
    own = F.filter(F.slice(written, F.lit(1), F.size(written) - 1), lambda x: x.startswith("<turn:"))
    turns = F.transform(
        own,
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(7)), ">\n", 1)).alias("role"),
            unescape(F.substring_index(x, ">\n", -1)).alias("text"),
        ),
    )
    target = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    parts = windows.select("conv_id", "window", turns.alias("turns"), F.array_join(target, "").alias("target"), F.char_length("formatted").cast("long").alias("chars"))
    grouped = parts.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "turns", "target"))).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    return grouped.select("conv_id", F.flatten(F.col("w.turns")).alias("turns"), F.array_join(F.col("w.target"), "").alias("loss_text"), "formatted_chars")
