"""Chat formatting in budgeted windows, with built-in functions only.

The turns of a conversation get prefix sums of their tokens; greedy, turn-aligned spans fill the
budget that the system turn and the repeated history leave.  Every window holds the system turn,
as much history before its span as fits ``history`` tokens, and its span.  Only assistant turns of
the span are under the loss mask, so a repeated target is never trained on twice.

Texts are escaped so that no marker of the template occurs inside them; the escape has an inverse.

Defined results: null texts and roles are empty; turns are ordered by turn (nulls first), then role,
then text, so ties and repeated rows have one order and repeated rows stay; rows with a null id form
one conversation; a turn larger than the span budget is a window of its own with ``over_budget``
set, never cut; an empty table gives no windows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template.  OPEN role SEP text CLOSE.
OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


def escape(text: Column) -> Column:
    """Replace the characters that begin markers; the backslash first."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: the backslash last, so no replacement sees another's output."""
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def count_tokens(formatted: Column) -> Column:
    """Default size of a turn: a token for every four bytes begun."""
    return F.ceil(F.octet_length(formatted) / F.lit(4.0)).cast("long")


def _spans(turns: Column, room: Column) -> Column:
    """First turns (0-based) of the greedy spans over the prefix sums."""

    def step(acc: Column, turn: Column) -> Column:
        fits = (turn["_after"] - acc["base"] <= room) & (F.size(acc["starts"]) > 0)
        return F.struct(
            F.when(fits, acc["starts"])
            .otherwise(F.concat(acc["starts"], F.array(acc["i"])))
            .alias("starts"),
            F.when(fits, acc["base"]).otherwise(turn["_after"] - turn["_tokens"]).alias("base"),
            (acc["i"] + 1).alias("i"),
        )

    begin = F.struct(
        F.array().cast("array<int>").alias("starts"),
        F.lit(0).cast("long").alias("base"),
        F.lit(0).alias("i"),
    )
    return F.aggregate(turns, begin, step)["starts"]


def chat_windows(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = 1024,
    history: int = 256,
    tokens=count_tokens,
) -> DataFrame:
    """One row per window.

    Columns: the id, ``window`` (from 0), ``n_repeated`` (turns at the front that are the system turn
    or history), ``n_turns`` (new turns), ``text``, ``loss`` (array of start, length in code points of
    ``text``), ``n_tokens``, ``over_budget``.  One exchange, on the id.
    """
    rows = df.select(
        F.col(conv).alias("_conv"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    head = F.concat(F.lit(OPEN), escape(F.col("_role")), F.lit(SEP))
    rows = rows.withColumn("_head", head).withColumn("_body", escape(F.col("_text")))
    rows = rows.withColumn(
        "_tokens", F.greatest(F.lit(1).cast("long"), tokens(F.concat("_head", "_body", F.lit(CLOSE))))
    )
    order = Window.partitionBy("_conv").orderBy(F.asc_nulls_first("_turn"), "_role", "_text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_after", F.sum("_tokens").over(running))
    # The prefix sums rise strictly, so they also carry the order into the array.
    turns = rows.groupBy("_conv").agg(
        F.sort_array(
            F.collect_list(F.struct("_after", "_tokens", "_role", "_head", "_body"))
        ).alias("_all")
    )
    first = F.col("_all")[0]
    turns = turns.withColumn("_has_system", first["_role"] == "system")
    turns = turns.withColumn(
        "_rest",
        F.when(F.col("_has_system"), F.slice("_all", F.lit(2), F.size("_all"))).otherwise(
            F.col("_all")
        ),
    )
    system_tokens = F.when(F.col("_has_system"), first["_tokens"]).otherwise(F.lit(0))
    turns = turns.withColumn("_room", F.greatest(F.lit(1), budget - history - system_tokens))
    turns = turns.withColumn("_starts", _spans(F.col("_rest"), F.col("_room")))
    # A conversation of a system turn alone still has one window, with an empty span.
    turns = turns.withColumn(
        "_starts",
        F.when(F.size("_starts") == 0, F.array(F.lit(0))).otherwise(F.col("_starts")),
    )
    windows = turns.select("*", F.posexplode("_starts").alias("window", "_from"))
    windows = windows.withColumn(
        "_to", F.coalesce(F.get("_starts", F.col("window") + 1), F.size("_rest"))
    )
    start = F.get("_rest", F.col("_from"))
    windows = windows.withColumn("_begins", start["_after"] - start["_tokens"])
    windows = windows.withColumn(
        "_back",
        F.size(
            F.filter(
                F.slice("_rest", F.lit(1), F.col("_from")),
                lambda t: F.col("_begins") - t["_after"] + t["_tokens"] <= history,
            )
        ),
    )
    lead = F.when(
        F.col("_has_system") & (F.col("window") > 0), F.array(F.col("_all")[0])
    ).otherwise(F.slice("_all", F.lit(1), F.lit(0)))
    new_system = F.when(
        F.col("_has_system") & (F.col("window") == 0), F.array(F.col("_all")[0])
    ).otherwise(F.slice("_all", F.lit(1), F.lit(0)))
    past = F.slice("_rest", F.col("_from") - F.col("_back") + 1, F.col("_back"))
    span = F.slice("_rest", F.col("_from") + 1, F.col("_to") - F.col("_from"))
    windows = windows.withColumn("_old", F.concat(lead, past))
    windows = windows.withColumn("_new", F.concat(new_system, span))

    def written(turn_array: str) -> Column:
        return F.array_join(
            F.transform(turn_array, lambda t: F.concat(t["_head"], t["_body"], F.lit(CLOSE))), ""
        )

    windows = windows.withColumn("_before", written("_old"))
    begin = F.struct(
        (F.length("_before") + 1).alias("at"),
        F.array().cast("array<struct<start:int,length:int>>").alias("loss"),
    )

    def mark(acc: Column, t: Column) -> Column:
        at = acc["at"] + F.length(t["_head"])
        length = F.length(t["_body"])
        one = F.array(F.struct(at.alias("start"), length.alias("length")))
        return F.struct(
            (at + length + len(CLOSE)).alias("at"),
            F.when(t["_role"] == "assistant", F.concat(acc["loss"], one))
            .otherwise(acc["loss"])
            .alias("loss"),
        )

    size = F.aggregate(
        F.concat("_old", "_new"), F.lit(0).cast("long"), lambda acc, t: acc + t["_tokens"]
    )
    return windows.select(
        F.col("_conv").alias(conv),
        F.col("window"),
        F.size("_old").alias("n_repeated"),
        F.size("_new").alias("n_turns"),
        F.concat("_before", written("_new")).alias("text"),
        F.aggregate("_new", begin, mark)["loss"].alias("loss"),
        size.alias("n_tokens"),
        (size > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Conversations from the windows' text and loss mask.

    Columns: the id, ``turns`` (array of role, text, in order), ``targets`` (texts under the mask, in
    order), ``formatted_chars``, ``n_windows``.
    """
    pieces = F.split("text", CLOSE)
    new = F.slice(pieces, F.col("n_repeated") + 1, F.col("n_turns"))
    parsed = F.transform(
        new,
        lambda piece: F.struct(
            unescape(
                F.substring_index(F.substr(piece, F.lit(len(OPEN) + 1)), SEP, 1)
            ).alias("role"),
            unescape(
                F.substr(piece, F.instr(piece, SEP) + len(SEP))
            ).alias("text"),
        ),
    )
    targets = F.transform(
        "loss", lambda x: unescape(F.substr(F.col("text"), x["start"], x["length"]))
    )
    rows = windows.select(
        conv,
        F.struct("window", parsed.alias("turns"), targets.alias("targets")).alias("_part"),
        F.length("text").alias("_chars"),
    )
    grouped = rows.groupBy(conv).agg(
        F.sort_array(F.collect_list("_part")).alias("_parts"),
        F.sum("_chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    return grouped.select(
        conv,
        F.flatten(F.transform("_parts", lambda p: p["turns"])).alias("turns"),
        F.flatten(F.transform("_parts", lambda p: p["targets"])).alias("targets"),
        "formatted_chars",
        "n_windows",
    )


def digest(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digest columns of what :func:`read_back` returns."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("targets", "")
    return conversations.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )
