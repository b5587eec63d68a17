"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log holds events of conversations: messages, streamed deltas, edits and regenerations, in sequence.
They are folded into final messages: a message's text is its last full text (message or edit) and the
deltas after it, and a regeneration drops the message that it replaces. Final messages are rendered one
by one; only the finished pieces of a conversation meet, in its one output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import checkpointed

#: Marks of a turn, as FORMAT strings of the template.
TURN, BODY, END = "<|turn|>", "<|body|>\n", "<|end|>\n"
#: Strings that a text must not contain raw; a backslash after their first character makes them harmless,
#: and those that have backslashes there get one more, so that taking one away gives the text back.
ESCAPE, UNESCAPE = r"([<\[])(\\*)(\||/?s>|/?INST\])", r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the final messages of a log.

    events: conv_id, seq, kind (message, delta, edit or regenerate), message (its id), replaces (the id that
    a regeneration replaces, else null), role, text. A message stands where its id first comes up, a
    regeneration where the message it replaces stood first, which may be a regeneration itself. One that
    replaces itself, or what does not come up before it, replaces nothing. Deltas join the text that the last message or
    edit event before them set; an edit sets all of it anew. The role is the first that is not null. Null
    texts are empty; a null conv_id is a conversation. Events with equal seq are ordered by kind and text.
    """
    full = F.col("kind") != "delta"
    order = [F.col("seq"), F.col("kind"), F.col("text")]
    one = W.partitionBy("conv_id", "message").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = events.withColumn("part", F.sum(full.cast("int")).over(one))
    last = F.max("part").over(W.partitionBy("conv_id", "message"))
    kept = rows.withColumn("last", last)
    parts = F.sort_array(F.collect_list(F.when(F.col("part") == F.col("last"), F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))))
    messages = kept.groupBy("conv_id", "message").agg(
        F.min("seq").alias("at"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq"))).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )
    again = events.where("kind = 'regenerate' and replaces is not null and not (replaces <=> message)")
    if again.isEmpty():
        return messages.select("conv_id", "message", "at", "role", "text")
    roots, direct = _roots(events, again)
    stays = messages.join(direct, F.col("conv_id").eqNullSafe(F.col("g_conv")) & (F.col("message") == F.col("g_message")), "left_anti")
    stays = stays.join(roots, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("message") == F.col("r_message")), "left")
    return stays.select("conv_id", "message", F.coalesce("r_at", "at").alias("at"), "role", "text")


def _roots(events: DataFrame, again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(r_conv, r_message, r_at): where the first message of each regeneration's chain stood; (g_conv, g_message): the replaced.

    Chains are followed by doubling, in as many steps as the logarithm of the longest; a link leads to an
    earlier message, so there are no rings.
    """
    firsts = events.groupBy("conv_id", "message").agg(F.min("seq").alias("at"))
    last = again.groupBy("conv_id", "message").agg(F.max("replaces").alias("to"))
    renamed = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    same = lambda x, y, a, b: F.col(f"{x}conv_id").eqNullSafe(F.col(f"{y}conv_id")) & (F.col(f"{x}{a}") == F.col(f"{y}{b}"))
    links = last.join(renamed(firsts, "o"), same("", "o_", "message", "message")).join(renamed(firsts, "t"), same("", "t_", "to", "message"))
    links = checkpointed(links.where("t_at < o_at").select("conv_id", "message", "to", F.col("t_at").alias("at")))
    direct = links.select(F.col("conv_id").alias("g_conv"), F.col("to").alias("g_message")).distinct()
    while True:
        on = links.join(renamed(links, "n"), same("", "n_", "to", "message"), "left")
        on = checkpointed(on.select("conv_id", "message", F.coalesce("n_to", "to").alias("to"), F.coalesce("n_at", "at").alias("at"), F.col("n_to").isNotNull().alias("moved")))
        if on.where("moved").isEmpty():
            return links.select(F.col("conv_id").alias("r_conv"), F.col("message").alias("r_message"), F.col("at").alias("r_at")), direct
        links = on.drop("moved")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss: one row per conversation.

    messages: conv_id, at, role, text. Turns come in the order of at, then role and text. Roles and texts
    are escaped, null ones are empty. loss holds (turn, start, length) in code points of formatted for each
    turn of loss_role: its escaped text. A conversation without rows has no row.
    """
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(TURN), role, F.lit(BODY))
    rows = messages.select("conv_id", "at", F.coalesce("role", F.lit("")).alias("role"), F.concat(head, text, F.lit(END)).alias("piece"), F.char_length(head).cast("long").alias("skip"), F.char_length(text).cast("long").alias("length"))
    rows = rows.withColumn("size", F.char_length("piece").cast("long"))
    order = W.partitionBy("conv_id").orderBy("at", "role", "piece")
    rows = rows.withColumns({"turn": F.row_number().over(order) - 1, "base": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")})
    loss = F.when(F.col("role") == loss_role, F.struct("turn", (F.col("base") + F.col("skip")).alias("start"), "length"))
    pieces = F.sort_array(F.collect_list(F.struct("turn", "piece")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("formatted"), F.sort_array(F.collect_list(loss)).alias("loss"))


def parsed(formatted: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, loss_text: the turns of rendered conversations, read back.

    loss_text is what lies under the loss mask in the turn, unescaped; null where nothing does.
    """
    pieces = F.filter(F.split("formatted", r"(?=<\|turn\|>)"), lambda p: p != "")
    masked = F.map_from_entries(F.transform("loss", lambda m: F.struct(m["turn"], m)))
    sizes = formatted.select("conv_id", F.posexplode(pieces).alias("turn", "piece"), masked.alias("masked"))
    rows = sizes.select("conv_id", "turn", "piece", F.try_element_at("masked", F.col("turn")).alias("mask"), F.char_length("piece").cast("long").alias("size"))
    base = F.sum("size").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    head, tail = F.char_length(F.lit(TURN)), F.char_length(F.lit(END))
    mark = F.locate(BODY, F.col("piece"))
    role = F.substring("piece", head + 1, mark - head - 1)
    start = mark + F.char_length(F.lit(BODY))
    text = F.substring("piece", start, F.char_length("piece") - tail - start + 1)
    rows = rows.withColumn("base", base)
    under = F.substring("piece", (F.col("mask.start") - F.col("base") + 1).cast("int"), F.col("mask.length").cast("int"))
    return rows.select("conv_id", "turn", unescaped(role).alias("role"), unescaped(text).alias("text"), unescaped(under).alias("loss_text"))


def events_of(conversations: DataFrame) -> DataFrame:
    """A log with one message event for each row of conversations (conv_id, turn, role, text).

    Rows that repeat a turn are messages of their own.
    """
    again = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("null")), again).alias("message"), F.lit(None).cast("string").alias("replaces"), "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Rendered conversations of a table of turns; see fold() and render()."""
    return render(fold(events_of(conversations)))
