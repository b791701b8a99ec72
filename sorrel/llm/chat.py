"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs, sorted, adjacent turns of one
role merged into one message, and messages concatenated::

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

Control strings inside a text are made harmless and can be restored: ``<``,
any number of backslashes and ``|`` gets one more backslash.  So ``<|`` stands
only where the template put it.  Roles are percent-encoded.

Turns are sorted by turn number (null first), then role, then text; repeated
rows are turns of their own.  Null roles and texts count as empty, an empty
table gives no row, and rows with a null conversation id form one conversation.

Turns are collected by piece: ``piece_turns`` consecutive rows of a conversation.
Almost every conversation is one piece.  Larger ones are ranked by a range sort
and formatted piece by piece in several tasks.  A piece that goes on in the role
of the one before starts with a separator instead of a header, and the other
ends open, so the formatted conversation is its pieces' texts in order, the same
wherever the borders are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sorrel.plans.staging import rank_within, small_side, stage

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
PIECE_TURNS = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_pieces(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
    piece_turns: int = PIECE_TURNS,
) -> DataFrame:
    """``(conv, piece, split, head, formatted, loss)``: the pieces of every conversation.

    ``split`` tells whether the conversation has several pieces.  ``head`` is the
    encoded role in which the piece goes on, null if it starts with a header.  ``loss`` lists
    the spans ``(start, end)`` of ``formatted`` that count for the loss: code
    points, end exclusive, one span for every text of ``loss_role``.
    """
    turns = rows.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.url_encode(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    several = turns.groupBy("conv").count().filter(F.col("count") > piece_turns)
    several = stage(several.select(F.col("conv").alias("long_conv"), F.lit(True).alias("long")), "several")
    tagged = turns.join(small_side(several), F.col("conv").eqNullSafe(F.col("long_conv")), "left")
    tagged = tagged.withColumn("split", F.coalesce("long", F.lit(False))).select("conv", "split", "t")
    placed = tagged.filter("not split").withColumn("piece", F.lit(0).cast("long"))
    if not several.isEmpty():
        # A join never meets a null id, so the rows are ranked by a key; equal rows are parted by their place.
        key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
        keyed = tagged.filter("split").withColumns({"key": key, "place": F.monotonically_increasing_id()})
        ranked = rank_within(keyed, ["key"], [F.col("t").asc(), F.col("place").asc()])
        ranked = ranked.withColumn("piece", F.floor((F.col("rank") - 1) / piece_turns))
        last = F.col("rank") % piece_turns == 0
        first = (F.col("rank") - 1) % piece_turns == 0
        before = ranked.filter(last).select("conv", (F.col("piece") + 1).alias("piece"), F.col("t.role").alias("before"))
        after = ranked.filter(first).select("conv", (F.col("piece") - 1).alias("piece"), F.col("t.role").alias("after"))
        borders = before.unionByName(after, allowMissingColumns=True)
        placed = placed.unionByName(ranked.select("conv", "split", "t", "piece")).unionByName(
            borders.withColumn("split", F.lit(True)), allowMissingColumns=True
        )
    else:
        placed = placed.withColumns({"before": F.lit(None).cast("string"), "after": F.lit(None).cast("string")})
    sorted_turns = (
        placed.groupBy("conv", "piece", "split")
        .agg(F.sort_array(F.collect_list("t")).alias("t"), F.max("before").alias("before"), F.max("after").alias("after"))
        .filter(F.size("t") > 0)
    )
    joined = sorted_turns.withColumns(
        {
            "head": F.when(F.col("before") == F.get("t", F.lit(0))["role"], F.col("before")),
            "open": F.coalesce(F.col("after") == F.get("t", F.size("t") - 1)["role"], F.lit(False)),
        }
    )
    return _rendered(joined, F.url_encode(F.lit(loss_role))).select(
        F.col("conv").alias(conv), "piece", "split", "head", "formatted", "loss"
    )


def _rendered(pieces: DataFrame, loss_role: Column) -> DataFrame:
    """``formatted`` and ``loss`` of sorted turns ``t``, which go on from ``head`` and end ``open``."""
    first = F.filter(
        F.sequence(F.lit(0), F.size("t") - 1),
        lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]),
    )
    starts = pieces.withColumn("starts", first)

    def message(s: Column, j: Column) -> Column:
        n = F.coalesce(F.get("starts", j + 1), F.size("t")) - s
        return F.struct(F.get("t", s)["role"].alias("role"), F.transform(F.slice("t", s + 1, n), lambda x: x["text"]).alias("texts"))

    merged = starts.withColumn("messages", F.transform("starts", message))

    def spans(state: Column, m: Column) -> Column:
        # Texts of one message follow each other with a separator between.
        goes_on = (state["at"] == 0) & F.col("head").isNotNull()
        at = state["at"] + F.when(goes_on, F.lit(len(SEP))).otherwise(F.length(m["role"]) + len(START) + 1)
        ends = F.aggregate(
            m["texts"],
            F.struct(at.cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out")),
            lambda s, x: F.struct(
                (s["at"] + F.length(x) + len(SEP)).cast("long").alias("at"),
                F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(x)).cast("long").alias("end")))).alias("out"),
            ),
        )
        return F.struct(
            (ends["at"] - len(SEP) + len(END)).cast("long").alias("at"),
            F.when(m["role"] == loss_role, F.concat(state["out"], ends["out"])).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))

    def written(m: Column, i: Column) -> Column:
        header = F.when((i == 0) & F.col("head").isNotNull(), F.lit(SEP)).otherwise(F.concat(F.lit(START), m["role"], F.lit("\n")))
        end = F.when(F.col("open") & (i == F.size("messages") - 1), F.lit("")).otherwise(F.lit(END))
        return F.concat(header, F.array_join(m["texts"], SEP), end)

    return merged.select("*", F.array_join(F.transform("messages", written), "").alias("formatted"), F.aggregate("messages", start, spans)["out"].alias("loss"))


def read_back(formatted: Column) -> Column:
    """``array<struct<role, text>>``: the turns that a formatted text was made of."""
    messages = F.split(formatted, r"<\|im_end\|>\n")

    def turns(m: Column) -> Column:
        role = F.url_decode(F.substring_index(F.substr(m, F.lit(len(START) + 1)), "\n", 1))
        body = F.substr(m, F.lit(len(START) + 1) + F.length(F.substring_index(F.substr(m, F.lit(len(START) + 1)), "\n", 1)) + 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.slice(messages, 1, F.size(messages) - 1), turns))


def whole_messages(formatted: Column, head: Column) -> Column:
    """A piece with the header and the end that it shares with its neighbours."""
    rest = F.substr(formatted, F.lit(len(SEP) + 1))
    begun = F.when(head.isNull(), formatted).otherwise(F.concat(F.lit(START), head, F.lit("\n"), rest))
    return F.when(F.endswith(begun, F.lit(END)), begun).otherwise(F.concat(begun, F.lit(END)))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversations_read_back(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``(conv, n_turns, turns, masked, formatted_chars)`` of every conversation.

    Only conversations of several pieces are brought together by another shuffle.
    """
    read = pieces.withColumn("_back", read_back(whole_messages(F.col("formatted"), F.col("head")))).select(
        conv, "piece", "split",
        F.size("_back").cast("long").alias("n_turns"),
        F.array_join(F.transform("_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        masked_text(F.col("formatted"), F.col("loss")).alias("masked"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    parts = read.filter("split").groupBy(conv).agg(
        F.sum("n_turns").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("piece", "turns", "masked"))).alias("parts"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    joined = parts.select(
        conv, "n_turns",
        F.array_join(F.transform("parts", lambda p: p["turns"]), "").alias("turns"),
        F.array_join(F.transform("parts", lambda p: p["masked"]), "").alias("masked"),
        "formatted_chars",
    )
    return read.filter("not split").drop("piece", "split").unionByName(joined)
