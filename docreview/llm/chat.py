"""Chat formatting: conversations as training texts in windows of a token budget.

Prefix sums of the turns' tokens choose spans of whole turns. A window is the system turn, a limited
history that it repeats, and its new turns; only the new assistant texts are under the loss mask, so
no target is learned twice. Everything is column expressions; no Python runs in the tasks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.llm.common import WORD, text_or_empty

START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM, ASSISTANT = "system", "assistant"
#: Tokens of a window, and of these for repeated turns; turns that are repeated at most.
BUDGET = 1024
HISTORY_TOKENS = 256
HISTORY_TURNS = 4
#: Tokens of a turn besides its words: the marks and the role.
TURN_TOKENS = 4
#: A conversation is cut at multiples of so many turn numbers, and no task holds more turns at once.
PART = 128


def escape(text: Column) -> Column:
    r"""The text without `<|`: a backslash more stands in each `<`, backslashes, `|`."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """The role on one line and without `<`."""
    for plain, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def turn_blocks(conversations: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(conv_id, part, block, turns, system, leads): at most PART turns in order.

    `turns` has (n, role, text, tokens) with role and text escaped, `system` is the conversation's
    first turn if its role is `system`, `leads` says that it is the first of `turns`. Texts are
    shuffled once, by (conv_id, part). A conversation of several parts gets a first row in each
    further one, which carries its system turn there."""
    words = F.regexp_count(text_or_empty(), F.lit(WORD)) + TURN_TOKENS
    rows = conversations.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"),
        text_or_empty("role").alias("role"), text_or_empty().alias("text"),
        (words if tokens is None else tokens).cast("long").alias("tokens"),
        # null comes first
        F.coalesce(F.floor(F.col("turn") / PART).cast("long"), F.lit(-(2**62))).alias("part"),
    )
    spans = rows.groupBy("conv_id").agg(
        F.min("part").alias("_first"), F.max("part").alias("_last"),
        F.min(F.struct("turn", "role")).alias("_head"),
    ).where("_first < _last").withColumnRenamed("conv_id", "_conv")
    heads = rows.where(F.col("role") == SYSTEM).join(
        spans.where(F.col("_head.role") == SYSTEM),
        F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_head.turn")),
    ).groupBy("conv_id").agg(F.min(F.struct("text", "tokens")).alias("_system"))
    further = rows.select("conv_id", "part").distinct().join(
        spans, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") > F.col("_first"))
    ).select("conv_id", "part")
    carried = further.join(
        heads.withColumnRenamed("conv_id", "_of"), F.col("conv_id").eqNullSafe(F.col("_of")), "left"
    ).select(
        "conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("_system").isNotNull(), F.lit(SYSTEM)).alias("role"),
        F.col("_system.text").alias("text"), F.col("_system.tokens").alias("tokens"),
        "part", F.lit(True).alias("carried"),
    )
    order = Window.partitionBy("conv_id", "part").orderBy(
        F.desc("carried"), F.asc_nulls_first("turn"), "role", "text"
    )
    first = F.struct("role", "text", "tokens", "carried")
    numbered = (
        rows.withColumn("carried", F.lit(False)).unionByName(carried)
        .withColumns({"n": F.row_number().over(order), "_first": F.first(first).over(order)})
        .where("NOT carried")
        .withColumn("n", F.col("n") - F.col("_first.carried").cast("int"))
        .withColumn("block", F.floor((F.col("n") - 1) / PART).cast("int"))
    )
    escaped = F.struct(
        "n", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), "tokens"
    )
    head = F.struct(F.lit(0).alias("n"), "_first.role", escape(F.col("_first.text")).alias("text"), "_first.tokens")
    return numbered.groupBy("conv_id", "part", "block").agg(
        F.sort_array(F.collect_list(escaped)).alias("turns"), F.min("_first").alias("_first"), F.min("n").alias("_n")
    ).select(
        "conv_id", "part", "block", "turns",
        F.when(F.col("_first.role") == SYSTEM, head).alias("system"),
        ((F.col("_first.role") == SYSTEM) & ~F.col("_first.carried") & (F.col("_n") == 1)).alias("leads"),
    )


def spans_of(sums: Column, room: Column, history_turns: int, history_tokens: int) -> Column:
    """The windows' (first, back) over turns with these prefix sums (0 first): the number of the
    first new turn, from 1, and how many turns before it are repeated.

    A turn joins the window while it fits into `room`. Else a window starts with it, after as many
    of the turns before it as fit beside it and into the history's limits. A turn that is too long
    for any window has one of its own."""
    one = F.lit(1)
    size = lambda i: F.element_at(sums, i + 1) - F.element_at(sums, i)

    def back(i: Column) -> Column:
        limit = F.least(F.lit(history_tokens), room - size(i))
        near = F.filter(
            F.sequence(F.greatest(one, i - history_turns), i - 1),
            lambda j: F.element_at(sums, i) - F.element_at(sums, j) <= limit,
        )
        return F.when(i > 1, F.size(near)).otherwise(0) if history_turns > 0 else F.lit(0)

    def step(state: Column, i: Column) -> Column:
        fits = (F.size(state["spans"]) > 0) & (state["used"] + size(i) <= room)
        opened = F.struct(i.alias("first"), back(i).alias("back"))
        return F.struct(
            F.when(fits, state["spans"]).otherwise(F.concat(state["spans"], F.array(opened))).alias("spans"),
            F.when(fits, state["used"] + size(i))
            .otherwise(F.element_at(sums, i + 1) - F.element_at(sums, i - opened["back"])).alias("used"),
        )

    none = F.array().cast("array<struct<first:int,back:int>>")
    turns = F.sequence(one, F.size(sums) - 1)
    folded = F.aggregate(turns, F.struct(none.alias("spans"), F.lit(0).cast("long").alias("used")), step)
    # a conversation of nothing but its system turn has one window without new turns
    alone = F.array(F.struct(one.alias("first"), F.lit(0).alias("back")))
    return F.when(F.size(sums) > 1, folded["spans"]).otherwise(alone)


def format_windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    tokens: Column | None = None,
) -> DataFrame:
    """Windows: conv_id, part, block, window (their order), text, loss, n_turns, n_repeated, tokens.

    `text` is `<|im_start|>role`, a line end, the text and `<|im_end|>` with a line end for every
    turn; texts have no `<|` of their own, see `escape`. `loss` lists (start, length) in code points
    of the new assistant texts. The first `n_repeated` of the `n_turns` turns stand in earlier
    windows already: the system turn, then history. `tokens` is at most `budget`, except where one
    turn with the system turn is longer. Turns have TURN_TOKENS and a token a word, or `tokens`.

    Turns are ordered by turn, null first, then role and text; repeated rows are turns of their own.
    A null role or text is empty; rows with a null conv_id are one conversation. Every
    conversation starts anew at multiples of PART turn numbers, and after PART rows between two of
    them: the system turn is carried there, history is not. Columns other than conv_id, turn,
    role, text are not read. An empty table gives no rows.

    Texts are shuffled once, by conversation and part. Nothing holds more than PART turns."""
    blocks = turn_blocks(conversations, tokens)
    body = F.when(F.col("leads"), F.slice("turns", F.lit(2), F.size("turns"))).otherwise(F.col("turns"))
    sums = F.aggregate(
        "_body", F.array(F.lit(0).cast("long")), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t["tokens"]))
    )
    room = F.lit(budget) - F.coalesce(F.col("system.tokens"), F.lit(0))
    spans = blocks.withColumn("_body", body).withColumn("_sums", sums).withColumn("_room", room).withColumn(
        "_spans", spans_of(F.col("_sums"), F.col("_room"), history_turns, history_tokens)
    )
    windows = spans.select(
        "conv_id", "part", "block", "_body", "_sums", "system", "leads",
        F.posexplode(F.transform("_spans", lambda s, k: F.struct(
            s["first"].alias("first"), s["back"].alias("back"),
            F.coalesce(F.get("_spans", k + 1)["first"], F.size("_sums")).alias("next"),
        ))).alias("window", "_span"),
    )
    first, back, after = F.col("_span.first"), F.col("_span.back"), F.col("_span.next")
    headed = F.col("system").isNotNull()
    shown = F.concat(
        F.when(headed, F.array("system")).otherwise(F.array().cast(blocks.schema["turns"].dataType)),
        F.slice("_body", first - back, after - first + back),
    )
    repeated = back + F.when(headed & ~(F.col("leads") & (F.col("window") == 0)), 1).otherwise(0)
    turns = windows.select(
        "conv_id", "part", "block", "window", shown.alias("_turns"), repeated.cast("int").alias("n_repeated"),
        (F.element_at("_sums", after) - F.element_at("_sums", first - back)
         + F.coalesce(F.col("system.tokens"), F.lit(0))).alias("tokens"),
    )
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"))
    extents = F.transform("_turns", lambda t, k: F.struct(
        F.char_length(head(t)).alias("head"), F.char_length(t["text"]).alias("body"),
        ((t["role"] == ASSISTANT) & (k >= F.col("n_repeated"))).alias("target"),
    ))

    def mark(state: Column, x: Column) -> Column:
        span = F.struct((state["at"] + x["head"]).alias("start"), x["body"].alias("length"))
        return F.struct(
            (state["at"] + x["head"] + x["body"] + len(END)).alias("at"),
            F.when(x["target"], F.concat(state["loss"], F.array(span))).otherwise(state["loss"]).alias("loss"),
        )

    unmarked = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")
    )
    return turns.withColumn("_extents", extents).select(
        "conv_id", "part", "block", "window",
        F.array_join(F.transform("_turns", lambda t: F.concat(head(t), t["text"], F.lit(END))), "").alias("text"),
        F.aggregate("_extents", unmarked, mark)["loss"].alias("loss"),
        F.size("_turns").alias("n_turns"), "n_repeated", "tokens",
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """The windows of `format_windows` read back: conv_id, part, block, window, n_chars, turns, targets.

    `turns` has (role, text) of the new turns, `targets` the texts under the loss mask, both
    unescaped; they are read from `text`, `loss` and `n_repeated` only."""
    pieces = F.split("text", END.replace("|", r"\|"))
    plain = F.transform(
        F.slice("_pieces", F.col("n_repeated") + 1, F.size("_pieces") - 1 - F.col("n_repeated")),
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text"),
        ),
    )
    targets = F.transform("loss", lambda s: unescape(F.substr("text", s["start"] + 1, s["length"])))
    return windows.withColumn("_pieces", pieces).select(
        "conv_id", "part", "block", "window", F.char_length("text").cast("long").alias("n_chars"),
        plain.alias("turns"), targets.alias("targets"),
    )


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. A digest reads its conversation as one value."""
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    parts = read_windows(windows).select(
        "conv_id", F.size("turns").alias("_n"), "n_chars",
        F.struct(
            "part", "block", "window", F.array_join(spoken, "").alias("turns"),
            F.array_join("targets", "").alias("loss"),
        ).alias("_part"),
    )
    joined = lambda name: F.array_join(F.transform("_parts", lambda p: p[name]), "")
    return (
        parts.groupBy("conv_id")
        .agg(
            F.sum("_n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"),
            F.sort_array(F.collect_list("_part")).alias("_parts"),
        )
        .withColumns({"_turns": joined("turns"), "_loss": joined("loss")})
        .select(
            "conv_id", "n_turns", F.sha2("_turns", 256).alias("turns_sha256"),
            F.char_length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars",
        )
    )
