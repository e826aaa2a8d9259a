"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut at turns into windows of at most ``budget`` tokens. Prefix sums of
the turns' tokens decide where a window ends. Each window starts with the system turn
(the first turn, if its role is ``system``); each but the first then repeats up to
``history_turns`` turns before it, as far as they fit in ``history_tokens``. The loss mask
covers the texts of assistant turns where they stand for the first time; what is repeated
is never a target. A turn that alone exceeds the budget has a window of its own.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so a control string inside a text can't be taken for
markup, and ``parse_windows`` gets back every turn.

Defined results: a null role or text is empty; turns are ordered by (turn, role, text),
nulls first, so that ties and repeated rows keep one order; a null conversation id is one
conversation; only the four named columns are read, whatever else the table holds; an
empty table gives no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS, TURN_TOKENS = 1024, 2, 192, 4


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # A line feed is "\n" behind an even number of backslashes.
    lines = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*+)\\n", "$1\n")
    return unescape(lines)


def count_tokens(text: Column) -> Column:
    """Words and punctuation marks, and the marks around a turn: a stand-in that needs no tokenizer."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + F.lit(TURN_TOKENS)


def chat_windows(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """One row per window: conv id, window_id, n_new and n_repeated turns, n_tokens,
    formatted text and ``loss`` (array of start, end in code points of ``formatted``).

    One shuffle, by conversation; a task holds one conversation at a time, which the
    digest of a conversation needs anyway. The prefix sums share that partitioning.
    """
    turns = df.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    turns = turns.select(
        "conv",
        "turn",
        "role",
        "text",
        count_tokens(F.col("text")).alias("tokens"),
        F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    piece = F.concat("head", "body", F.lit(END), F.lit("\n"))
    width = F.char_length("head") + F.char_length("body") + F.lit(len(END) + 1)
    turns = turns.select(
        "conv",
        F.row_number().over(order).alias("pos"),
        F.sum("tokens").over(upto).alias("tokens_upto"),
        F.sum(width).over(upto).alias("chars_upto"),
        F.col("role"),
        piece.alias("piece"),
        F.char_length("head").alias("head_chars"),
        F.char_length("body").alias("body_chars"),
        F.col("tokens").cast("bigint").alias("tokens"),
    )
    convs = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(*[c for c in turns.columns if c != "conv"]))).alias("t"))
    first = F.col("t")[0]
    has_system = first["role"] == "system"
    convs = convs.select(
        "conv",
        "t",
        F.when(has_system, 1).otherwise(0).alias("n_sys"),
        F.when(has_system, first["tokens"]).otherwise(0).cast("bigint").alias("sys_tokens"),
    )

    def turn_at(i: Column) -> Column:  # 1-based
        return F.element_at("t", i.cast("int"))

    def tokens_between(after: Column, to: Column) -> Column:
        return turn_at(to)["tokens_upto"] - F.when(after > 0, turn_at(F.greatest(after, F.lit(1)))["tokens_upto"]).otherwise(0)

    def history_of(at: Column) -> Column:
        """How many turns before turn ``at`` fit in the history."""
        chosen = F.lit(0)
        for n in range(1, history_turns + 1):
            fits = (at - 1 - n >= F.col("n_sys")) & (tokens_between(F.greatest(at - 1 - n, F.lit(0)), F.greatest(at - 1, F.lit(1))) <= history_tokens)
            chosen = F.when(fits, F.lit(n)).otherwise(chosen)
        return chosen

    # A window is (first new turn, last new turn, repeated turns, prefix sum it starts from).
    window_type = "array<struct<first:int,last:int,hist:int,base:bigint>>"

    def add_turn(acc: Column, turn: Column) -> Column:
        last = F.element_at(acc, -1)
        room = turn["tokens_upto"] - last["base"] <= budget
        opened = F.struct(
            turn["pos"].alias("first"),
            turn["pos"].alias("last"),
            history_of(turn["pos"]).alias("hist"),
            # What is repeated counts too: the prefix sum goes back by its tokens.
            (
                turn["tokens_upto"]
                - turn["tokens"]
                - F.col("sys_tokens")
                - F.when(
                    history_of(turn["pos"]) > 0,
                    tokens_between(F.greatest(turn["pos"] - 1 - history_of(turn["pos"]), F.lit(0)), F.greatest(turn["pos"] - 1, F.lit(1))),
                ).otherwise(0)
            ).alias("base"),
        )
        grown = F.struct(last["first"].alias("first"), turn["pos"].alias("last"), last["hist"].alias("hist"), last["base"].alias("base"))
        return F.when(room, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(opened)))

    start = F.array(F.struct(F.lit(1).alias("first"), F.lit(1).alias("last"), F.lit(0).alias("hist"), F.lit(0).cast("bigint").alias("base"))).cast(window_type)
    convs = convs.withColumn("w", F.aggregate(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), start, lambda acc, t: add_turn(acc, t).cast(window_type)))

    def build(w: Column, i: Column) -> Column:
        system = F.when(w["first"] > 1, F.col("n_sys")).otherwise(0)
        new = F.slice("t", w["first"], w["last"] - w["first"] + 1)
        old = F.concat(F.slice("t", 1, system), F.slice("t", w["first"] - w["hist"], w["hist"]))
        old_chars = F.aggregate(old, F.lit(0).cast("bigint"), lambda a, t: a + F.char_length(t["piece"]))
        chars_before = F.when(w["first"] > 1, turn_at(F.greatest(w["first"] - 1, F.lit(1)))["chars_upto"]).otherwise(0)
        loss = F.transform(
            F.filter(new, lambda t: t["role"] == "assistant"),
            lambda t: F.struct(
                (old_chars + t["chars_upto"] - chars_before - t["body_chars"] - F.lit(len(END) + 1)).cast("bigint").alias("start"),
                (old_chars + t["chars_upto"] - chars_before - F.lit(len(END) + 1)).cast("bigint").alias("end"),
            ),
        )
        return F.struct(
            i.alias("window_id"),
            F.size(new).alias("n_new"),
            F.size(old).alias("n_repeated"),
            (turn_at(w["last"])["tokens_upto"] - w["base"]).alias("n_tokens"),
            F.concat(F.array_join(F.transform(old, lambda t: t["piece"]), ""), F.array_join(F.transform(new, lambda t: t["piece"]), "")).alias("formatted"),
            loss.alias("loss"),
        )

    return convs.select(F.col("conv").alias(conv_col), F.inline(F.transform("w", build)))


def parse_windows(windows: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text of the turns that are new here) and ``loss_text``
    (unescaped text under the mask), both read from ``formatted`` alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.greatest(F.size(F.split("formatted", r"<\|im_start\|>")) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        from_text = F.char_length(head) + 2
        text = F.substr(piece, from_text, F.char_length(piece) - from_text - F.lit(len(END)))
        return F.struct(_unescape_role(head).alias("role"), unescape(text).alias("text"))

    new = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - F.col("n_repeated"), F.lit(0)))
    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.withColumns({"turns": F.transform(new, turn), "loss_text": F.array_join(masked, "")})


def conversation_digests(parsed: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Counts and digests per conversation, its windows in order."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = parsed.select(
        conv_col,
        F.struct("window_id", whole.alias("turns"), "loss_text", F.size("turns").cast("bigint").alias("n"), F.char_length("formatted").cast("bigint").alias("chars")).alias("w"),
    )
    convs = rows.groupBy(conv_col).agg(F.array_sort(F.collect_list("w")).alias("w"))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("w", lambda w: w[field]), "")

    def total(field: str) -> Column:
        return F.aggregate("w", F.lit(0).cast("bigint"), lambda a, w: a + w[field])

    return convs.select(
        conv_col,
        total("n").alias("n_turns"),
        F.sha2(F.encode(joined("turns"), "UTF-8"), 256).alias("turns_sha256"),
        F.char_length(joined("loss_text")).cast("bigint").alias("loss_chars"),
        F.sha2(F.encode(joined("loss_text"), "UTF-8"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )
