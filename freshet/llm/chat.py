"""Chat formatting with Spark expressions only.

A conversation becomes a row of blocks, one for each run of turns of the same role:

    [INST]role[/INST]text<s>text ... </s>

``<s>`` stands between the merged turns. A backslash in a role or text is doubled, and one is put
after the first character of each control string found there, so the blocks can be read back.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.
OPEN, CLOSE, NEXT, END = "[INST]", "[/INST]", "<s>", "</s>"
CONTROL = (OPEN, CLOSE, NEXT, END)
TRAINED = "assistant"


def escape(text):
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text):
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark[0] + "\\" + mark[1:]), F.lit(mark))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def format_chat(rows: DataFrame, conv="conv_id", turn="turn", role="role", text="text", trained=TRAINED):
    """One row per conversation: conv_id, formatted, segments.

    segments is an array of (text, loss) whose texts, joined, are ``formatted``; loss marks what
    a model should learn, the texts of role ``trained``. Turns are ordered by turn (null first),
    then role and text, so repeated rows and ties have one order, and each row is a turn. A null
    role or text is empty; a null conv_id is a conversation like any other. An empty table gives
    an empty one; other columns are ignored, whatever their names.

    One shuffle, by conversation. Only a conversation's own output gathers it in one row.
    """
    turns = rows.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select(
        "conv_id", F.row_number().over(order).alias("n"), "role", escape(F.col("text")).alias("text")
    )
    collected = numbered.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "role", "text"))).alias("turns")
    )
    opened = F.transform(
        "turns",
        lambda t, k: F.struct(
            t["role"].alias("role"),
            t["text"].alias("text"),
            (k > 0).alias("later"),
            ((k > 0) & (F.col("turns")[F.greatest(k - 1, F.lit(0))]["role"] == t["role"])).alias("same"),
        ),
    )

    def parts(t):
        head = F.concat(
            F.when(t["later"], END).otherwise(""), F.lit(OPEN), escape(t["role"]), F.lit(CLOSE)
        )
        mark = F.when(t["same"], F.lit(NEXT)).otherwise(head)
        return F.array(
            F.struct(mark.alias("text"), F.lit(False).alias("loss")),
            F.struct(t["text"].alias("text"), (t["role"] == trained).alias("loss")),
        )

    closing = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(F.flatten(F.transform("opened", parts)), closing)
    return (
        collected.select("conv_id", opened.alias("opened"))
        .select("conv_id", segments.alias("segments"))
        .select(
            "conv_id",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            "segments",
        )
    )


def parse_chat(formatted):
    """The turns, as an array of (role, text), of a column that ``format_chat`` made."""
    body = F.substring(formatted, F.lit(1), F.char_length(formatted) - len(END))
    blocks = F.split(body, F.lit("</s>"))

    def turns(block):
        at = F.instr(block, CLOSE)
        role = unescape(F.substring(block, F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        texts = F.substring(block, at + len(CLOSE), F.char_length(block))
        return F.transform(
            F.split(texts, F.lit("<s>")),
            lambda t: F.struct(role.alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the output alone.

    Columns: conv_id, n_turns, turns_sha256 (of role, newline, text, newline per turn),
    loss_chars and loss_sha256 (code points and digest of the unescaped text under the mask),
    formatted_chars.
    """
    turns = parse_chat(F.col("formatted"))
    learned = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id", "formatted", turns.alias("turns"), learned.alias("learned")
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
