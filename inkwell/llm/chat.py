r"""Chat formatting: turns to one training text a conversation, with a loss mask, and back. Spark expressions only.

The text of a conversation is, for each run of turns by the same role,
`<|im_start|>` role `<|im_sep|>` text (`<|im_next|>` text)* `<|im_end|>`, so that adjacent turns of a role merge into
one message and can still be told apart. A backslash in a role or text is doubled and control strings get one after
their first character, so that no text can look like markup; `parse` undoes both. The loss mask is a list of
(start, end) spans in code points, end exclusive, over the texts of the trained roles.

A conversation's turns are collected in two steps, by blocks of consecutive turn numbers and then by conversation, so
that sorting, escaping and merging a long conversation spread over tasks; only finished strings meet in its one row.

Nulls and extremes: a null role or text is empty; a null conversation or turn number is a value of its own (null turns
first). Ties between turn numbers are broken by role, then text; repeated rows stay. Empty texts stay turns. An empty
table gives an empty result. Extra columns of the input are ignored. A conversation must fit Spark's 2 GB a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"

#: What no text may contain unescaped: `<|`, sequence ends and the instruction and system marks of common templates.
CONTROL = r"(<)(?=\||/?s>|</?SYS>>|/?SYS>>)|(\[)(?=/?INST\])"
TRAINED = ("assistant",)
BLOCK = 256


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.when(doubled.rlike(CONTROL), F.regexp_replace(doubled, CONTROL, r"$1$2\\")).otherwise(doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """conv_id, formatted (string), loss_spans (array of start, end), one row a conversation."""
    blank = F.lit("")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.floor(F.col(turn_col) / BLOCK).alias("block"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text")).alias("t"),
    )
    #: Within a block: everything between the first role's mark and the last end mark, and the spans in it.
    sorted_blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", "block", "turns")

    def pieces(ts: Column) -> Column:
        def piece(t: Column, i: Column) -> Column:
            same = F.get(ts, i - 1)["role"] == t["role"]
            head = F.when(i == 0, "").when(same, NEXT).otherwise(F.concat(F.lit(END + START), escape(t["role"]), F.lit(SEP)))
            body = escape(t["text"])
            return F.struct(F.concat(head, body).alias("s"), F.length(body).cast("bigint").alias("n"), t["role"].isin(*trained).alias("loss"))

        return F.transform(ts, piece)

    def block_of(ps: Column) -> Column:
        ends = prefix_sums(F.transform(ps, lambda p: F.length(p["s"]).cast("bigint")))
        spans = F.filter(F.transform(F.arrays_zip(ps.alias("p"), ends.alias("e")), lambda x: F.struct((x["e"] - x["p"]["n"]).alias("start"), x["e"].alias("end"), x["p"]["loss"].alias("loss"))), lambda x: x["loss"])
        return F.struct(
            F.array_join(F.transform(ps, lambda p: p["s"]), "").alias("inner"),
            F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"),
        )

    blocks = sorted_blocks.select(
        "conv_id",
        F.struct("block", F.element_at("turns", 1)["role"].alias("first"), F.element_at("turns", -1)["role"].alias("last"), let(let(F.col("turns"), pieces), block_of).alias("body")).alias("b"),
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("bs"))

    def heads(bs: Column) -> Column:
        def opened(b: Column, i: Column) -> Column:
            start = F.concat(F.lit(START), escape(b["first"]), F.lit(SEP))
            return F.when(i == 0, start).when(F.get(bs, i - 1)["last"] == b["first"], NEXT).otherwise(F.concat(F.lit(END), start))

        return F.transform(bs, lambda b, i: F.struct(opened(b, i).alias("head"), b["body"].alias("body")))

    def joined(hs: Column) -> Column:
        text = F.concat(F.array_join(F.transform(hs, lambda h: F.concat(h["head"], h["body"]["inner"])), ""), F.lit(END))
        sizes = prefix_sums(F.transform(hs, lambda h: (F.length(h["head"]) + F.length(h["body"]["inner"])).cast("bigint")))
        moved = F.transform(
            F.arrays_zip(hs.alias("h"), sizes.alias("e")),
            lambda x: F.transform(x["h"]["body"]["spans"], lambda s: F.struct(*((s[k] + x["e"] - F.length(x["h"]["body"]["inner"])).alias(k) for k in ("start", "end")))),
        )
        return F.struct(text.alias("formatted"), F.flatten(moved).alias("loss_spans"))

    return whole.select("conv_id", let(let(F.col("bs"), heads), joined).alias("x")).select("conv_id", "x.formatted", "x.loss_spans")


def parse(formatted: Column) -> Column:
    """The turns (role, text) in a formatted conversation, in order."""
    messages = F.filter(F.split(formatted, r"<\|im_end\|>", -1), lambda m: m != "")

    def turns(m: Column) -> Column:
        role = unescape(F.substring_index(F.substr(m, F.lit(len(START) + 1)), SEP, 1))
        texts = F.split(F.substr(m, F.instr(m, SEP) + len(SEP)), r"<\|im_next\|>", -1)
        return let(role, lambda r: F.transform(texts, lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(messages, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
