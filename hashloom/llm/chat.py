"""Chat formatting with Spark expressions only.

One conversation becomes one string. Every block of adjacent turns with the
same role is

    ### <role>: <text><+><text>...</turn>\\n

so a block holds one text per turn. Inside roles and texts a backslash, ``<``
and ``#`` are written ``\\b``, ``\\l`` and ``\\h`` (and ``:`` in roles ``\\c``), so
that no control string can occur there, and reading back is exact.

Defined cases: a null text or role is empty; a null turn comes first; equal
turns are ordered by role, then text; repeated rows are turns of their own; a
null conv_id is a conversation of its own; an empty table gives an empty
table; other columns are ignored. A conversation is one row of the result, so
it has to fit in a Spark cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, COLON, NEXT, CLOSE = "### ", ": ", "<+>", "</turn>\n"
#: Written in this order and read back in the opposite order.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def escape(text: Column, table=ESCAPES) -> Column:
    for plain, code in table:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, table=ESCAPES) -> Column:
    for plain, code in reversed(table):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(chats: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_blocks, formatted, segments.

    segments are (text, loss) in order; their texts joined are ``formatted``
    and loss marks what a model is trained on: the texts of loss_role.
    """
    turns = chats.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("turn").cast("long").alias("turn"),
                    F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )

    def blocks_of(ts: Column) -> Column:
        """Adjacent turns of one role as (role, texts); each array is walked once."""
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(ts["role"], 1, F.size(ts) - 1))
        opens = F.zip_with(ts["role"], before, lambda a, b: ~a.eqNullSafe(b))
        starts = F.filter(F.transform(opens, lambda o, i: F.when(o, i + 1)), lambda x: x.isNotNull())
        return _let(
            starts,
            lambda s: F.zip_with(
                s,
                F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(ts) + 1)),
                lambda a, b: _let(F.slice(ts, a, b - a), lambda own: F.struct(own[0]["role"].alias("role"), own["text"].alias("texts"))),
            ),
        )

    def segments_of(b: Column) -> Column:
        loss = b["role"] == F.lit(loss_role)
        segment = lambda text, on: F.struct(text.alias("text"), on.alias("loss"))
        bare = F.lit(False)
        texts = F.transform(
            b["texts"],
            lambda t, i: F.array(
                segment(F.when(i == 0, F.concat(F.lit(OPEN), escape(b["role"], ROLE_ESCAPES), F.lit(COLON))).otherwise(F.lit(NEXT)), bare),
                segment(escape(t), loss),
            ),
        )
        return F.concat(F.flatten(texts), F.array(segment(F.lit(CLOSE), bare)))

    made = turns.select("conv_id", _let(F.col("turns"), blocks_of).alias("blocks"))
    made = made.select("conv_id", F.size("blocks").alias("n_blocks"), F.flatten(F.transform("blocks", segments_of)).alias("segments"))
    return made.select("conv_id", F.col("n_blocks").cast("long").alias("n_blocks"), F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.split(formatted, "</turn>\n", -1)

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, COLON, 1)
        rest = F.substr(block, F.length(head) + F.lit(len(COLON) + 1))
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)), ROLE_ESCAPES)
        return _let(role, lambda r: F.transform(F.split(rest, "<\\+>", -1), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns_of))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask as it was before formatting."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
