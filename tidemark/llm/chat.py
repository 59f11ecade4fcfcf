"""Chat formatting as array expressions, and the reader that undoes it.

A conversation becomes blocks, one for each run of adjacent turns of a role:

    ### role:
    first text</part>second text</turn>

``\\`` in a text becomes ``\\e``, and the control strings ``### ``, ``</part>``
and ``</turn>`` get a backslash inside; after that every backslash tells what
it stands for, so unescaping is exact.  The loss mask covers the texts of the
trained roles, one run per text, with its place in bytes and in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

HEAD, ROLE_END, PART, TURN = "### ", ":\n", "</part>", "</turn>"
TURN_LINE = TURN + "\n"


def _swap(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_TEXT = [("\\", "\\e"), (TURN, "<\\/turn>"), (PART, "<\\/part>"), (HEAD, "#\\## ")]
_ROLE = [("\\", "\\e"), (":", "\\c"), ("\n", "\\n"), (TURN, "<\\/turn>")]


def escape_text(text: Column) -> Column:
    return _swap(text, _TEXT)


def unescape_text(text: Column) -> Column:
    return _swap(text, [(new, old) for old, new in reversed(_TEXT)])


def escape_role(role: Column) -> Column:
    return _swap(role, _ROLE)


def unescape_role(role: Column) -> Column:
    return _swap(role, [(new, old) for old, new in reversed(_ROLE)])


def _before(sizes: Column, block: int = 512) -> Column:
    """For each element of ``sizes`` the sum of those before it; block by block, as every append copies an array."""

    def sums(own: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(own, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    count = F.ceil(F.size(sizes) / block).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(sizes, k * block + 1, F.lit(block)))

    def joined(blocks: Column) -> Column:
        total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, sums(total), lambda b, base: F.transform(sums(b), lambda x: x + base)))

    return let(cut, joined)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: the id, formatted string, loss_runs array<struct<start, bytes, length, loss>>.

    loss_runs cuts the whole of ``formatted`` into runs that are trained on or
    not: where a run starts and how long it is in UTF-8 bytes, and its length
    in code points.  Turns are ordered by turn (nulls first), then role
    and text, so ties have one order and repeated rows stay.  A null text or
    role is the empty string; rows without an id form one conversation; an
    empty table gives none; other columns are not read.  The pieces of a
    conversation are joined once, which is linear in its length.
    """
    collected = turns.groupBy(F.col(conv)).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col(turn).alias("turn"),
                    F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"),
                )
            )
        ).alias("_turns")
    )

    def pieces(t: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            starts = (i == 0) | (F.get(t, i - 1)["role"] != x["role"])
            ends = (i == F.size(t) - 1) | (F.get(t, i + 1)["role"] != x["role"])
            header = F.concat(F.lit(HEAD), escape_role(x["role"]), F.lit(ROLE_END))
            return F.struct(
                F.when(starts, header).otherwise(F.lit(PART)).alias("before"),
                escape_text(x["text"]).alias("body"),
                F.when(ends, F.lit(TURN_LINE)).otherwise(F.lit("")).alias("after"),
                (x["role"] == trained).alias("trained"),
            )

        return F.transform(t, piece)

    def run(text: Column, loss: Column) -> Column:
        return F.struct(F.octet_length(text).cast("long").alias("bytes"), F.char_length(text).cast("long").alias("length"), loss.alias("loss"))

    def placed(runs: Column) -> Column:
        starts = _before(F.transform(runs, lambda r: r["bytes"]))
        return F.zip_with(runs, starts, lambda r, at: F.struct(at.alias("start"), *[r[c].alias(c) for c in ("bytes", "length", "loss")]))

    made = collected.select(F.col(conv), let(F.col("_turns"), pieces).alias("_pieces"))
    runs = F.flatten(
        F.transform("_pieces", lambda p: F.array(run(p["before"], F.lit(False)), run(p["body"], p["trained"]), run(p["after"], F.lit(False))))
    )
    return made.select(
        F.col(conv),
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"),
        let(runs, placed).alias("loss_runs"),
    )


def loss_texts(formatted: Column, loss_runs: Column) -> Column:
    """array<string>: what the loss mask covers, cut from ``formatted`` run by run and unescaped.

    Runs are cut by bytes, which finds their place without counting the code points before it.
    """
    own = F.filter(loss_runs, lambda r: r["loss"])
    cut = lambda b, r: F.substring(b, (r["start"] + 1).cast("int"), r["bytes"].cast("int")).cast("string")
    return let(formatted.cast("binary"), lambda b: F.transform(own, lambda r: unescape_text(cut(b, r))))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that ``formatted`` was made of, merged ones told apart again."""

    def turns(block: Column) -> Column:
        head = F.substring_index(block, ROLE_END, 1)
        body = F.substr(block, F.char_length(head) + (len(ROLE_END) + 1))
        role = unescape_role(F.substr(head, F.lit(len(HEAD) + 1)))
        return F.transform(F.split(body, PART), lambda x: F.struct(role.alias("role"), unescape_text(x).alias("text")))

    blocks = F.split(formatted, TURN_LINE)
    return F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), turns))
