"""Chat formatting: turns of a conversation become one text with marks and a loss mask. Spark expressions only.

A conversation reads ``<s>``, then for each run of turns of one role ``[INST role]``, the texts parted by ``[TURN]``, and
``[/INST]``, then ``</s>``. Every control string inside a role or text is escaped, so the marks of an output are all
its template's own and :func:`read_back` gives the turns as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END, OPEN, NAMED, TURN, CLOSE = "<s>", "</s>", "[INST ", "]\n", "[TURN]", "[/INST]"
TRAINED_ROLE = "assistant"
ESCAPE = "\\"
# what must not stand in a text, with the letter that stands for it behind the escape sign
CONTROLS = {
    BEGIN: "b",
    END: "e",
    "[INST": "o",
    CLOSE: "c",
    TURN: "t",
    "<<SYS>>": "s",
    "<</SYS>>": "y",
    "<|": "p",
}


def escaped(text: Column) -> Column:
    """The text without any control string: the escape sign becomes sign and 0, a control string sign and letter."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for control, letter in CONTROLS.items():
        out = F.replace(out, F.lit(control), F.lit(ESCAPE + letter))
    return out


def unescaped(text: Column) -> Column:
    """Takes :func:`escaped` back."""
    for control, letter in CONTROLS.items():
        text = F.replace(text, F.lit(ESCAPE + letter), F.lit(control))
    return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _escaped_role(role: Column) -> Column:
    """A role in one line before the first ``]``: line ends and that sign are escaped too."""
    return F.replace(F.replace(escaped(role), F.lit("\n"), F.lit(ESCAPE + "n")), F.lit("]"), F.lit(ESCAPE + "r"))


def _unescaped_role(role: Column) -> Column:
    role = F.replace(F.replace(role, F.lit(ESCAPE + "r"), F.lit("]")), F.lit(ESCAPE + "n"), F.lit("\n"))
    return unescaped(role)


def merged(conversations: DataFrame) -> DataFrame:
    """``conv_id, blocks``: the turns of each conversation in order, neighbours of one role in one block with its texts.

    ``conversations`` has ``conv_id, turn, role, text``. Turns are ordered by turn, then role and text, null turns first; null
    roles and texts are empty; rows with a null id are one conversation; repeated rows are turns of their own. A
    conversation is a row of the output, so it must fit into one.
    """
    turns = F.array_sort(
        F.collect_list(
            F.struct(
                "turn",
                F.coalesce(F.col("role"), F.lit("")).alias("role"),
                F.coalesce(F.col("text"), F.lit("")).alias("text"),
            )
        )
    )
    sorted_turns = conversations.groupBy("conv_id").agg(turns.alias("turns")).withColumn("n", F.size("turns"))
    # where blocks begin: turns whose role differs from the one before
    starts = F.filter(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"]),
    )
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.transform(
                F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.col("n")) - s), lambda t: t["text"]
            ).alias("texts"),
        ),
    )
    return sorted_turns.withColumn("starts", starts).select("conv_id", blocks.alias("blocks"))


def formatted(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, segments``: the text of each conversation, and the same text cut at the loss mask.

    ``segments`` holds ``text, loss`` in order; their texts in a row are ``formatted``. Under the mask (``loss``) stand the
    escaped texts of the assistant and nothing else. An empty table gives no rows.
    """

    def pieces(block: Column) -> Column:
        trained = block["role"] == TRAINED_ROLE
        head = F.struct(F.concat(F.lit(OPEN), _escaped_role(block["role"]), F.lit(NAMED)).alias("text"), F.lit(False).alias("loss"))
        body = F.flatten(
            F.transform(
                block["texts"],
                lambda t, i: F.array(
                    F.struct(F.when(i > 0, F.lit(TURN)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")),
                    F.struct(escaped(t).alias("text"), trained.alias("loss")),
                ),
            )
        )
        tail = F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss"))
        return F.concat(F.array(head), body, F.array(tail))

    def edge(mark: str) -> Column:
        return F.array(F.struct(F.lit(mark).alias("text"), F.lit(False).alias("loss")))

    cut = merged(conversations).withColumn(
        "segments", F.concat(edge(BEGIN), F.flatten(F.transform("blocks", pieces)), edge(END))
    )
    return cut.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def read_back(texts: DataFrame) -> DataFrame:
    """Adds ``turns`` (role and text of each turn, from ``formatted`` alone) and ``loss_text`` (unescaped text under the mask)."""
    inner = F.expr(f"substring(formatted, {len(BEGIN) + 1}, length(formatted) - {len(BEGIN) + len(END)})")
    # the last part, behind the last closing mark, is empty
    blocks = F.split(inner, r"\Q" + CLOSE + r"\E")
    heads = F.transform(
        F.slice("_blocks", F.lit(1), F.size("_blocks") - 1),
        lambda b: F.struct(
            _unescaped_role(F.substr(F.substring_index(b, NAMED, 1), F.lit(len(OPEN) + 1))).alias("role"),
            F.split(F.substr(b, F.length(F.substring_index(b, NAMED, 1)) + len(NAMED) + 1), r"\Q" + TURN + r"\E").alias("texts"),
        ),
    )
    turns = F.flatten(
        F.transform(
            "_heads",
            lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text"))),
        )
    )
    under = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return (
        texts.withColumn("_blocks", blocks)
        .withColumn("_heads", heads)
        .withColumns({"turns": turns, "loss_text": F.array_join(under, "")})
        .drop("_blocks", "_heads")
    )


def digests(texts: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of formatted conversations."""
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(texts).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
