"""Chat formatting with DataFrame expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns
of one role merge by array aggregation; the merged turns are concatenated under
a template whose control strings cannot occur inside a text, as ``\\``, ``#``
and ``<`` are escaped there. A loss mask goes along as run lengths: (chars,
loss) of consecutive stretches of the output, in code points, true over each
assistant text and false elsewhere.

    ### user
    text<sep>text</turn>
    ### assistant
    text</turn>

In roles line ends are escaped as well. Merging and reading back take time in
proportion to the conversation: runs of one role are cut out by their borders,
and the output is read in blocks of RUNS stretches.

Defined cases: a null text or role counts as empty; rows sort by (turn, role,
text), nulls first, so ties and repeated rows keep a fixed order and all stay;
a null conv_id is a conversation of its own; an empty table gives no rows;
other columns are ignored. One conversation is one row of output, and so has to
fit one task, as any single text has to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

OPEN, SEPARATE, CLOSE = "### ", "<sep>", "</turn>\n"
#: Fixed values of the template: what stands for each character inside texts and roles. The backslash goes first.
ESCAPES = (("\\", "\\e"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))
TRAINED_ROLE = "assistant"
RUNS = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def escape(text: Column, escapes=ESCAPES) -> Column:
    for plain, coded in escapes:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, escapes=ESCAPES) -> Column:
    for plain, coded in reversed(escapes):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def merge_turns(turns: Column) -> Column:
    """array<(role, texts)> of sorted turns, adjacent ones of the same role joined."""
    n = F.size(turns)

    def begins(i: Column) -> Column:
        return (i == 1) | (F.get(turns, i - 1).role != F.get(turns, i - 2).role)

    def merged(starts: Column) -> Column:
        def one(start: Column, k: Column) -> Column:
            own = F.slice(turns, start, F.coalesce(F.get(starts, k + 1), n + 1) - start)
            return F.struct(F.get(turns, start - 1).role.alias("role"), F.transform(own, lambda t: t.text).alias("texts"))

        return F.transform(starts, one)

    return let(F.filter(F.sequence(F.lit(1), n), begins), merged)


def stretches(merged: Column) -> Column:
    """array<(part, loss)>: the output's parts in order."""

    def part(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("part"), loss.alias("loss"))

    def one(turn: Column) -> Column:
        head = F.array(part(F.concat(F.lit(OPEN), escape(turn.role, ROLE_ESCAPES), F.lit("\n")), F.lit(False)))
        loss = turn.role == TRAINED_ROLE
        body = F.flatten(F.transform(turn.texts, lambda t, i: F.concat(F.when(i > 0, F.array(part(F.lit(SEPARATE), F.lit(False)))).otherwise(F.array().cast("array<struct<part:string,loss:boolean>>")), F.array(part(escape(t), loss)))))
        return F.concat(head, body, F.array(part(F.lit(CLOSE), F.lit(False))))

    return F.flatten(F.transform(merged, one))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted and mask, one row a conversation."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = grouped.select("conv_id", stretches(merge_turns(F.col("turns"))).alias("parts"))
    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p.part), "").alias("formatted"),
        F.transform("parts", lambda p: F.struct(F.length(p.part).alias("chars"), p.loss.alias("loss"))).alias("mask"),
    )


def parse_turns(formatted: Column) -> Column:
    """array<(role, text)> of the turns in a formatted conversation, unmerged."""

    def one(block: Column) -> Column:
        role = unescape(F.substring(F.substring_index(block, "\n", 1), len(OPEN) + 1, 1 << 30), ROLE_ESCAPES)
        body = F.substring(block, F.locate("\n", block) + 1, F.length(block))
        return F.transform(F.split(body, SEPARATE), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, CLOSE)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), one))


def trained_texts(formatted: Column, mask: Column) -> Column:
    """array<string>: each stretch under the mask, unescaped."""
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("texts"))

    def chars(runs: Column) -> Column:
        return F.aggregate(runs, F.lit(0), lambda total, run: total + run.chars)

    def block(k: Column) -> Column:
        own = F.slice(mask, k * RUNS + 1, RUNS)

        def read(text: Column) -> Column:
            def step(done: Column, run: Column) -> Column:
                texts = F.when(run.loss, F.concat(done.texts, F.array(unescape(F.substring(text, done.at, run.chars))))).otherwise(done.texts)
                return F.struct((done.at + run.chars).alias("at"), texts.alias("texts"))

            return F.aggregate(own, begin, step, lambda done: done.texts)

        return let(F.substring(formatted, chars(F.slice(mask, 1, k * RUNS)) + 1, chars(own)), read)

    last = F.greatest(F.lit(0), F.ceil(F.size(mask) / RUNS).cast("int") - 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), last), block))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations and their masks hold."""
    parsed = formatted.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"), F.array_join(trained_texts(F.col("formatted"), F.col("mask")), "").alias("trained"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
