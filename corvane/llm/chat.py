"""Chat formatting in budgeted, turn-aligned windows, in DataFrame functions only.

Prefix sums of the turns' token estimates cut a conversation into spans of new turns that fit the
budget less the system turn and the history allowance, which is at most half of what the system turn
leaves. A window is the system turn, the longest run of earlier turns that fits the allowance and
what the new turns leave of the budget, then the new turns. Assistant texts among the new turns are
the targets; whatever is repeated (system, history) is masked. A window exceeds the budget only if
the system turn and one new turn do, for nothing is cut or dropped; it has no history then.

A turn is written <|im_start|>role, newline, text, <|im_end|>, newline. Inside roles and texts every
"<|" becomes "<||", so no control string can arise from them, and "<||" reads back as "<|"; in
roles a backslash and a newline are written as backslash-backslash and backslash-n.

Null texts and roles count as empty. Turns that tie are ordered by role, then text; repeated rows
are turns of their own. A null conv_id is a conversation like others. Further columns change
nothing; an empty table gives no windows. A conversation is put together in one row, whose size
Spark bounds at 2 GB: its turns are what the window needs side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import once

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    halves = F.split(role, "\\\\\\\\", -1)  # at each pair of backslashes, from the left
    return unescaped(F.array_join(F.transform(halves, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\"))


def estimate(text: Column) -> Column:
    """Tokens of a text: a quarter of its bytes, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("bigint")


def windows(turns: DataFrame, budget: int = 512, history: int = 128, tokens: Callable[[Column], Column] = estimate) -> DataFrame:
    """(conv_id, window, text, turns): one row a window.

    turns: array of (role, start, end, loss, repeated), start and end being the code points of the
    turn's escaped text within the window's text.
    """
    one = F.struct(F.col("turn").alias("t"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    g = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("_t"))
    sums = F.aggregate("_t", F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + tokens(x.text))))
    head = (F.get("_t", F.lit(0)).role == "system").cast("int")
    g = g.select("conv_id", once(F.col("_t")).alias("_t"), once(sums).alias("_p"), once(head).alias("_sys"))
    left = F.lit(budget) - F.when(F.col("_sys") == 1, F.get("_p", F.lit(1))).otherwise(F.lit(0))
    g = g.select("*", once(left).alias("_left")).withColumn("_allow", F.greatest(F.lit(0), F.least(F.lit(history), F.floor(F.col("_left") / 2))))
    g = g.select("*", once(F.greatest(F.lit(1), F.col("_left") - F.col("_allow"))).alias("_room"))
    # The fold keeps the starts of the windows so far; a turn that no longer fits opens the next one.
    opened = F.aggregate(
        F.sequence(F.lit(0), F.size("_t") - 1),
        F.array(F.col("_sys")),
        lambda a, i: F.when((i > F.element_at(a, -1)) & (F.get("_p", i + 1) - F.get("_p", F.element_at(a, -1)) > F.col("_room")), F.concat(a, F.array(i))).otherwise(a),
    )
    g = g.select("*", once(opened).alias("_o"))

    def back(s: Column, e: Column) -> Column:
        """The first turn of the history before the new turns s to e."""
        most = F.least(F.col("_allow"), F.col("_left") - (F.get("_p", e) - F.get("_p", s)))
        fits = F.filter(F.sequence(F.least(F.col("_sys"), s), s), lambda j: F.get("_p", s) - F.get("_p", j) <= most)
        return F.greatest(F.col("_sys"), F.coalesce(F.array_min(fits), s))

    end = lambda k: F.coalesce(F.get("_o", k + 1), F.size("_t"))
    span = lambda s, k: F.struct(back(s, end(k)).alias("h"), s.alias("s"), end(k).alias("e"), k.alias("k"))
    g = g.select("conv_id", "_t", "_sys", once(F.transform("_o", span)).alias("_w"))

    def content(w: Column) -> Column:
        mark = lambda xs, rep: F.transform(xs, lambda x: F.struct(x.role.alias("role"), x.text.alias("text"), F.lit(rep).alias("repeated")))
        system = F.slice("_t", 1, F.col("_sys"))
        first = F.when(w.k == 0, mark(system, False)).otherwise(mark(system, True))
        return F.struct(w.k.alias("window"), F.concat(first, mark(F.slice("_t", w.h + 1, w.s - w.h), True), mark(F.slice("_t", w.s + 1, w.e - w.s), False)).alias("turns"))

    rows = g.select("conv_id", F.explode(F.transform("_w", content)).alias("w")).select("conv_id", F.col("w.window").cast("long").alias("window"), once(F.transform("w.turns", lambda x: F.struct(escaped_role(x.role).alias("role"), escaped(x.text).alias("text"), x.repeated.alias("repeated")))).alias("_x"))
    text = F.array_join(F.transform("_x", lambda x: F.concat(F.lit(START), x.role, F.lit("\n"), x.text, F.lit(END + "\n"))), "")
    shape = "array<struct<role:string,start:bigint,end:bigint,loss:boolean,repeated:boolean>>"
    placed = F.aggregate(
        "_x",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(shape).alias("out")),
        lambda a, x: F.struct(
            (a.at + len(START) + F.length(x.role) + 1 + F.length(x.text) + len(END) + 1).cast("bigint").alias("at"),
            F.concat(a.out, F.array(F.struct(x.role.alias("role"), (a.at + len(START) + F.length(x.role) + 1).cast("bigint").alias("start"), (a.at + len(START) + F.length(x.role) + 1 + F.length(x.text)).cast("bigint").alias("end"), ((x.role == "assistant") & ~x.repeated).alias("loss"), x.repeated.alias("repeated")))).cast(shape).alias("out"),
        ),
    ).out
    return rows.select("conv_id", "window", text.alias("text"), placed.alias("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted_chars), from the windows' texts and masks alone."""
    pieces = F.filter(F.split("text", "<\\|im_start\\|>", -1), lambda p: p != "")
    body = lambda p: F.substr(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)
    w = formatted.select("conv_id", "window", "text", "turns", once(pieces).alias("_p"))
    said = F.transform("_p", lambda p, i: F.struct(F.get("turns", i).repeated.alias("repeated"), unescaped_role(F.substring_index(p, "\n", 1)).alias("role"), unescaped(body(p)).alias("text")))
    fresh = F.transform(F.filter(said, lambda x: ~x.repeated), lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t.loss), lambda t: unescaped(F.substr(F.col("text"), (t.start + 1).cast("int"), (t.end - t.start).cast("int")))), "")
    w = w.select("conv_id", F.struct("window", fresh.alias("turns"), loss.alias("loss"), F.length("text").alias("n")).alias("x"))
    g = w.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return g.select("conv_id", F.flatten(F.transform("x", lambda x: x.turns)).alias("turns"), F.array_join(F.transform("x", lambda x: x.loss), "").alias("loss_text"), F.aggregate("x", F.lit(0).cast("bigint"), lambda a, x: (a + x.n).cast("bigint")).alias("formatted_chars"))
