"""Chat formatting with a grammar round trip.

Grammar: a conversation is a sequence of turns, each ``<|im_start|>`` role ``\\n`` text ``<|im_end|>\\n``.
Inside roles and texts ``<`` followed by k backslashes and ``|`` may be written with k + 1 backslashes; the parser takes
one backslash away again, so ``<|`` never remains inside an escaped text. A new line in a role is written ``<|n|>``.

A conversation is rendered plainly first and parsed again; turns whose recovered role or text differs from the source
are escaped and the conversation is rendered and parsed anew, until source and recovered turns are identical (escaping
is a bijection, so that the second round always is). Built-in expressions only.

Defined results: null role and null text count as empty; turns are ordered by turn (null first), then role, then text;
repeated rows stay repeated turns; rows with a null conv_id form one conversation; a conversation is one value by
nature (its digest needs the whole of it), so that it is the unit of memory. Folds over turns go in runs of the square
root of their number, so that a conversation of very many turns isn't quadratic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderplan.llm.common import let

START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"
MARK = r"<(\\*)\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, MARK, r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def _segments(formatted: Column) -> Column:
    """What follows each start mark; an output with anything before the first mark has one segment too many."""
    s = F.split(formatted, START.replace("|", "[|]"), -1)
    return let(s, lambda p: F.when(F.element_at(p, 1) == "", F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text); a segment against the grammar has null text."""
    tail = len(END) + 1

    def turn(s: Column) -> Column:
        head = F.instr(s, "\n")
        # the first end mark must be the one that closes the segment
        ok = (head > 0) & (F.instr(s, END) == F.length(s) - tail + 1) & s.endswith("\n")
        body = F.substring(s, head + 1, F.greatest(F.length(s) - head - tail, F.lit(0)))
        return F.struct(unescape_role(F.substring(s, F.lit(1), F.greatest(head - 1, F.lit(0)))).alias("role"), F.when(ok, unescape(body)).alias("text"))

    return F.transform(_segments(formatted), turn)


def gathered(rows: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) from rows (conv_id, turn, role, text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    by = rows.select("conv_id", "turn", text("role"), text("text")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return by.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def formatted(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, escaped (whether it had to be), round_trip, loss_spans.

    loss_spans: (start, end) in code points of each assistant text within formatted, in order.
    """
    d = gathered(rows).withColumn("_plain", _render(F.col("turns")))
    d = d.withColumn("_same", parse(F.col("_plain")) == F.col("turns"))
    safe = lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"))
    d = d.withColumn("_turns", F.when(F.col("_same"), F.col("turns")).otherwise(F.transform("turns", safe)))
    d = d.withColumn("formatted", F.when(F.col("_same"), F.col("_plain")).otherwise(_render(F.col("_turns"))))
    d = d.withColumn("round_trip", F.col("_same") | (parse(F.col("formatted")) == F.col("turns")))
    return d.select("conv_id", "formatted", (~F.col("_same")).alias("escaped"), "round_trip", loss_spans(F.col("formatted")).alias("loss_spans"))


def chunked(items: Column) -> Column:
    """An array cut into about as many runs as a run has entries: array of (first, items), so that no fold is quadratic."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))

    def cut(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), w), lambda k: k <= F.size(items))
        return F.transform(starts, lambda k: F.slice(items, k, w))

    return let(width, cut)


def running(lengths: Column) -> Column:
    """The sum of the lengths before each entry of an array of ints."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n)

    def before(first: Column, x: Column) -> Column:
        state = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, state, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    each = lambda runs: let(before(F.lit(0), F.transform(runs, total)), lambda first: F.flatten(F.zip_with(first, runs, before)))
    return let(chunked(lengths), each)


def loss_spans(formatted: Column) -> Column:
    """The loss mask: (start, end) in code points of each assistant text in a rendered conversation, by the parser's own segments."""
    tail = len(END) + 1

    def spans(seg: Column) -> Column:
        sizes = F.transform(seg, lambda x: F.length(x) + len(START))

        def one(x: Column, at: Column) -> Column:
            mine = unescape_role(F.substring_index(x, "\n", 1)) == LEARNT
            return F.when(mine, F.struct((at + len(START) + F.instr(x, "\n")).alias("start"), (at + len(START) + F.length(x) - tail).alias("end")))

        return F.filter(F.zip_with(seg, running(sizes), one), lambda x: x.isNotNull())

    return let(_segments(formatted), spans)


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text of ``formatted`` within the spans, each unescaped, one after the other.

    Spans are cut out in runs, each run out of its own part of the text, as a cut counts code points from the beginning.
    """
    cut = lambda text, a, b: F.substring(text, a + 1, b - a)

    def run(x: Column) -> Column:
        first = F.element_at(x, 1)["start"]
        part = cut(formatted, first, F.element_at(x, -1)["end"])
        return let(part, lambda p: F.array_join(F.transform(x, lambda s: unescape(cut(p, s["start"] - first, s["end"] - first))), ""))

    return F.array_join(F.transform(chunked(spans), run), "")


def read_back(formatted_rows: DataFrame) -> DataFrame:
    """What a trainer gets from formatted and its loss mask: conv_id, turns, loss_text (all text under the mask, unescaped), formatted."""
    d = formatted_rows.withColumn("turns", parse(F.col("formatted")))
    return d.withColumn("loss_text", under_mask(F.col("formatted"), F.col("loss_spans")))
