"""Chat formatting with relational operations only: sorted turn structs, merged adjacent turns, one text.

Template: `<|turn|>ROLE<|text|>TEXT<|end|>\\n` for each block of adjacent turns of one role; the texts of merged
turns stay apart by `<|part|>`, so the turns can be read back one by one. Inside roles and texts each `<`, any
backslashes and a `|` get one more backslash, so no marker can come from data, and taking one away restores it.
The loss mask is a list of code-point spans over the texts of the trained role.

Turns are gathered in two steps, segments of neighbouring turn numbers first and then segments in order, so that a
long conversation is pre-aggregated by many tasks before its one formatted text is put together.

Defined results: null text or role is an empty string; null turns come first; equal turn numbers are ordered by
role and text and all kept, repeated rows too; rows of a null conversation id form one conversation; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def _literal(marker: str) -> str:
    return rf"\Q{marker}\E"


def format_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant", segment: int = 64
) -> DataFrame:
    """conv, formatted text and loss_spans (start, length in code points, in order) of each conversation."""
    rows = df.select(
        F.col(conv).alias("c"),
        F.floor(F.col(turn) / F.lit(segment)).alias("s"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    # Each turn is written with what stands before its text, or with nothing yet if it opens a segment.
    pieces = let(
        F.array_sort(F.collect_list("t")),
        lambda ts: F.transform(
            ts,
            lambda t, i: F.struct(
                t.role.alias("role"),
                escape(t.text).alias("text"),
                F.when(i > 0, F.get(ts, i - 1).role).alias("before"),
            ),
        ),
    )
    segments = rows.groupBy("c", "s").agg(pieces.alias("p")).select("c", F.struct("s", "p").alias("g"))

    def joined(gs):
        """All turns in order; the role before a segment's first turn is the last one of the segment before it."""
        return F.flatten(
            F.transform(
                gs,
                lambda g, k: F.transform(
                    g.p,
                    lambda t, i: F.struct(
                        t.role.alias("role"),
                        t.text.alias("text"),
                        F.when((i == 0) & (k > 0), F.element_at(F.get(gs, k - 1).p, -1).role).otherwise(t.before).alias("before"),
                    ),
                ),
            )
        )

    def head(t):
        opened = F.concat(F.lit(TURN), escape(t.role), F.lit(TEXT))
        return F.when(t.before.isNull(), opened).when(t.before == t.role, F.lit(PART)).otherwise(F.concat(F.lit(END), opened))

    headed = F.transform(
        let(F.array_sort(F.collect_list("g")), joined),
        lambda t: F.struct(head(t).alias("head"), t.text.alias("text"), (t.role == F.lit(trained)).alias("trained")),
    )

    def written(ts):
        starts = prefix_sums(F.transform(ts, lambda t: F.length(t.head) + F.length(t.text)))
        spans = F.zip_with(ts, starts, lambda t, s: F.struct((s + F.length(t.head)).alias("start"), F.length(t.text).cast("bigint").alias("length"), t.trained.alias("trained")))
        return F.struct(
            F.concat(F.array_join(F.transform(ts, lambda t: F.concat(t.head, t.text)), ""), F.lit(END)).alias("formatted"),
            F.transform(F.filter(spans, lambda s: s.trained), lambda s: F.struct(s.start.alias("start"), s.length.alias("length"))).alias("loss_spans"),
        )

    out = segments.groupBy("c").agg(headed.alias("ts")).select("c", let(F.col("ts"), written).alias("w"))
    return out.select(F.col("c").alias(conv), "w.formatted", "w.loss_spans")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted text."""
    blocks = F.filter(F.split(formatted, _literal(END), -1), lambda b: b != "")

    def block(b):
        halves = F.split(b, _literal(TEXT), 2)
        return let(
            halves,
            lambda h: F.transform(
                F.split(F.get(h, 1), _literal(PART), -1),
                lambda t: F.struct(unescape(F.substring(F.get(h, 0), len(TURN) + 1, 2**31 - 1)).alias("role"), unescape(t).alias("text")),
            ),
        )

    return F.flatten(F.transform(blocks, block))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the mask, unescaped. Fixed-width code points make each cut cost its own length only."""
    wide = F.encode(formatted, "UTF-32")
    first = F.lit("x")  # stands before each cut, so that no character of the text is taken for a byte-order mark

    def cut(w):
        return F.transform(
            spans,
            lambda s: unescape(F.substr(F.decode(F.concat(F.encode(first, "UTF-32"), F.substr(w, (s.start * 4 + 1).cast("int"), (s.length * 4).cast("int"))), "UTF-32"), F.lit(2))),
        )

    return let(wide, cut)
