"""Chat formatting from event logs: conversations are rebuilt from their events, then rendered with a loss mask.

An event is (conv_id, seq, kind, turn, role, text). In the order of seq, a ``message`` opens a message of its turn with
a text, a ``delta`` adds to it, an ``edit`` replaces its text, and a ``regenerate`` empties it for the deltas of the
new attempt; all three mean the latest message of their turn. So the final text is what stands from a message's last
opening, edit or regeneration on. Messages stand in the order of turn, those of one turn in the order they were opened.

The template renders a message as ``### role``, a newline, the text and ``</turn>`` with a newline. In roles and texts
``\\``, ``#`` and ``<`` become ``\\b``, ``\\h`` and ``\\l`` (in roles a newline becomes ``\\n``), so neither mark can occur
inside, and reading back is exact. The mask holds the spans of assistant texts, in code points of the formatted text.

Defined results: null texts and roles are empty; an event whose turn has no message yet opens one; other kinds are
ignored; equal seq are ordered by kind (message, regenerate, edit, delta), role and text, and repeated message rows are
messages of their own. A null conv_id is a conversation like any other. Extra columns of an event log are not read,
those of conversations are kept, but for former ones with the result's names. No events: no conversations.

Scale: events meet by (conv_id, turn), so that a long conversation is spread over its turns, and only the folded
messages meet by conv_id: one output row. Everything is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strideframe.llm.common import fresh, let, running

OPEN, CLOSE = "### ", "</turn>\n"
# Fixed order of equal seq.
KINDS = {"message": 0, "regenerate": 1, "edit": 2, "delta": 3}


def escape(text: Column, role: bool = False) -> Column:
    """Without ``#``, ``<`` and lone backslashes; a role also without newlines."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    text = F.replace(F.replace(text, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(text, F.lit("\n"), F.lit("\\n")) if role else text


def unescape(text: Column, role: bool = False) -> Column:
    """The inverse: backslashes last, since only they can make new ones."""
    text = F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    text = F.replace(text, F.lit("\\n"), F.lit("\n")) if role else text
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _fold(events: Column) -> Column:
    """The messages of one turn from its sorted events."""
    n = F.size(events)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(events, i)["rank"] == KINDS["message"]))

    def message(own: Column) -> Column:
        resets = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: (i == 1) | (F.element_at(own, i)["rank"] != KINDS["delta"]))
        final = F.slice(own, F.array_max(resets), F.size(own))
        return F.struct(
            F.coalesce(F.get(F.filter(F.transform(own, lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(0)), F.lit("")).alias("role"),
            F.array_join(F.transform(final, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
        )

    return let(starts, lambda s: F.transform(s, lambda first, k: let(
        F.slice(events, first, F.coalesce(F.get(s, k + 1), n + 1) - first), message
    )))


def to_events(rows: DataFrame) -> DataFrame:
    """An event log of finished messages (conv_id, turn, role, text), as a chat service would have written it.

    What an assistant says was streamed in halves after a first attempt that was given up; all else was sent unfinished
    and edited. Rows of one turn follow each other by role and text. Folding the log gives the messages back.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    none = F.lit(None).cast("string")
    event = lambda kind, role, said: F.struct(F.lit(kind).alias("kind"), role.alias("role"), said.alias("text"))
    streamed = F.array(
        event("message", F.col("role"), none), event("delta", none, F.lit("Let me ")), event("delta", none, F.substring(text, F.lit(1), half)), event("regenerate", none, none),
        event("delta", none, F.substring(text, F.lit(1), half)), event("delta", none, F.substring(text, half + 1, F.length(text))),
    )
    sent = F.array(event("message", F.col("role"), F.concat(text, F.lit(" ..."))), event("edit", none, text))
    log = rows.select("conv_id", "turn", nth.alias("nth"), F.when(F.col("role") == "assistant", streamed).otherwise(sent).alias("e"))
    log = log.select("conv_id", "turn", "nth", F.posexplode("e").alias("k", "e"))
    return log.select("conv_id", (F.col("nth") * 16 + F.col("k")).cast("long").alias("seq"), "e.kind", "turn", "e.role", "e.text")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, messages: array of (turn, role, text)) from an event log."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in KINDS.items()])
    rows = events.select("conv_id", "turn", "seq", rank.alias("rank"), "role", "text").filter("rank IS NOT NULL")
    turns = rows.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("seq", "rank", "role", "text"))).alias("events"))
    folded = turns.select("conv_id", "turn", let(F.col("events"), _fold).alias("messages"))
    whole = folded.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "messages"))).alias("turns"))
    return whole.select("conv_id", F.flatten(F.transform("turns", lambda t: F.transform(
        t["messages"], lambda m: F.struct(t["turn"].alias("turn"), m["role"].alias("role"), m["text"].alias("text"))
    ))).alias("messages"))


def render(conversations: DataFrame) -> DataFrame:
    """conversations with ``formatted`` and ``loss_spans``: array of (start, end) of the assistant texts."""
    parts = F.transform("messages", lambda m: F.struct(
        F.concat(F.lit(OPEN), escape(m["role"], True), F.lit("\n")).alias("head"), escape(m["text"]).alias("body"), (m["role"] == "assistant").alias("loss"),
    ))
    def spans(ps: Column) -> Column:
        ends = running(F.transform(ps, lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).cast("long")), lambda x, y: x + y)
        return let(ends, lambda at: F.transform(
            F.filter(F.transform(ps, lambda p, i: F.when(p["loss"], i)), lambda i: i.isNotNull()),
            lambda i: F.struct((F.get(at, i) - len(CLOSE) - F.length(F.get(ps, i)["body"])).alias("start"), (F.get(at, i) - len(CLOSE)).alias("end")),
        ))

    (made,) = fresh(conversations, "made")
    both = let(parts, lambda ps: F.struct(
        F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"), spans(ps).alias("loss_spans"),
    ))
    out = conversations.drop("formatted", "loss_spans").withColumn(made, both)
    return out.withColumns({c: F.col(made)[c] for c in ("formatted", "loss_spans")}).drop(made)


def read_back(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted text."""
    parts = F.split(formatted, CLOSE)
    return let(parts, lambda ps: F.transform(F.slice(ps, 1, F.size(ps) - 1), lambda p: let(F.substring_index(p, "\n", 1), lambda head: F.struct(
        unescape(F.substring(head, F.lit(len(OPEN) + 1), F.length(head)), True).alias("role"),
        unescape(F.substring(p, F.length(head) + 2, F.length(p))).alias("text"),
    ))))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between.

    Each span is cut from the part between two closing marks in which it begins, so the whole text is read once; spans
    are met with parts by sorting both by where they begin.
    """
    def read(ps: Column) -> Column:
        ends = running(F.transform(ps, lambda p: (F.length(p) + len(CLOSE)).cast("long")), lambda x, y: x + y)
        return let(ends, lambda at: let(F.array_sort(F.concat(
            F.transform(ps, lambda p, i: F.struct((F.get(at, i) - F.length(p) - len(CLOSE)).alias("at"), i.alias("part"), F.lit(-1).cast("long").alias("end"))),
            F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit((1 << 31) - 1).alias("part"), s["end"].alias("end"))),
        )), lambda marks: let(
            running(F.transform(marks, lambda m: F.when(m["end"] < 0, m["part"]).otherwise(-1)), F.greatest),
            lambda part: F.array_join(F.transform(
                F.filter(F.transform(marks, lambda m, k: F.struct(m["at"].alias("at"), m["end"].alias("end"), F.get(part, k).alias("part"))), lambda m: m["end"] >= 0),
                lambda m: let(F.get(ps, m["part"]), lambda p: unescape(
                    F.substring(p, (m["at"] - F.get(at, m["part"]) + F.length(p) + len(CLOSE) + 1).cast("int"), (m["end"] - m["at"]).cast("int"))
                )),
            ), ""),
        )))

    return let(F.split(formatted, CLOSE), read)
