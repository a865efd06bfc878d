"""Chat formatting from event logs: fold deltas, edits and regenerations into final messages, render them with a loss mask.

A log row says what happened to one message of a conversation: ``open`` (with its role), ``delta`` (text appended),
``edit`` (text replaced), ``regenerate`` (text thrown away, deltas follow anew). The fold works on messages, not on
conversations, so a conversation of any length is spread over the cluster; a message's own log is folded by two
aggregates: the last reset of the message, then the text of its rows from there on in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The template. A turn is OPEN role MID text CLOSE; ESCAPE before a control string's first character in a text.
OPEN, MID, CLOSE, ESCAPE = "<s>[INST] ", " [/INST] ", " </s>\n", "\\"
#: Every character that starts or ends a control string, and the escape itself, is escaped inside texts.
_SPECIAL = r"[\\<>\[\]]"
OPENED, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({_SPECIAL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?s)\\({_SPECIAL})", "$1")


def fold_messages(log: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: what every message says after its last event.

    log: conv_id, turn, message (tells messages of one turn apart), seq (order within the message), event, role, text. Null texts count as empty; an event of
    another kind or null is ignored; a message without ``open`` has role null; ties of seq go by event and text. The
    log is grouped by message; a conversation that holds a third of all rows is many messages. An empty log gives none.
    """
    reset = F.col("event").isin(EDIT, REGENERATE)
    text = F.coalesce("text", F.lit(""))
    row = F.struct(F.col("seq").alias("seq"), F.col("event").alias("event"), text.alias("text"))
    said = F.col("event").isin(DELTA, EDIT, REGENERATE)
    g = log.groupBy("conv_id", "turn", "message").agg(
        F.min_by("role", F.when(F.col("event") == OPENED, F.struct("seq", "role"))).alias("role"),
        F.max(F.when(reset, row)).alias("last"), F.sort_array(F.collect_list(F.when(said, row))).alias("rows"))
    live = F.filter("rows", lambda r: F.col("last").isNull() | (r > F.col("last")) | ((r == F.col("last")) & (r["event"] == EDIT)))
    return g.select("conv_id", "turn", "role", F.array_join(F.transform(live, lambda r: r["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, turn, formatted, loss_from, loss_to (code points of ``formatted`` that the loss mask
    covers; both null outside assistant turns). Null roles and texts count as empty. Rows that share conv_id and turn
    are rendered each; extra columns stay."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role), F.lit(MID))
    body = escape(text)
    start = F.length(head)
    d = messages.withColumns({
        "formatted": F.concat(head, body, F.lit(CLOSE)),
        "loss_from": F.when(role == loss_role, start), "loss_to": F.when(role == loss_role, start + F.length(body))})
    return d.drop("role", "text")


def read_back(rendered: DataFrame) -> DataFrame:
    """role, text, and masked (text under the loss mask, unescaped; null if none) from ``formatted`` alone and its mask."""
    f = F.col("formatted")
    mid = F.locate(MID, f, len(OPEN) + 1)  # an escaped role holds no control string
    role = F.substring(f, len(OPEN) + 1, mid - len(OPEN) - 1)
    text = F.substring(f, mid + len(MID), F.length(f) - mid - len(MID) - len(CLOSE) + 1)
    masked = F.substring(f, F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from"))
    return rendered.withColumns({"role": unescape(role), "text": unescape(text), "masked": unescape(masked), "chars": F.length(f)})


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order, read as one stream.

    turns: conv_id, turn, role, text, masked, chars. A digest of a whole conversation has to see its turns in order;
    they are sorted by Spark and streamed, so a task keeps one hash state and no text. Null conv_id is a conversation
    of its own. Rows that share conv_id and turn go by role and text.
    """
    p = F.array_compact(F.array(F.concat("role", F.lit("\n"), "text", F.lit("\n"))))
    d = turns.select(F.col("conv_id"), "turn", "role", "text", F.element_at(p, 1).alias("said"), "masked", F.length("masked").alias("n_masked"), "chars")
    d = d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("role", "text", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        started, conv, said, loss, n, lost, chars = False, None, None, None, 0, 0, 0

        def row():
            return (conv, n, said.hexdigest(), lost, loss.hexdigest(), chars)

        def batch(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = zip(*rows) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            rows = []
            cols = [b.column(c) for c in ("conv_id", "said", "masked", "n_masked", "chars")]
            for c, s, m, k, size in zip(*cols):
                c = c.as_py()
                if not started or c != conv:
                    if started:
                        rows.append(row())
                    started, conv, said, loss, n, lost, chars = True, c, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                said.update(s.as_py().encode())
                n, chars = n + 1, chars + size.as_py()
                if m.is_valid:
                    loss.update(m.as_py().encode())
                    lost += k.as_py()
            yield batch(rows)
        if started:
            yield batch([row()])

    return d.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def event_log(turns: DataFrame, piece: int = 200) -> DataFrame:
    """A log as a chat service would have written it for finished turns (conv_id, turn, role, text): every message is
    opened; user messages are typed wrongly and edited, assistant messages are streamed, thrown away after the first
    piece, and streamed anew. Folding it gives the turns back. Null texts come back empty."""
    text = F.coalesce("text", F.lit(""))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / piece)), lambda i: F.substring(text, (i * piece + 1).cast("int"), F.lit(piece)))
    none = F.lit("").cast("string")

    def ev(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("event"), value.alias("text"))

    assistant = F.concat(
        F.array(ev(OPENED, none), ev(DELTA, F.element_at(pieces, 1)), ev(REGENERATE, none)), F.transform(pieces, lambda x: ev(DELTA, x)))
    other = F.array(ev(OPENED, none), ev(DELTA, F.reverse(text)), ev(EDIT, text))
    d = turns.withColumn("message", F.monotonically_increasing_id()).withColumn("_e", F.when(F.col("role") == "assistant", assistant).otherwise(other))
    d = d.select("conv_id", "turn", "message", "role", F.posexplode("_e").alias("seq", "_e"))
    return d.select("conv_id", "turn", "message", "seq", F.col("_e.event").alias("event"), F.when(F.col("_e.event") == OPENED, F.col("role")).alias("role"), F.col("_e.text").alias("text"))
