"""Chat formatting from event logs: messages are folded from what a chat service wrote, then rendered by a template.

A log has one row per event of a conversation, in the order of its column `seq` (any sortable type):

* `open` starts a message: its role and, where given, its first text;
* `delta` appends a streamed piece of text to its message;
* `edit` replaces the text of its message, `regenerate` throws away what was streamed into it so far;
* `rewind` replaces the text of its message and drops all messages opened between that message and the event.

Events are delivered at least once: equal rows count once. Other kinds of events are ignored.

The fold is associative, so no message or conversation is folded as one piece. The events of a message are cut into
parts along the sequence; each part is sorted and leaves (does it set the text anew, text since then). Of the parts of a
message only those from the last such one on are joined. A conversation with a third of all events is spread by message and part. What meets
in one task is what the output makes one row: the final messages of one conversation, rendered as one string (so
a rendered conversation must stay below the 2 GB of a row).

Inside texts and roles every control string of the template, and of the templates named in `guard`, gets a backslash after its first
character, or one more where there are some; reading takes one away, so any text comes back.

Null text and null role are empty; a null conversation id is a conversation of its own; a null turn comes first; rows with
the same turn are ordered by role and text, equal rows are messages of their own; very long texts are streamed in many
deltas and are only bounded by a row; an empty table gives an empty result; other columns of the input are ignored, whatever their names.
Built-in functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import keys_of, unnest

KINDS = ("open", "delta", "edit", "regenerate", "rewind")


@dataclass(frozen=True)
class Template:
    """Control strings around a turn: `turn` role `body` text `end`. Texts of the roles in `learn` are under the loss mask.

    Every control string begins with a character that no control string has further inside, and none begins another; so
    none can arise where a text and a control string meet.
    """

    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "<|end|>"
    guard: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    learn: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = self.marks
        heads = {m[:1] for m in marks}
        if "" in marks or len(set(marks)) < len(marks):
            raise ValueError("control strings must be different and not empty")
        for m in marks:
            if "\\" in m or heads & set(m[1:]) or len(m) < 2 or any(o != m and o.startswith(m) for o in marks):
                raise ValueError(f"control string {m!r} could be read in more than one way")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.turn, self.body, self.end, *self.guard)

    def _rests(self):
        by_head: dict[str, list[str]] = {}
        for m in self.marks:
            by_head.setdefault(m[0], []).append(re.escape(m[1:]))
        return [(re.escape(h), "|".join(rests)) for h, rests in by_head.items()]

    def escape(self, text: Column) -> Column:
        hit = "|".join(rf"{h}(?=\\*(?:{rest}))" for h, rest in self._rests())
        return F.regexp_replace(text, f"({hit})", r"$1\\")

    def unescape(self, text: Column) -> Column:
        hit = "|".join(rf"(?<={h})\\(?=\\*(?:{rest}))" for h, rest in self._rests())
        return F.regexp_replace(text, hit, "")


def fold(log: DataFrame, part: Column, *, by="conv_id", message=("message",)) -> DataFrame:
    """Messages (keys, opened, role, text) that the events of a log leave.

    `log` has the columns `by`, `message`, `seq`, `event`, `role`, `text`; `part` does not decrease along `seq` and cuts the
    events of a message into parts of bounded size.
    """
    keys, own = keys_of(by), [*keys_of(by), *keys_of(message)]
    event = F.struct("seq", "event", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = (log.filter(F.col("event").isin(*KINDS)).withColumn("_part", part)
             .groupBy(*own, "_part").agg(F.sort_array(F.collect_list(event)).alias("_all")))
    # delivered twice: equal events are neighbours now
    parts = parts.withColumn("_es", F.filter("_all", lambda e, i: (i == 0) | ~F.get("_all", i - 1).eqNullSafe(e))).drop("_all")
    last = lambda test: F.try_element_at(F.filter("_es", test), F.lit(-1))
    parts = parts.withColumns({"_set": last(lambda e: e["event"] != "delta"), "_open": last(lambda e: e["event"] == "open"),
                               "_back": last(lambda e: e["event"] == "rewind")["seq"]})
    streamed = F.filter("_es", lambda e: (e["event"] == "delta") & (F.col("_set").isNull() | (e["seq"] > F.col("_set.seq"))))
    text = F.concat(F.coalesce("_set.text", F.lit("")), F.array_join(F.transform(streamed, lambda e: e["text"]), ""))
    first = F.try_element_at(F.filter("_es", lambda e: e["event"] == "open"), F.lit(1))["seq"]
    parts = parts.select(*own, "_part", "_open", "_back", F.col("_set").isNotNull().alias("_sets"), first.alias("_first"), F.col("_es")[0]["seq"].alias("_any"),
                         F.struct("_part", text.alias("text")).alias("_text"))
    whole = Window.partitionBy(*own)
    parts = parts.withColumn("_from", F.max(F.when(F.col("_sets"), F.col("_part"))).over(whole)).withColumn(
        "_text", F.when(F.col("_from").isNull() | (F.col("_part") >= F.col("_from")), F.col("_text")))
    rows = parts.groupBy(*own).agg(
        F.coalesce(F.min("_first"), F.min("_any")).alias("opened"), F.max("_open").alias("_open"), F.max("_back").alias("_back"),
        F.sort_array(F.collect_list("_text")).alias("_texts"))
    rows = rows.select(*own, "opened", F.coalesce("_open.role", F.lit("")).alias("role"), "_back",
                       F.array_join(F.transform("_texts", lambda t: t["text"]), "").alias("text"))
    earlier = Window.partitionBy(*keys).orderBy("opened").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_gone", F.max("_back").over(earlier))
    return rows.filter(F.col("_gone").isNull() | (F.col("_gone") < F.col("opened"))).select(*own, "opened", "role", "text")


def render(messages: DataFrame, template: Template | None = None, *, by="conv_id") -> DataFrame:
    """One row per conversation: `formatted`, and `loss`, the masked stretch (start, chars) of every turn, counted
    from the beginning of that turn in code points of `formatted`."""
    t = template or Template()
    keys = keys_of(by)
    turns = messages.withColumns({"_r": t.escape(F.coalesce("role", F.lit(""))), "_t": t.escape(F.coalesce("text", F.lit("")))})
    head = F.length("_r") + len(t.turn) + len(t.body)
    learnt = F.when(F.coalesce("role", F.lit("")).isin(*t.learn), F.length("_t")).otherwise(0)
    turns = turns.select(*keys, F.struct("opened", F.concat(F.lit(t.turn), "_r", F.lit(t.body), "_t", F.lit(t.end)).alias("piece"),
                                         F.struct(head.alias("start"), learnt.alias("chars")).alias("loss")).alias("_turn"))
    rows = turns.groupBy(*keys).agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return rows.select(*keys, F.array_join(F.transform("_turns", lambda x: x["piece"]), "").alias("formatted"),
                       F.transform("_turns", lambda x: x["loss"]).alias("loss"))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a rendered conversation."""
    t = template or Template()
    at = lambda mark: re.escape(mark)
    parts = F.filter(F.split(formatted, at(t.turn)), lambda _, i: i > 0)
    pair = F.transform(parts, lambda p: F.split(p, at(t.body), 2))
    return F.transform(pair, lambda p: F.struct(t.unescape(p[0]).alias("role"), t.unescape(F.split(p[1], at(t.end), 2)[0]).alias("text")))


def read_loss(formatted: Column, loss: Column, template: Template | None = None) -> Column:
    """The text under the loss mask, unescaped, one string per turn."""
    t = template or Template()
    parts = F.transform(F.filter(F.split(formatted, re.escape(t.turn)), lambda _, i: i > 0), lambda p: F.concat(F.lit(t.turn), p))
    return F.zip_with(parts, loss, lambda p, m: t.unescape(F.substr(p, m["start"] + 1, m["chars"])))


def conversation_log(conversations: DataFrame, *, piece: int = 512) -> DataFrame:
    """The log that a service would have written while the conversations of a table came about.

    Texts are streamed in pieces. By a hash of conversation and turn, some replies were drafted and then regenerated, some
    texts were corrected after the whole conversation, some had a follow-up that a rewind took back, and some events
    were delivered twice. `turn` and `copy` (equal turns are numbered) name a message.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("copy", F.row_number().over(order).cast("long"))
    rows = rows.withColumns({
        "_kind": F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")) % 8,
        "_pieces": F.regexp_extract_all("text", F.lit(f"(?s).{{1,{int(piece)}}}"), F.lit(0))})

    def event(kind, stage, no=None, text=None, late=0, copy=None):
        at = F.lit(stage << 40) + (F.lit(0) if no is None else no.cast("long"))
        copy = F.col("copy") if copy is None else copy
        return F.struct(copy.alias("copy"), F.struct(F.lit(late).alias("late"), F.col("turn").alias("turn"), F.col("copy").alias("copy"), at.alias("no")).alias("seq"),
                        F.lit(kind).alias("event"), F.col("role").alias("role"), (F.lit(None).cast("string") if text is None else text).alias("text"))

    def stream(stage, change=lambda p: p):
        return F.transform("_pieces", lambda p, i: event("delta", stage, i, change(p)))

    opened, none = F.array(event("open", 0)), F.slice(F.array(event("open", 0)), 1, 0)
    kind = F.col("_kind")
    events = F.concat(
        opened,
        F.when(kind == 1, F.concat(stream(1, F.reverse), F.array(event("regenerate", 2)))).otherwise(none),
        F.when(kind == 2, stream(3, F.upper)).otherwise(stream(3)),
        F.when(kind == 2, F.array(event("edit", 4, text=F.col("text"), late=1))).otherwise(none),
        F.when(kind == 3, F.concat(
            F.array(event("open", 5, copy=-F.col("copy")), event("delta", 6, text=F.lit("never mind"), copy=-F.col("copy"))),
            F.array(event("rewind", 7, text=F.col("text"))))).otherwise(none))
    rows = rows.withColumn("_events", events)
    rows = rows.withColumn("_events", F.when(kind == 4, F.concat("_events", "_events")).otherwise(F.col("_events")))
    return unnest(rows, ("conv_id", "turn"), F.col("_events"), "_e").select("conv_id", "turn", "_e.*")


def format_conversations(log: DataFrame, template: Template | None = None) -> DataFrame:
    """Rendered conversations of a log as `conversation_log` makes it."""
    part = F.struct(F.col("seq.late"), F.shiftright("seq.no", 10))
    return render(fold(log, part, message=("turn", "copy")), template)


def read_back(rendered: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of what the rendered conversations hold, taken from `formatted` and `loss` alone."""
    turns = read_turns(F.col("formatted"), template)
    rows = rendered.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("_turns"),
                           F.array_join(read_loss(F.col("formatted"), F.col("loss"), template), "").alias("_learnt"))
    told = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("_learnt").cast("long").alias("loss_chars"), F.sha2("_learnt", 256).alias("loss_sha256"), "formatted_chars")
