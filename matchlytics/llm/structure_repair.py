"""Cheapest repairs of the turn structure of conversations, by an automaton of their suffixes.

Each turn becomes one letter of a signature: the class of its role (`s`ystem, `u`ser, `a`ssistant, `o`ther), in capitals where
the text is cut off, or `x` where the turn must go (blank, or a copy of an earlier turn). A repaired conversation reads
`(s?(ua)+)?`, so after the turns so far it is in one of four grammar states, and each state allows one role for a turn that is inserted
or gets a new role. The cheapest edits from a turn on depend on the state and on the signature from there to the end only.

Signatures are therefore minimised from the end: all distinct ones of all conversations are sorted backwards, and a walk down the sorted
list makes one automaton node for each distinct suffix (a word shares the nodes of the stretch it has in common with the
word before). A node holds, for each of the four states, the cost to go and the first edit of the best audit, which goes on in
another cell; audits are only written out for whole words. Of equally cheap edits the first letter of the audit decides, because the
options differ in it.

Long conversations are cut into blocks of `block` turns, counted from the end. For all signatures of such conversations a first walk finds
the cost from every state to every state; a pass backwards over the blocks of a conversation adds these up and gives each block the cost
to go behind it, relative to the least; blocks with equal signature and equal costs behind them are one word of the second walk; a
pass forward picks the audit of the state in which a block is entered. A conversation with a third of all turns is thus
marked, numbered and solved in many tasks. Only its repaired text goes through one task as a stream, row by row, because its SHA-256
cannot be split; that task keeps one audit letter per turn.

Order of a conversation: turn (nulls first), role, the first 64 code points of the text, SHA-256 of role and text. Null role or text reads as
one space; a null conversation id is a conversation of its own; repeated rows are duplicates of the first; texts are
compared by SHA-256 of role and text, whole; an empty table gives an empty result; other columns are ignored, whatever their names.
A span of turns beyond 64 bits counts as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import with_position
from .common import kept_table

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: State after the role that the grammar wants next; the same for inserted turns and turns with a new role.
NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
ROLES = {AFTER_USER: "user", AFTER_ASSISTANT: "assistant"}
#: State after a kept turn, by the class of its role and the state before.
KEEP = {"s": {START: AFTER_SYSTEM}, "u": {START: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_ASSISTANT: AFTER_USER}, "a": {AFTER_USER: AFTER_ASSISTANT}, "o": {}}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
NEVER = 1 << 30
#: Costs behind the last turn by state: done, two insertions, one insertion, done; 1 marks the end of a conversation.
END = (0, 2 * INSERT, INSERT, 0, 1)
_KEYS = ["_none", "_id"]
_BLANKS = " \t\n\x0b\x0c\r"


def _base(costs):
    """The node of the empty suffix. A cell is (letter, next cell); the last cell of an audit is the state that it ends in."""
    if costs[4]:
        last = ("I", AFTER_ASSISTANT)
        return costs[:4], (START, ("I", last), last, AFTER_ASSISTANT)
    return costs[:4], (START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT)


def grown(letter: str, node):
    """The node of a suffix with one more turn in front: cost to go and first edit for each state."""
    costs, cells = node
    steps = []
    cut = CUT_OFF if letter.isupper() else 0
    keep = KEEP.get(letter.lower())
    for q in range(4):
        best = (costs[q] + DELETE, "D", cells[q])
        if keep is not None:  # else the turn must go
            if q in keep and (c := costs[keep[q]] + cut) < best[0]:
                best = (c, "K", cells[keep[q]])
            if (c := costs[NEXT[q]] + REROLE + cut) < best[0]:
                best = (c, "R", cells[NEXT[q]])
        steps.append(best)
    # turns inserted before this one; going round from user to assistant to user again never pays
    solved: list = [None] * 4
    for q in (AFTER_USER, AFTER_ASSISTANT, START, AFTER_SYSTEM):
        there = steps[NEXT[q]]
        if q in (START, AFTER_SYSTEM):
            there = solved[AFTER_USER]
        c, first, _ = steps[q]
        if there[0] + INSERT < c or (there[0] + INSERT == c and first > "I"):
            solved[q] = (there[0] + INSERT, "I", (there[1], there[2]))
        else:
            solved[q] = steps[q]
    return tuple(s[0] for s in solved), tuple((s[1], s[2]) for s in solved)


def written(cell) -> tuple[str, int]:
    """The letters of an audit and the state that it ends in."""
    out = []
    while not isinstance(cell, int):
        out.append(cell[0])
        cell = cell[1]
    return "".join(out), cell


def _walk(frames: Iterator[pd.DataFrame], spell: bool) -> Iterator[pd.DataFrame]:
    """For mapInPandas: words `back` (reversed signatures) in sorted order, with the costs `behind` them."""
    word, behind, nodes = "", None, []
    for frame in frames:
        rows = []
        for back, costs in zip(frame["back"], frame["behind"]):
            costs = tuple(int(c) for c in costs)
            if costs != behind:
                word, behind, nodes = "", costs, [_base(costs)]
            shared = 0
            for a, b in zip(word, back):
                if a != b:
                    break
                shared += 1
            del nodes[shared + 1:]
            for letter in back[shared:]:
                nodes.append(grown(letter, nodes[-1]))
            word = back
            least, cells = nodes[-1]
            audits = [written(c) for c in cells] if spell else []
            rows.append((back, list(costs), list(least), [a for a, _ in audits], [e for _, e in audits]))
        yield pd.DataFrame(rows, columns=["back", "behind", "costs", "audits", "exits"])


def _solved(words: DataFrame, *, spell: bool) -> DataFrame:
    """Costs of all words (back, behind) by state and, if asked for, their audits and the states that these end in."""
    return words.orderBy("behind", "back").mapInPandas(
        lambda frames: _walk(frames, spell), "back string, behind array<int>, costs array<int>, audits array<string>, exits array<int>")


def _in_order(df: DataFrame, *order) -> DataFrame:
    return df.repartition(*_KEYS).sortWithinPartitions(*_KEYS, *order)


def _backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks from the last to the first of each conversation: the costs to go behind each, the least of them taken off."""
    key = v = last = None
    for frame in frames:
        out = []
        for none, no, block, costs in zip(frame["_none"], frame["_id"], frame["block"], frame["matrix"]):
            if (none, no) != key:
                key, v, last = (none, no), np.array(END[:4]), 1
            out.append([*(int(c) for c in v), last])
            m = np.stack(list(costs)).astype(np.int64)  # [state at the end][state at the beginning]
            v, last = (m + v[:, None]).min(axis=0), 0
            v = v - v.min()
        yield frame[[*_KEYS, "block", "back"]].assign(behind=out)


def _forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks from the first to the last of each conversation: audit and cost of each, entered in the state the one before left."""
    key = q = last = None
    for frame in frames:
        out = []
        for none, no, first, end, costs, behind, audits, exits in zip(*(frame[c] for c in ("_none", "_id", "first", "last", "costs", "behind", "audits", "exits"))):
            if (none, no) != key:
                key, q, last = (none, no), START, None
            torn = int(last is not None and last + first not in ("su", "ua", "au"))
            leave = int(exits[q])
            # END counts its own insertions, they are part of the audit
            rest = 0 if behind[4] else int(behind[leave])
            out.append((audits[q], int(costs[q]) - rest, torn))
            q, last = leave, end
        yield frame[[*_KEYS, "block"]].assign(audit=[o[0] for o in out], cost=[o[1] for o in out], torn=[o[2] for o in out])


def _repaired(frames: Iterator[pd.DataFrame]):
    """(key, no, role, text, edit) of all rows of all conversations; a conversation's audit comes before its turns. Ends
    each conversation with (key, None, ...)."""
    key, audit, at, state, no = None, "", 0, START, 0
    for frame in frames:
        for none, i, spec, turn_role, text in zip(frame["_none"], frame["_id"], frame["audit"], frame["role"], frame["text"]):
            if isinstance(spec, str):
                if key is not None:
                    for _ in audit[at:]:
                        state = NEXT[state]
                        yield key, no, ROLES[state], "", "I"
                        no += 1
                    yield key, None, None, None, None
                key, audit, at, state, no = (none, i), spec, 0, START, 0
                continue
            while audit[at] == "I":
                state = NEXT[state]
                yield key, no, ROLES[state], "", "I"
                at, no = at + 1, no + 1
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "K":
                state = KEEP[turn_role[:1]][state]
            else:
                state = NEXT[state]
                turn_role = ROLES[state]
            yield key, no, turn_role, text, edit
            no += 1
    if key is not None:
        for _ in audit[at:]:
            state = NEXT[state]
            yield key, no, ROLES[state], "", "I"
            no += 1
        yield key, None, None, None, None


def _rows(frames, piece: int = 512):
    out = []
    for key, no, role, text, edit in _repaired(frames):
        if no is not None:
            out.append((*key, no, role, text, edit))
        if len(out) == piece:
            yield pd.DataFrame(out, columns=[*_KEYS, "no", "role", "text", "edit"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=[*_KEYS, "no", "role", "text", "edit"])


def _digests(frames, piece: int = 4096):
    out, digest = [], hashlib.sha256()
    for key, no, role, text, _ in _repaired(frames):
        if no is None:
            out.append((*key, digest.hexdigest()))
            digest = hashlib.sha256()
        else:
            digest.update(f"{chr(10) if no else ''}{role}:{text}".encode())
        if len(out) == piece:
            yield pd.DataFrame(out, columns=[*_KEYS, "sha"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=[*_KEYS, "sha"])


class Repair:
    """Faults and cheapest repairs of conversations (conv_id, turn, role, text)."""

    def __init__(self, conversations: DataFrame, *, block: int = 1024, span: int = 4096):
        kind = self.kind = dict(conversations.dtypes)["conv_id"]
        space = lambda c: F.coalesce(F.col(c), F.lit(" "))
        rows = conversations.select(F.col("conv_id").isNull().alias("_none"), F.coalesce("conv_id", F.lit(0).cast(kind)).alias("_id"),
                                    F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
        self.turns = rows.withColumns({
            "head": F.left("text", F.lit(64)),
            "digest": F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))})
        self.order = ["turn", "role", "head", "digest"]
        end = F.rtrim("text", F.lit(_BLANKS))
        light = self.turns.select(*_KEYS, *self.order, (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
        seen = F.row_number().over(Window.partitionBy(*_KEYS, "digest").orderBy(*self.order)) > 1
        head = F.substring("role", 1, 1)
        role = F.when(head.isin("s", "u", "a"), head).otherwise(F.lit("o"))
        fault = F.when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("cut"), "truncated")
        light = light.withColumns({"fault": fault, "kind": role})
        letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("kind")).otherwise(F.col("kind"))
        self.marks = kept_table(light.select(*_KEYS, *self.order, "fault", "kind", letter.alias("letter")), "turn-marks")
        self.audited = self._audits(block, span)

    def _audits(self, block: int, span: int) -> DataFrame:
        part = F.coalesce(F.floor(F.col("turn") / span).cast("long"), F.lit(-(1 << 62)))
        rows = with_position(self.marks, _KEYS, self.order, bucket=part, name="pos", total="total")
        rows = rows.withColumn("block", F.floor((F.col("total") - 1 - F.col("pos")) / block).cast("long"))
        turn = F.struct("pos", "letter", "kind")
        rows = (rows.groupBy(*_KEYS, "block").agg(F.sort_array(F.collect_list(turn)).alias("_t"), F.max("total").alias("_n"))
                .select(*_KEYS, "block", (F.col("_n") > block).alias("many"), F.reverse(F.array_join(F.transform("_t", lambda t: t["letter"]), "")).alias("back"),
                        F.transform("_t", lambda t: t["kind"]).alias("kinds")))
        pair = F.filter("kinds", lambda k, i: (i > 0) & ~F.concat(F.get("kinds", i - 1), k).isin("su", "ua", "au"))
        rows = rows.select(*_KEYS, "block", "many", "back", F.get("kinds", F.lit(0)).alias("first"), F.try_element_at("kinds", F.lit(-1)).alias("last"), F.size(pair).alias("wrong"))
        rows = kept_table(rows, "signatures")
        end = F.array(*[F.lit(c) for c in END])
        short, long = rows.filter("not many").withColumn("behind", end), rows.filter("many")
        # from every state to every state, for the signatures of long conversations only
        to = F.explode(F.array(*[F.array(*[F.lit(0 if q == e else NEVER) for q in range(4)], F.lit(0)) for e in range(4)]))
        costs = _solved(long.select("back").distinct().withColumn("behind", to), spell=False)
        matrix = costs.groupBy("back").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.array_position("behind", F.lit(0)).alias("e"), "costs"))), lambda c: c["costs"]).alias("matrix"))
        behind = (_in_order(long.join(matrix, "back").select(*_KEYS, "block", "back", "matrix"), "block")
                  .mapInPandas(_backward, "_none boolean, _id " + dict(rows.dtypes)["_id"] + ", block long, back string, behind array<int>"))
        long = long.join(behind, [*_KEYS, "block", "back"])
        rows = kept_table(short.unionByName(long), "words")
        words = _solved(rows.select("back", "behind").distinct(), spell=True)
        rows = rows.join(words, ["back", "behind"])
        chosen = (_in_order(rows.select(*_KEYS, "block", "first", "last", "behind", "costs", "audits", "exits"), F.desc("block"))
                  .mapInPandas(_forward, "_none boolean, _id " + dict(rows.dtypes)["_id"] + ", block long, audit string, cost long, torn long"))
        sums = chosen.groupBy(*_KEYS).agg(F.sum("cost").alias("cost"), F.sum("torn").alias("torn"),
                                          F.sort_array(F.collect_list(F.struct((-F.col("block")).alias("b"), "audit"))).alias("_a"))
        sums = sums.select(*_KEYS, "cost", "torn", F.array_join(F.transform("_a", lambda a: a["audit"]), "").alias("audit"))
        wrong = rows.groupBy(*_KEYS).agg(F.sum("wrong").alias("wrong"))
        return kept_table(sums.join(wrong, _KEYS).select(*_KEYS, "cost", "audit", (F.col("torn") + F.col("wrong")).alias("illegal")), "audits")

    def _stream(self) -> DataFrame:
        turns = self.turns.withColumn("audit", F.lit(None).cast("string"))
        audits = self.audited.select(*_KEYS, "audit", *[F.lit(None).cast(dict(turns.dtypes)[c]).alias(c) for c in ("turn", "role", "text", "head", "digest")])
        return _in_order(turns.unionByName(audits), F.col("audit").isNull(), *self.order).select(*_KEYS, "audit", "role", "text")

    def _named(self, df: DataFrame, *cols) -> DataFrame:
        return df.select(F.when(~F.col("_none"), F.col("_id")).cast(self.kind).alias("conv_id"), *cols)

    def rows(self) -> DataFrame:
        """Repaired conversations: number in the conversation, role, text and the edit that made the row (Keep, Rerole, Insert)."""
        kinds = dict(self.turns.dtypes)
        made = self._stream().mapInPandas(_rows, f"_none boolean, _id {kinds['_id']}, no long, role string, text string, edit string")
        return self._named(made, "no", "role", "text", "edit")

    def report(self, ids: DataFrame) -> DataFrame:
        """Faults, cost, audit and digest of the repaired rows for all ids (conv_id) asked for, turns or not."""
        turns = self.marks.groupBy(*_KEYS, "turn").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
        span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count("turn")
        faults = turns.groupBy(*_KEYS).agg(F.least(F.coalesce(span, F.lit(0)), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("gaps"),
                                           *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
        digests = self._stream().mapInPandas(_digests, f"_none boolean, _id {dict(self.turns.dtypes)['_id']}, sha string")
        asked = ids.select(F.col("conv_id").isNull().alias("_none"), F.coalesce("conv_id", F.lit(0).cast(self.kind)).alias("_id"), F.lit(True).alias("asked")).distinct()
        parts = asked.unionByName(faults, True).unionByName(self.audited, True).unionByName(digests, True)
        one = lambda c, none: F.coalesce(F.max(c), F.lit(none)).alias(c)
        numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        rows = parts.groupBy(*_KEYS).agg(F.max("asked").alias("asked"), *[one(c, 0) for c in numbers], one("audit", ""),
                                         F.coalesce(F.max("sha"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
        return self._named(rows.filter("asked"), *[F.col(c).cast("long").alias(c) for c in numbers], "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations as a careless export would leave them: by a hash of conversation and turn some turns are lost, emptied, without their
    full stops, sent twice, or all said by the user."""
    text: Column = F.coalesce("text", F.lit(" "))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.withColumn("_d", F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20)
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("_d") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    return rows.filter("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                         F.explode(F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1))).alias("_n")).drop("_n")
