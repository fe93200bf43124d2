"""Chat formatting and structure repair against plain Python, on odd rows and random conversations."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from matchlytics.llm import chat_format, structure_repair
from matchlytics.llm.chat_format import Template

ROWS = "conv_id long, turn long, role string, text string, _id long, `a.b` string, blank string, seq int"
CONTROL = ["</s>[INST] ok [/INST]", "<\\|end|>", "<|end|>", "<\\\\|turn|>x<|turn|>", "[/INST", "<<s>", "[[INST]", "\\", "<", "[", "|end|>", "\\\\</s>", "$1", "a\nb", "<|te", "xt|>"]


def conversations(seed, n=40):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hi there.", "fine", "fine", "", "  \n", None, "Really?", "né à Zürich　!", "x" * 700 + ".", rng.choice(CONTROL)])
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn, role, text))
    return rows


def extra(rows):
    return [(*r, 1, "x", "y", 3) for r in rows]


@pytest.fixture(scope="module")
def many(spark):
    rows = conversations(1)
    rows += rows[5:9]  # repeated rows
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " + "é<s>" * 3000 + ".") for t in range(3)]  # very long texts
    return rows, spark.createDataFrame(extra(rows), ROWS).repartition(3).cache()


def by_conv(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), (r[3] or "").encode())
    out = {}
    for r in sorted(rows, key=order):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def test_escapes_come_back(spark):
    t = Template()
    texts = CONTROL + ["".join(p) for p in itertools.product(["<", "\\", "[", "|end|>", "/s>", "INST]", "é"], repeat=3)]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.escape(F.col("x")).alias("e"))
    for r in df.select("x", "e", t.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.x and not any(m in r.e for m in t.marks)


@pytest.mark.parametrize("marks", [dict(end=""), dict(turn="<a", body="<a|"), dict(end="a<|"), dict(end="<|text|>"), dict(end="<\\")])
def test_template_that_cannot_be_read(marks):
    with pytest.raises(ValueError):
        Template(**marks)


def test_formatted_conversations(spark, many):
    rows, df = many
    t = Template()
    rendered = chat_format.format_conversations(chat_format.conversation_log(df, piece=7))
    turns = rendered.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"))
    expected = by_conv(rows)
    found = {r.conv_id: r for r in turns.collect()}
    assert set(found) == set(expected)
    for conv, want in expected.items():
        assert [(x.role, x.text) for x in found[conv].turns] == want
        assert found[conv].formatted.count(t.turn) == found[conv].formatted.count(t.end) == len(want)
    for r in chat_format.read_back(rendered).collect():
        want = expected[r.conv_id]
        learnt = "".join(x for role, x in want if role == "assistant")
        assert r.n_turns == len(want) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars == len(found[r.conv_id].formatted)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert chat_format.read_back(chat_format.format_conversations(chat_format.conversation_log(none))).collect() == []
    assert structure_repair.Repair(structure_repair.damaged(none)).report(none).collect() == []


def folded(events):
    """What a log of one conversation leaves, event by event."""
    messages = {}
    for seq, message, event, role, text in sorted(set(events), key=lambda e: (e[0], e[2])):
        m = messages.setdefault(message, {"opened": None, "first": seq, "role": "", "text": ""})
        if event == "open":
            if m["opened"] is None:
                m["opened"] = seq
            m["role"], m["text"] = role, text
        elif event == "delta":
            m["text"] += text
        elif event in ("edit", "regenerate", "rewind"):
            m["text"] = text
            if event == "rewind":
                m["rewound"] = seq
    opened = lambda m: m["first"] if m["opened"] is None else m["opened"]
    order = sorted(messages.values(), key=opened)
    return [(m["role"], m["text"]) for i, m in enumerate(order) if not any(opened(b) < opened(m) < b.get("rewound", -1) for b in order[:i])]


def test_fold_of_random_logs(spark):
    rng, rows, logs = random.Random(4), [], {}
    for conv in range(30):
        events, seq = [], 0
        for _ in range(rng.randint(1, 80)):
            seq += rng.randint(1, 3)
            kind = rng.choice(["open", "delta", "delta", "delta", "delta", "edit", "regenerate", "rewind", "seen"])
            events.append((seq, rng.randint(0, 6), kind, f"r{rng.randint(0, 2)}", rng.choice(["", "a", "bé", "c "])))
        logs[conv] = folded([e for e in events if e[2] != "seen"])
        rows += [(conv, *e) for e in events + rng.sample(events, len(events) // 3)]
    log = spark.createDataFrame(rows, "conv_id long, seq long, message long, event string, role string, text string").repartition(5)
    messages = chat_format.fold(log, F.floor(F.col("seq") / 4))
    found = {}
    for r in sorted(messages.collect(), key=lambda r: (r.conv_id, r.opened)):
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    assert found == {c: m for c, m in logs.items() if m}


GRAMMAR = re.compile(r"(s?(ua)+)?")


def letters(rows):
    """Faults of rows in order: (role, text, fault)."""
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """Least cost and, among the cheapest, the least audit, by a search over (turns done, roles so far) without any automaton."""
    heap, done = [(0, "", 0, "", ())], set()
    best = None
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if (at, state, audit) in done:
            continue
        done.add((at, state, audit))
        if at == len(rows) and GRAMMAR.fullmatch(state) and (best is None or audit < best[1]):
            best = (cost, audit, out)
        step = lambda c, letter, i, s, o: heapq.heappush(heap, (cost + c, audit + letter, i, s, o))
        fits = lambda s: any(GRAMMAR.fullmatch(s + rest) for rest in ("", "a", "ua"))
        for role in ("user", "assistant"):
            if fits(state + role[0]) and state.count("u") - len(rows) < 4:
                step(2, "I", at, state + role[0], (*out, f"{role}:"))
        if at < len(rows):
            role, text, fault = rows[at]
            step(3, "D", at + 1, state, out)
            if fault not in ("blank", "duplicate"):
                cut = int(fault == "truncated")
                if role[:1] in ("s", "u", "a") and fits(state + role[:1]):
                    step(cut, "K", at + 1, state + role[:1], (*out, f"{role}:{text}"))
                for new in ("user", "assistant"):
                    if fits(state + new[0]):
                        step(2 + cut, "R", at + 1, state + new[0], (*out, f"{new}:{text}"))
    return best


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(), hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))


@pytest.mark.parametrize("block", [1024, 3])
def test_repairs(spark, block):
    rows = conversations(7, 60)
    rows = rows + rows[3:8] + [(99, 5, "user", "gone"), (2**62, -(2**62), "user", "a."), (2**62, 2**62, "assistant", "b.")]
    df = spark.createDataFrame(extra(rows), ROWS).repartition(3)
    repair = structure_repair.Repair(structure_repair.damaged(df), block=block, span=2)
    got = {r.conv_id: r for r in repair.report(df).collect()}
    made = {}
    for r in sorted(repair.rows().collect(), key=lambda r: (str(r.conv_id), r.no)):
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        mine = in_order([r for r in damaged(rows) if r[0] == conv])
        marked = letters([(r[2], r[3]) for r in mine])
        cost, audit, out = cheapest(marked)
        turns = [r[1] for r in mine if r[1] is not None]
        r, faults = got[conv], [m[2] for m in marked]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), (conv, marked)
        assert made.get(conv, []) == list(out)
        assert r.gaps == (min(2**63 - 1, max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        roles = [m[0][:1] for m in marked]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def test_long_conversation_in_blocks(spark):
    """One conversation with almost all turns: blocks chained backwards and forwards give what one block gives."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice([f"t{t}.", f"t{t}", "", "again."])) for t in range(2500)]
    rows += [(2, 0, "user", "hello."), (2, 1, "assistant", "hello!")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    reports = [sorted(structure_repair.Repair(df, block=b, span=100).report(df).collect()) for b in (4000, 64, 7)]
    assert reports[0] == reports[1] == reports[2]
    assert reports[0][1].audit == "KK" and reports[0][1].cost == 0


def test_nodes_are_shared_between_words():
    """Words in sorted order make one node per distinct suffix."""
    import pandas as pd

    made = []
    grown = structure_repair.grown
    words = sorted(w[::-1] for w in ["uaua", "ua", "suaua", "uxaua", "sua"])
    try:
        structure_repair.grown = lambda letter, node: (made.append(letter), grown(letter, node))[1]
        frame = pd.DataFrame({"back": words, "behind": [list(structure_repair.END)] * len(words)})
        list(structure_repair._walk(iter([frame]), True))
    finally:
        structure_repair.grown = grown
    assert len(made) == len({w[:i] for w in words for i in range(1, len(w) + 1)})
