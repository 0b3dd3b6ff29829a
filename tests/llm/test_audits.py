"""Repaired conversations against a plain search over whole edit strings."""

import hashlib
import random
import re
import zlib

import pytest

from ledgerlark.llm import audits
from tests.llm.conftest import CLASHING

FORWARD = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain(rows):
    """The least (cost, edits) by keeping whole strings, with the lines they give."""
    best = {"": (0, "", ())}

    def offer(found, state, value):
        if state not in found or value[:2] < found[state][:2]:
            found[state] = value

    def inserted(found):
        for _ in range(3):
            for state, (cost, edits, lines) in list(found.items()):
                to = FORWARD[state]
                offer(found, to, (cost + 2, edits + "I", (*lines, {"u": "user", "a": "assistant"}[to] + ":")))
        return found

    best = inserted(best)
    for role, text, gone, cut in rows:
        found = {}
        for state, (cost, edits, lines) in best.items():
            offer(found, state, (cost + 3, edits + "D", lines))
            if gone:
                continue
            first = role[:1]
            if first == FORWARD[state] or first == "s" and state == "":
                offer(found, first, (cost + cut, edits + "K", (*lines, f"{role}:{text}")))
            to = FORWARD[state]
            offer(found, to, (cost + 2 + cut, edits + "R", (*lines, {"u": "user", "a": "assistant"}[to] + ":" + text)))
        best = inserted(found)
    return min(best[state] for state in ("", "a") if state in best)


def expected(rows):
    """Results by conversation of (conv_id, turn, role, text) rows after the planted damage."""
    conversations = {}
    for conv_id, turn, role, text in rows:
        held = conversations.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        held += [(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    found = {}
    for conv_id, held in conversations.items():
        held.sort()
        counts, edited, seen = dict(blank=0, duplicate=0, truncated=0), [], set()
        for _, _, role, text in held:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            edited.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for known, t, _, _ in held if known]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(held, held[1:])]
        cost, audit, lines = plain(edited) if held else (0, "", ())
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found[conv_id] = (gaps, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return found


def actual(spark, rows, part=audits.PART):
    further = [*CLASHING, "part", "line", "fate", "head", "message"]
    schema = "conv_id long, turn long, role string, text string, " + ", ".join(f"{name} string" for name in further)
    width = len(further)
    table = audits.audits(spark.createDataFrame([(*row, *["x"] * width) for row in rows], schema), part)
    found = table.collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r)[1:] for r in found}


def made(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " ", None, "so it\nis! ", "é.", "a" * 50, "a" * 40 + "."]
    return [
        (conv if conv else None, rng.choice([None, *range(-2, 9)]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(texts) if rng.random() < 0.4 else f"t{rng.random():.3f}{rng.choice(['.', ''])}")
        for conv in range(conversations)
        for _ in range(rng.randint(1, longest))
    ]


@pytest.mark.parametrize("part", [3, 4096])
def test_repair_equals_plain_search(spark, part):
    rows = made(part, 60, 9) + [(1000, k, "user", f"text {k}") for k in range(40)]
    assert actual(spark, rows, part) == expected(rows)


def test_parts_join_like_one_run():
    """Parts solved from every state and chained give the edits of one run."""
    rng = random.Random(5)
    for _ in range(200):
        rows = [(rng.choice("suuaat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 14))]
        tables, at = [], 0
        while at < len(rows):
            size = rng.randint(1, 4)
            tables.append({"best": [audits.solve(rows[at : at + size], start, False) for start in range(4)]})
            at += size
        cost, steps = audits._chained(tables)
        wanted = plain([(initial, "", gone, cut) for initial, gone, cut in rows])
        assert (cost, "".join(edits for _, edits in steps)) == wanted[:2] == audits.ended(audits.solve(rows, 0, True))


def test_equal_hashes_are_verified(monkeypatch):
    """With a hash that says nothing the order is still that of the strings."""
    monkeypatch.setattr(audits, "_MODULUS", 1)
    rng = random.Random(6)
    edits, texts = audits.Edits(), [""]
    for _ in range(300):
        node = rng.randrange(len(texts))
        edit = rng.choice("DIKR")
        edits.more(node, edit)
        texts.append(texts[node] + edit)
    for _ in range(2000):
        a, b = rng.randrange(301), rng.randrange(301)
        if texts[a] != texts[b]:
            assert edits.less(a, b) == (texts[a] < texts[b])


def test_one_conversation_over_all_partitions(spark):
    """A conversation that holds most rows is solved in parts and reads the same."""
    rows = [(7, k // 3, ["user", "assistant", "system"][k * k % 3], f"line {k // 2}" + "." * (k % 2)) for k in range(3000)] + [(8, 0, "user", "Hi."), (6, 0, "user", "Hi.")]
    assert actual(spark, rows, 100) == expected(rows)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "Again.")] * 500 + [(1, 1, "assistant", "Yes.")] + [(2, None, None, None)] * 3 + [(3, 2, "user", "x" * 2_000_000 + ".")]
    assert actual(spark, rows) == expected(rows)
    assert actual(spark, []) == {}
