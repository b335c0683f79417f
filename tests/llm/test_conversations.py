"""Conversation repair against a search over every edit, on small conversations and on ones that span many tasks."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import conversations, queries
from tidemark.llm.conversations import Product, best, block, joined, power, repair, times, turn

SCHEMA = "conv_id long, turn long, role string, text string, slot int, times string"


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, number, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if number is None else number}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, number, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def faults(rows: list[tuple]) -> list[str]:
    seen, out = set(), []
    for _, _, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows: list[tuple], found: list[str]) -> tuple[int, str, list[tuple[str, str]]]:
    """Dijkstra over (cost, audit) in order; states are (turns read, automaton state)."""
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(lines)
        for to in "ua":
            if to in follow[state]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*lines, ({"u": "user", "a": "assistant"}[to], ""))))
        if i < len(rows):
            role, text = rows[i][2:4]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if found[i] not in ("blank", "duplicate"):
                more = 5 if found[i] else 0
                for to in "ua":
                    if to in follow[state]:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, to, (*lines, ({"u": "user", "a": "assistant"}[to], text))))
                if role[:1] in follow[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, (role, text))))
    raise AssertionError


def plain(table: list[tuple]) -> dict:
    groups = defaultdict(list)
    for row in damage(table):
        groups[row[0]].append(row)
    out = {}
    for conv in {r[0] for r in table}:
        rows = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        found = faults(rows)
        numbers = [r[1] for r in rows if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = search(rows, found)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def table(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    out: list[tuple] = []

    def add(conv: int | None, n: int, numbers) -> None:
        for i in range(n):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]) if rnd.random() < 0.3 else ("user", "assistant")[i % 2]
            text = rnd.choice(["Yes.", "Yes.", "No", "", " \t", None, "é!\n", f"t{rnd.random()}.", f"t{rnd.random()}", "a.b"])
            out.append((conv, numbers(i), role, text, 1, "clash"))

    for conv in range(120):
        add(conv, rnd.randint(1, 9), lambda i: i)
    add(None, 5, lambda i: i)
    add(500, 40, lambda i: rnd.choice([None, i // 3]))
    add(501, 30, lambda i: None)
    add(1000, 700, lambda i: 2 * i)
    out += [(502, 1, "user", "again.", 1, None)] * 50
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_the_search(spark, tmp_path, seed) -> None:
    rows = table(seed)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, str(tmp_path))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r[c] for c in names) for r in got.collect()} == plain(rows)


def test_one_conversation_over_many_tasks(spark) -> None:
    """Pieces of the long conversation of a table that it fills are joined in a tree, and their parts of the repair fit."""
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = [r for r in damage(table(3)) if r[0] in (1000, 500)]
        summaries, turns = repair(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
        cost = {r.conv_id: (r.cost, r.audit) for r in summaries.collect()}
        lines = defaultdict(list)
        for r in sorted(turns.collect(), key=lambda r: r.slot):
            lines[r.conv_id].append((r.role, r.text))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for conv in (1000, 500):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        want = search(mine, faults(mine))
        assert cost[conv] == want[:2]
        assert lines[conv] == want[2]


KINDS = st.lists(st.sampled_from([r + f for r in "sua-" for f in "dtk"]), max_size=12)


@settings(max_examples=200, deadline=None)
@given(KINDS)
def test_any_bracketing_gives_the_cheapest_edits(kinds: list[str]) -> None:
    roles = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
    rows = [(0, i, roles[k[0]], f"{i}") for i, k in enumerate(kinds)]
    want = search(rows, [{"d": "blank", "t": "truncated", "k": ""}[k[1]] for k in kinds])
    one = Product()
    for k in kinds:
        one.add(k, 0)
    totals = [one.total(), block(tuple(kinds)), times(block(tuple(kinds[: len(kinds) // 3])), block(tuple(kinds[len(kinds) // 3 :])))]
    for total in totals:
        cost, audit = best(total)
        assert (cost, audit.replace("L", "K")) == want[:2]


def test_copies_as_a_power() -> None:
    assert power(turn("ud"), 5) == times(times(times(times(turn("ud"), turn("ud")), turn("ud")), turn("ud")), turn("ud"))
    assert joined.__doc__


def test_empty_tables(spark) -> None:
    summaries, turns = repair(spark.createDataFrame([], SCHEMA))
    assert summaries.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    assert summaries.count() == turns.count() == conversations.digests(turns).count() == 0
