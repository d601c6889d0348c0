from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from alertledger.llm.conversations import ordered_turns, prefix_trie, with_shared_beginnings


def rebuild(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(every)] for c, every in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(rebuilt):
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, subtree = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
        for d in range(len(node) + 1):
            subtree.setdefault(node[:d], []).append(node)
    out = []
    for node, who in members.items():
        ends = sorted(c for c in who if len(rebuilt[c]) == len(node))
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in subtree[node] if u)
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children.get(node, [])),
                    sum(u not in children for u in subtree[node]), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(rng, n, longest):
    rows = []
    for c in range(-3, n):
        for turn in range(rng.choice([1, 2, 5, 9, longest])):
            rows.append((c * 7 % n if c >= 0 else c, rng.choice([turn, turn, None]), rng.choice(["user", "bot", None, ""]), rng.choice(["a", "é", "", None])))
    return rows


def frame(spark, rows):
    full = [(*r, 1, "x", 2, 3, 4) for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, conv int, pos string, depth int, block int, seq int")


def trie(spark, rows, **more):
    turns, convs = ordered_turns(frame(spark, rows))
    return prefix_trie(with_shared_beginnings(turns, convs), convs, **more)


@pytest.mark.parametrize("block,width", [(2, 2), (8, 512)])
def test_equals_brute_force(spark, block, width):
    rng = random.Random(13)
    rows = rows_of(rng, 60, 23) + [(None, 1, "user", "no conversation")]
    for c in range(1000, 1050):  # a hot first turn, and a group of equal conversations
        rows += [(c, 0, "user", "hello"), *[(c, t, "user", "same") for t in range(1, 12)], *([(c, 50, "bot", str(c))] if c % 2 else [])]
    rows += [(2000, t, "user", "long") for t in range(60)] + [(7, 3, "user", "twice")] * 2
    found = trie(spark, rows, block=block, width=width)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rebuild(rows))


def test_conversation_without_turns_and_empty_table(spark):
    turnless = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(turnless, 1, "user", "x")]
    assert [tuple(r) for r in trie(spark, rows).collect()] == brute(rebuild(rows)) and rebuild(rows)[turnless] == []
    assert trie(spark, []).collect() == []


def test_order_and_separation(spark):
    rows = [(5, None, "a", "first"), (5, 0, "a", "second"), (10, 0, "ab", "c"), (15, 0, "a", "bc")]
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie(*ordered_turns(frame(spark, rows))).collect()}
    assert got[(5, 0)]["n_children"] == 3 and got[(5, 2)]["depth"] == 2
    assert got[(10, 1)]["n_convs"] == got[(15, 1)]["n_convs"] == 1
