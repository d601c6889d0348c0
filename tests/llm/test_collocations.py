from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from alertledger.llm.automata import Automaton, Grams, compose, union
from alertledger.llm.collocations import _shards, collocations

A_TO_Z = {i: i + 32 for i in range(65, 91)}


def pieces(text):
    for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(A_TO_Z)):
        words = [w for w in re.split("[ \t]+", piece) if w]
        if words:
            yield words


def counts(rows, longest):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, *words[i:i + size]) for i in range(len(words) - size + 1))
    return f, n


def brute(rows, longest=3, least=10, cover=50, top=2000):
    f, n = counts(rows, longest)
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    around = Counter()
    for (lang, *words), a in found.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inner = (lang, *words[i:i + size])
                around[inner] = max(around[inner], a)
    out = {}
    for (lang, *words), a in found.items():
        if 100 * around[(lang, *words)] >= cover * a:
            continue
        score, k = min((10**6 * a * a // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, every in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(every)[:top], 1))


def rows_of(rng, n):
    words = ["a", "B", "b", "ä", "Ä", "x1", "the", "THE", "\x01", "é z"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " "]) for _ in range(rng.randrange(40)))
        rows.append((text, rng.choice(["en", "de", None, "und", ""])))
    return rows


def frame(spark, rows):
    full = [(t, lang, 1, "p", 2, 3, 4, 5, 6, 7) for t, lang in rows]
    return spark.createDataFrame(full, "text string, lang string, rank int, phrase string, a int, l int, r int, n int, score int, range int")


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_equals_brute_force(spark, longest, odd_rows, monkeypatch):
    """Many small shards, ranges and shares; long texts are cut into slices."""
    from alertledger.llm import collocations as module

    rng = random.Random(12)
    rows = rows_of(rng, 300) + [("hot pair here", "en")] * 200 + [(t, "en") for _, t, *_ in odd_rows]
    found = collocations(frame(spark, rows), longest, shard_words=500, range_entries=400, wanted_rows=50).collect()
    want = brute(rows, longest)
    assert len(want) > 50 and sorted(map(tuple, found)) == want
    monkeypatch.setattr(module, "SLICE", 64)
    f, _ = counts(rows, longest)
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for t, _ in rows], pa.string()), "lang": pa.array([x for _, x in rows], pa.string())})
    whole = union([Automaton.from_bytes(Automaton.build(g).to_bytes()).grams() for g in _shards(iter([batch]), longest, 100)])
    got = {tuple(x.decode() for x in gram): int(w) for depth in range(1, longest + 1) for gram, w in zip(*whole.rows(depth), strict=True)}
    assert got == dict(f)


def test_top_is_a_limit_and_ties_go_by_bytes(spark):
    rows = [(f"{a} {b}", "en") for a, b in (("z", "q"), ("é", "q2"), ("a", "q3"))] * 10
    found = [r["phrase"] for r in sorted(collocations(frame(spark, rows), top=2).collect(), key=lambda r: r["rank"])]
    assert found == ["a q3", "z q"]


def test_empty_table_and_no_phrase(spark):
    assert collocations(frame(spark, [])).collect() == []
    assert collocations(frame(spark, [(None, None), ("", "en"), ("one two", "en")])).collect() == []


def grams_of(sequences):
    every = sorted(sequences)
    labels = pa.array(sorted({x for s in every for x in s}), pa.binary())
    number = {x.as_py(): i for i, x in enumerate(labels)}
    import numpy as np
    longest = max(map(len, every))
    columns = [np.array([number[s[d]] if d < len(s) else 0 for s in every]) for d in range(longest)]
    return Grams.of(labels, columns, np.array([len(s) for s in every]), np.array([sequences[s] for s in every]))[0]


def listed(grams):
    return {tuple(g): int(w) for d in range(len(grams.levels)) for g, w in zip(*grams.rows(d), strict=True)}


def test_automata_are_minimal_and_compose():
    rng = random.Random(5)
    sequences = [{tuple(rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 4))): rng.randint(1, 3) for _ in range(80)} for _ in range(3)]
    parts = [grams_of(s) for s in sequences]
    total = Counter()
    for s in sequences:
        total.update(s)
    whole = union(parts)
    assert listed(whole) == total == listed(Automaton.from_bytes(Automaton.build(whole).to_bytes()).grams())
    assert listed(whole.at_least(3)) == {g: w for g, w in total.items() if w >= 3}
    for low, high in ((None, (b"b", b"", b"")), ((b"b", b"", b""), (b"b", b"c", b"a")), ((b"b", b"c", b"a"), None), ((b"b", b"c"), (b"b", b"c", b"a"))):
        def inside(g):
            key = g[:3] + (b"",) * (3 - len(g[:3]))
            return (low is None or key >= low) and (high is None or key < high)
        assert listed(whole.part(low, high)) == {g: w for g, w in total.items() if inside(g)}
    asked = grams_of({g: 1 for g in sequences[0]} | {(b"zz",): 1, (b"a", b"zz", b"a"): 1})
    answers = compose(asked, whole)
    got = {tuple(g): int(answers[d][row]) for d, level in enumerate(asked.levels)
           for g, row in zip(asked.rows(d)[0], level.weight.nonzero()[0], strict=True)}
    assert got == {g: total.get(g, 0) for g in [*sequences[0], (b"zz",), (b"a", b"zz", b"a")]}
    # equal continuations share a state: ten beginnings with the same two endings are one state below the start's arcs
    shared = Automaton.build(grams_of({(bytes([65 + i]), end): 2 for i in range(10) for end in (b"x", b"y")}))
    assert len(shared.levels[1][0]) - 1 == 2  # the state without arcs and the shared one
