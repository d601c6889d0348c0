from __future__ import annotations

import random
from collections import Counter

from alertledger.llm.mixing import mix_sources, take_mix


def fill(sizes, weights=(3, 1, 2), total=1.5, cap=2):
    """Share by weight, cut at the cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = total * sum(sizes.values()), {}, set(names)
    while open_:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if share * w[s] > cap * sizes[s]}
        if not full:
            return target | {s: share * w[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_sizes_and_rounding(docs):
    random.seed(1)
    rows = [(i, " ".join(["w"] * random.choice([1, 3, 10, 40, 200])), random.choice(["a", "b", "c", "d", None])) for i in range(900)]
    out = mix_sources(docs(rows)).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    expected, taken = fill(sizes), Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - expected[r["source"]]) < 1e-6
        rate = r["target"] / r["source_size"]
        assert int(rate) <= r["copies"] <= min(2, int(rate) + 1)
        taken[r["source"]] += r["copies"] * r["size"]
    for source, target in expected.items():
        assert abs(taken[source] - target) <= 100  # half of the longest document at most
    again = mix_sources(docs(list(reversed(rows)))).collect()
    assert {(r["doc_id"], r["copies"]) for r in out} == {(r["doc_id"], r["copies"]) for r in again}


def test_odd_rows(docs, odd_rows):
    out = mix_sources(docs(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    assert all(r["copies"] == 0 for r in out if not r["size"])
    assert sorted(r["size"] for r in out if r["doc_id"] in (1, 2, 3)) == [0, 0, 0]
    assert mix_sources(docs([])).count() == 0


def test_take_mix_repeats_rows(docs):
    rows = [(i, "one two three", f"s{i % 2}") for i in range(300)]
    frame = docs(rows)
    taken = take_mix(frame)
    assert taken.columns == frame.columns
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(frame).collect()}
    assert Counter(r["doc_id"] for r in taken.collect()) == Counter({k: v for k, v in copies.items() if v})
