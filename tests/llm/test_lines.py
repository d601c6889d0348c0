from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from alertledger.llm.lines import characters, dedup_lines, edit_distance_within, mark_duplicate_lines


def edits(text, n):
    chars = list(text)
    for _ in range(n):
        at, kind = random.randint(0, len(chars)), random.randint(0, 2)
        if kind == 0 or not chars:
            chars.insert(at, random.choice("abé"))
        elif kind == 1:
            chars.pop(min(at, len(chars) - 1))
        else:
            chars[min(at, len(chars) - 1)] = random.choice("abé")
    return "".join(chars)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, k, least):
    """Positions to drop by document: all pairs of lines, classes by chains, the first occurrence stays."""
    first, where = {}, []
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for pos, line in enumerate((text or "").split("\n")):
            if len(line) >= least:
                where.append((doc, pos, line))
                first.setdefault(line, len(where))
    lines = list(first)
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                root[find(a)] = find(b)
    start = {}
    for line in lines:
        start[find(line)] = min(start.get(find(line), 10**9), first[line])
    drop = defaultdict(set)
    for n, (doc, pos, line) in enumerate(where, 1):
        if start[find(line)] != n:
            drop[doc].add(pos)
    return drop


def test_bit_parallel_distance(spark):
    random.seed(1)
    pairs = []
    for _ in range(800):
        a = "".join(random.choice("abé") for _ in range(random.randint(0, 14)))
        b = edits(a, random.randint(0, 5))
        pairs.append((a, b) if len(a) >= len(b) else (b, a))
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"x": characters(F.col("a")), "y": characters(F.col("b"))})
    for k in (1, 2, 4):
        wrong = df.filter(edit_distance_within(F.col("x"), F.col("y"), k) != (F.levenshtein("a", "b") <= k))
        assert wrong.count() == 0


def test_against_brute_force(docs):
    random.seed(7)
    base = ["".join(random.choice("abcdé ") for _ in range(random.randint(18, 60))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [edits(random.choice(base), random.choice([0, 0, 1, 1, 2, 3])) for _ in range(random.randint(1, 5))]
        rows.append((i, "\n".join(lines)))
    for k in (1, 2):
        out = mark_duplicate_lines(docs(rows), max_edits=k, min_chars=20, drop_col="gone").select("doc_id", "gone").collect()
        want = brute(rows, k, 20)
        assert {r["doc_id"]: set(r["gone"]) for r in out} == {i: want[i] for i, _ in rows}


def test_odd_rows(docs, odd_rows):
    line = "a line that is in very many documents"
    rows = [*odd_rows, (20, f"{line}\nown line of document twenty"), (21, f"short\n{line}"), (22, line), (None, line)]
    frame = docs(rows)
    out = dedup_lines(frame)
    assert out.columns == frame.columns
    kept = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]
    assert (20, rows[-4][1]) in kept and (21, "short") in kept
    assert 22 not in {d for d, _ in kept} and (None, line) not in kept  # nothing is left of them
    assert (1, None) in kept and (2, "") in kept and (3, " \n\t ") in kept and kept.count((7, "repeated row")) == 2
    assert (5, "same text in two rows") in kept and 6 not in {d for d, _ in kept}
    assert dedup_lines(docs([])).count() == 0


def test_edits_grow_with_the_length(docs):
    """The default, against brute force: a threshold by the length of the shorter line of a pair."""
    random.seed(11)
    allowed = lambda n: sum(n >= start for start in (20, 40, 80, 120, 160, 200))
    base = ["".join(random.choice("abcdefghij klmé") for _ in range(n))
            for n in (21, 30, 39, 41, 60, 79, 82, 119, 121, 158, 163, 199, 202, 260) for _ in range(2)]
    rows = [(i, edits(x, n)) for i, (x, n) in enumerate((x, n) for x in base for n in (0, 1, 2, 3, 4, 6, 8))]
    lines = sorted({x for _, x in rows if len(x) >= 20}, key=len)
    near = {x: {x} for x in lines}
    for i, b in enumerate(lines):
        for a in lines[i + 1:]:
            if len(a) - len(b) <= 6 and distance(a, b) <= allowed(len(b)):
                near[a] |= near[b]
                for x in near[a]:
                    near[x] = near[a]
    first = {}
    for i, x in rows:
        if x in near:
            first.setdefault(id(near[x]), i)
    out = mark_duplicate_lines(docs(rows), drop_col="gone").select("doc_id", "gone").collect()
    want = {i: [0] if x in near and first[id(near[x])] != i else [] for i, x in rows}
    assert {r["doc_id"]: r["gone"] for r in out} == want
    assert sum(map(len, want.values())) > 60


def test_short_lines_go_if_equal(docs):
    rows = [(1, "Les.\nown text\n\n \nx"), (2, "Les.\nLes!\n\n \nx"), (3, "Les.")]
    out = mark_duplicate_lines(docs(rows), drop_col="gone").select("doc_id", F.sort_array("gone").alias("gone")).collect()
    assert {r["doc_id"]: r["gone"] for r in out} == {1: [], 2: [0, 4], 3: [0]}
