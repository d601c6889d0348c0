from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from alertledger.llm.jaccard import _Join, _sketch, link_components, one_of_each


def brute(rows, size, percent):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), 10**9), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


def family(base, n, changes):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(random.randint(0, changes)):
            words[random.randrange(len(words))] = f"x{random.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


def rows_of(seed):
    random.seed(seed)
    def text(n):
        return [f"{random.choice(['to', 'be', 'or', 'not'])}{random.randint(0, 500)}" for _ in range(n)]
    passage = text(60)
    texts = family(text(120), 60, 6)  # a family in which many pairs do not link directly
    texts += [" ".join([*passage, *text(40)]) for _ in range(30)]
    for _ in range(12):
        texts += family(text(random.randint(8, 200)), 4, 3)
    texts += ["One two", "one TWO", "one", "É é", "é É", "one two three four"]
    rows = list(enumerate(texts, 100))
    random.shuffle(rows)
    return rows


def test_against_brute_force(docs, odd_rows):
    for seed, size, percent in ((1, 4, 85), (2, 5, 80)):
        rows = [*rows_of(seed), *odd_rows]
        out = link_components(docs(rows), size, percent).select("doc_id", "n_shingles", "component_id").collect()
        key = str
        assert sorted(map(tuple, out), key=key) == sorted(brute(rows, size, percent), key=key)
    assert link_components(docs([])).count() == 0


def test_one_of_each(docs, odd_rows):
    rows = [*rows_of(3), *odd_rows]
    frame = docs(rows)
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    classes = brute(rows, 5, 80)
    want = sorted([c for d, n, c in classes if n and d is not None and d == c and d != 7] + [7])
    got = sorted(r["doc_id"] for r in kept.collect() if (r["text"] or "").strip() and r["doc_id"] is not None)
    assert got == want
    assert kept.filter("trim(coalesce(text, ' ')) = '' OR doc_id = 3").count() == 4  # empty texts stay


def test_members_of_a_large_star_are_joined_only_where_they_can_link(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 62, 120).astype(np.uint64)

    def changed(n):
        out = base.copy()
        out[draw.choice(len(base), n, replace=False)] = draw.integers(0, 1 << 62, n).astype(np.uint64)
        return np.unique(out)
    members = [np.unique(base)] + [changed(int(n)) for n in draw.integers(1, 10, 79)]
    around = [changed(int(n)) for n in draw.integers(12, 40, 60)] + [np.delete(m, [0, 1, 2, 3]) for m in members[70:]]
    sets = dict(enumerate(members + around))
    apart = {(i, j): len(np.setxor1d(sets[i], sets[j])) for i in range(len(members)) for j in range(len(members), len(sets))}
    links = {(i, j) for i, j in apart if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert links

    def row(i, star, size):
        d = len(np.setxor1d(sets[i], sets[star]))
        return (star, i, len(sets[i]), tuple(int(w) for w in _sketch(sets[i])), d, size, float(i))
    stars = spark.createDataFrame(
        [row(i, 0, len(members)) if i < len(members) else row(i, i, 1) for i in sets],
        "star long, sid long, n int, sketch struct<w0 long, w1 long, w2 long, w3 long>, d long, members long, rank double")
    stars = stars.withColumn("rank", F.when(F.col("members") > 1, F.col("rank")).otherwise(0.0))
    heads = stars.groupBy("star").agg(F.max("d").alias("radius"), F.min("n").alias("n_min"), F.max("n").alias("n_max")) \
        .join(stars.filter("sid = star").select("star", "sketch"), "star")
    join = _Join(None, None, 4, 85)
    for large, small in (("l", "k"), ("k", "l")):
        pairs = spark.createDataFrame([(0, j, apart[0, j]) for j in range(len(members), len(sets))], f"{large} long, {small} long, distance long")
        met = {tuple(sorted(r)) for r in join.member_pairs(pairs, stars, heads, 0, 1000).select("a", "b").collect()}
        assert links <= met
        assert join.star_members(pairs, stars, heads, 1000).count() <= len(members) * len(around) // 4
