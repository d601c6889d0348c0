from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertledger.llm import neighbours
from alertledger.llm.inner_product import search_bucket, top_products
from alertledger.llm.neighbours import _rounded, build_graph, nearest_rows, tree_depth

NAN, INF = float("nan"), float("inf")
ODD = [(9001, None), (9002, [None, 1.0, 0.0, 0.0]), (9003, [NAN] * 4), (9004, [INF, 0.0, 0.0, 0.0]), (9050, []), (9100, None), (None, [9.0, 9.0, 9.0, 9.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, "q") for i, v in rows],
                                 "vec_id long, embedding array<float>, id int, v double, query_id string")


def brute_products(rows, queries, k):
    v = {i: np.floor(256 * np.array(x, np.float32).astype(float)) for i, x in rows}
    out = []
    for q in queries:
        best = sorted(((-int(v[q] @ x), i) for i, x in v.items() if i != q and len(x) == len(v[q])))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_products_against_brute_force(spark, spread):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4)) * np.exp(spread * rng.normal(size=(600, 1)))
    x[200:260] = x[7]  # copies: ties go to the smaller id
    x[300] = 0
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    out = top_products(frame(spark, [*rows, *ODD]), F.col("vec_id") % 50 == 0, bucket_rows=64, query_rows=5)
    assert sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect())) == \
        brute_products(rows, range(0, 600, 50), 5)


def test_products_of_few_rows(spark):
    few = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [1.0, 0.0, 0.0])]
    out = top_products(frame(spark, few), F.col("vec_id") % 50 == 0)
    assert [tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 1, 128 * 256 + 128 * 512)]
    assert top_products(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_pruning_keeps_all_that_beat_the_score():
    rng = np.random.default_rng(8)
    v = np.floor(rng.normal(size=(500, 6)) * 100)
    v = v[np.argsort(-np.sqrt((v * v).sum(axis=1)), kind="stable")]
    q = np.floor(rng.normal(size=(20, 6)) * 100)
    exact = q @ v.T
    for share in (0.3, 0.9, 0.99):
        beat = np.quantile(exact, share, axis=1)
        found = search_bucket(np.arange(500), v, np.arange(1000, 1020), q, beat, 5)
        want = [(1000 + i, int(j), int(exact[i, j])) for i in range(20) for j in np.lexsort((np.arange(500), -exact[i]))[:5]
                if exact[i, j] >= beat[i]]
        assert found == want


def test_neighbours_recall_and_distances(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[500:540] = x[0]
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    zero = (9200, [0.0] * 16)
    out = nearest_rows(frame(spark, [*rows, *ODD, zero]), F.col("vec_id") % 100 == 0).collect()
    wide, hits = x.astype(float), 0
    for q in range(0, 1500, 100):
        own = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        assert np.allclose([r["score"] for r in own], [d[r["vec_id"]] for r in own], rtol=1e-12)
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(1500), d))[:10]) & {r["vec_id"] for r in own})
    assert hits / 150 >= 0.9
    assert {r["query_id"] for r in out} == set(range(0, 1500, 100))
    assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == 0), key=lambda r: r["rank"])] == list(range(500, 510))


def test_neighbours_of_few_rows(spark):
    few = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])]
    out = nearest_rows(frame(spark, few), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in out) == [(1, 2), (2, 1)]
    assert nearest_rows(frame(spark, []), F.col("vec_id") == 0).count() == 0


def test_descent_is_exercised_and_settles(spark):
    """Small blocks, so that the start is far from exact and the rounds have to find the neighbours."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 12)).astype(np.float32)
    out = nearest_rows(frame(spark, [(i, [float(c) for c in r]) for i, r in enumerate(x)]), F.col("vec_id") % 100 == 0, block=32)
    found, hits = out.collect(), 0
    for q in range(0, 4000, 100):
        d = ((x.astype(float) - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hits / 400 >= 0.95

    wide = x[:1500].astype(float)
    nodes = spark.createDataFrame([(i, 12, v.tobytes(), c) for i, (v, c) in enumerate(zip(wide, _rounded(wide), strict=True))],
                                  "node long, dim int, v binary, code binary")
    with pytest.raises(RuntimeError, match="did not settle"):
        build_graph(nodes, degree=8, trees=2, max_rounds=1, block=16)  # two trees: one alone gives closed blocks


def test_depth_follows_the_size():
    assert [tree_depth(n, 1024) for n in (0, 5, 1024, 2048, 10**6, 10**7)] == [0, 0, 0, 1, 10, 14]


def test_a_round_counts_its_changes_without_a_join_of_the_graphs(spark, monkeypatch):
    """Before, the new graph was joined with the old one: a row for each changed pair, far more among near copies."""
    how = []
    join = type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, other, *a, **k: (how.append((a[1:] or ("inner",))[0]), join(self, other, *a, **k))[1])
    x = np.random.default_rng(6).normal(size=(300, 4))
    nodes = spark.createDataFrame([(i, 4, v.tobytes(), bytes(_rounded(v[None])[0])) for i, v in enumerate(x)],
                                  "node long, dim int, v binary, code binary")
    graph = build_graph(nodes, degree=16, trees=2, block=64)
    assert how and set(how) == {"inner"}
    assert graph.columns == ["a", "b", "d"] and graph.groupBy("a", "b").count().filter("count > 1").isEmpty()
    near = {(r["a"], r["b"]) for r in graph.collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag([np.inf] * 300)
    true = {(i, int(j)) for i in range(300) for j in np.argsort(d[i])[:16]}
    assert len(near & true) >= 0.9 * len(true)


def test_a_round_sends_its_rows_three_times(spark, monkeypatch):
    """Before, a round shuffled nine times and each tree was a job of its own."""
    plans = []
    real = neighbours.stored
    monkeypatch.setattr(neighbours, "stored", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, label))[1])
    x = np.random.default_rng(7).normal(size=(200, 4))
    nodes = spark.createDataFrame([(i, 4, v.tobytes(), bytes(_rounded(v[None])[0])) for i, v in enumerate(x)],
                                  "node long, dim int, v binary, code binary").repartition(2)
    monkeypatch.setattr(neighbours, "PART_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        build_graph(nodes, degree=8, trees=3, block=16)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[0].count("Exchange rangepartitioning") == 1
    assert len(plans) > 1 and all(plan.count("Exchange hashpartitioning") == 4 for plan in plans[1:])  # the fourth: the nodes' codes
