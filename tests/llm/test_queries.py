from __future__ import annotations

import duckdb

from alertledger.llm.oracles import ORACLES
from alertledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(name.split("_")[0][2:]) for name in QUERIES) == list(range(1, 14))


def test_queries_equal_their_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in ORACLES.items():
        want = db.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, QUERIES[name](spark, SF).select(columns).collect())) == sorted(want.fetchall()), name
