from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from alertledger.llm.common import stored  # noqa: E402
from alertledger.llm.toxicity import train  # noqa: E402
from tests.llm.test_jaccard import brute as brute_classes  # noqa: E402
from tests.llm.test_lines import brute as brute_lines  # noqa: E402
from tests.llm.test_mixing import fill  # noqa: E402
from tests.llm.test_packing import tokens  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_copies", "mix_sources", "pack"]

    clean = stored(stages["toxicity"](spark, docs, SF), "t")
    assert clean.columns == docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in clean.collect()}
    right = [(i in kept) == (not toxic) for i, toxic in labels.items()]
    assert sum(right) / len(right) > 0.95

    rows = [r for r in rows if r[0] in kept]
    fewer = stored(stages["line_dedup"](spark, clean, SF), "t")
    drop = brute_lines(rows, 1, 20)
    left = []
    for doc, text, source in rows:
        new = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop[doc])
        if not drop[doc] or new.strip():
            left.append((doc, new, source))
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in fewer.collect()) == sorted(left)
    assert fewer.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in fewer.collect())

    single = stored(stages["near_copies"](spark, fewer, SF), "t")
    want = [r for r, (doc, n, first) in zip(left, brute_classes(left, 5, 80), strict=True) if not n or doc == first]
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in single.collect()) == sorted(want)

    mixed = stored(stages["mix_sources"](spark, single, SF), "t")
    sizes, taken, longest = Counter(), Counter(), Counter()
    for _, text, source in want:
        sizes[source] += len(text.encode().split())
        longest[source] = max(longest[source], len(text.encode().split()))
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].encode().split())
    assert mixed.columns == docs.columns
    for source, target in fill(sizes).items():
        assert abs(taken[source] - target) <= longest[source]
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2

    packed = stages["pack"](spark, mixed, SF).collect()
    ids = Counter()
    for r in mixed.collect():
        ids[r["doc_id"]] += len(tokens(r["text"])) + 1
    found = Counter()
    for r in packed:
        found[r["doc_id"]] += r["length"]
    assert found == ids
    used = Counter()
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and len(used) <= -(-sum(ids.values()) // 1024) * 1.05 + 2
