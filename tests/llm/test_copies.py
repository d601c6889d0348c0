from __future__ import annotations

import hashlib
import random

import pytest

from alertledger.llm.copies import Fingerprints, exact_copies

A_TO_Z = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    """(id, keep_id, group_size, sha256) of each row, and how many rows of each text stay: one."""
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault((text or "").translate(A_TO_Z), []).append(doc)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def check(found, rows):
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found]
    assert sorted(got, key=repr) == brute(rows)
    kept = [r for r in found if r["kept"]]
    assert len({r["text_sha256"] for r in kept}) == len(kept) == len({g[3] for g in got})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("primes", [(7,), (2_147_483_647, 2_147_483_629)])
def test_equals_brute_force(spark, docs, odd_rows, primes):
    """With one prime of 7 most fingerprints of equal length collide; chunks of 8 bytes cut most texts."""
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("aAbÄä ") for _ in range(rng.choice([3, 3, 8, 9, 17])))) for i in range(300)]
    rows += [(1000 + i, "the same Text in a third of all rows") for i in range(150)] + odd_rows
    found = exact_copies(docs(rows), prints=Fingerprints(primes, (3, 5)[:len(primes)], 8)).collect()
    check(found, rows)


def test_case_of_other_letters_counts(docs):
    rows = [(1, "Äb"), (2, "äb"), (3, "ÄB"), (4, "I"), (5, "ı"), (6, "i")]
    found = {r["doc_id"]: r["keep_id"] for r in exact_copies(docs(rows)).collect()}
    assert found == {1: 3, 2: 2, 3: 3, 4: 6, 5: 5, 6: 6}


def test_fingerprints_compose():
    prints, rng = Fingerprints(chunk=64), random.Random(3)
    for _ in range(50):
        text = bytes(rng.randrange(256) for _ in range(rng.randrange(64)))
        cut = rng.randint(0, len(text))
        assert prints.combine(prints.of_chunk(text[:cut]), prints.of_chunk(text[cut:])) == prints.of_chunk(text)
    assert prints.of_chunk(b"\0") != prints.of_chunk(b"\0\0")


def test_empty_table(docs, spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept int")
    assert exact_copies(empty).collect() == []
