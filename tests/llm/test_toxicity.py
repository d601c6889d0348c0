from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from alertledger.llm.toxicity import Chain, fit_chain, fit_logistic, keep_clean, score, train


def corpus(n, seed):
    random.seed(seed)
    rows, labels = [], []
    for i in range(n):
        toxic, junk = random.random() < 0.3, random.random() < 0.3
        text = [random.choice(["the", "river", "house", "green", "walk", "light"]) + str(random.randint(0, 40)) for _ in range(60)]
        text = [random.choice("river house green walk light stone paper".split()) for _ in range(60)] + text
        text += [random.choice(["idiot", "moron", "lowei" + random.choice("abcdef")]) for _ in range(2)] * toxic
        text += ["zzz"] * 5 * junk
        random.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(junk), int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_filter(spark, docs, odd_rows):
    rows, labels = corpus(700, 1)
    frame = docs([*rows, *((None if d is None else 10_000 + d, t) for d, t in odd_rows)])
    known = spark.createDataFrame([x for x in labels if x[0] < 400] + [(None, 1, 1), (3, None, 1)], "doc_id long, junk int, toxic int")
    chain = train(frame, known, ["junk", "toxic"])
    out = {r["doc_id"]: r for r in score(frame, chain).collect() if r["doc_id"] is not None}
    for i, junk, toxic in labels[400:]:
        assert (out[i]["p_toxic"] >= 0.5) == bool(toxic) and (out[i]["p_junk"] >= 0.5) == bool(junk)
    kept = keep_clean(frame, chain)
    assert kept.columns == frame.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {i for i, _, toxic in labels if not toxic} <= ids and not {i for i, _, toxic in labels[400:] if toxic} & ids
    assert kept.filter(F.col("doc_id") == 10_007).count() == 2  # repeated rows are judged alike


def test_no_labels_and_no_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, junk int, toxic int")
    chain = train(docs([(1, "a text")]), none, ["junk", "toxic"])
    assert score(docs([(1, "a text"), (2, None)]), chain).filter("p_toxic < 0.01").count() == 2
    assert score(docs([]), chain).count() == 0


def test_chain_uses_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    first = (x[:, 0] > 0).astype(float)
    second = ((x[:, 0] > 0) ^ (x[:, 1] > 3)).astype(float)
    weights = fit_chain(x, np.column_stack([first, second]), np.arange(400) % 5)
    assert len(weights[0]) == 4 and len(weights[1]) == 5  # the second model sees the first one's probability
    p = Chain(["a", "b"], ["f"] * 3, weights).probabilities(x)
    assert ((p[:, 0] > 0.5) == (first > 0)).mean() > 0.97
    constant = fit_logistic(x, np.zeros(400))
    assert constant[:-1].any() == False and constant[-1] < -15  # noqa: E712


def test_the_driver_gets_one_row_a_labelled_document(spark, docs, monkeypatch):
    """Before, training collected an object for each feature of each row."""
    collected = []
    frame = type(spark.range(1))
    real = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (collected.append(real(self)), collected[-1])[1])
    rows, labels = corpus(60, 3)
    known = spark.createDataFrame(labels, "doc_id long, junk int, toxic int")
    chain = train(docs(rows), known, ["junk", "toxic"])
    assert chain.features and max(map(len, collected)) <= max(60, len(chain.features))
