from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from alertledger.llm import repeats
from alertledger.llm.repeats import remove_repeats, text_runs


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[p:p + 400] for t in data for p in range(len(t) - 399))
    out = []
    for t in data:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 399):
            if seen[t[p:p + 400]] > 1:
                gone[p:p + 400] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), len(edges) // 2, len(t) - len(kept), hashlib.sha256(kept).hexdigest()))
    return out


def words(n):
    return " ".join(random.choice(["alpha", "bé", "c", "delta", "epsilon", "zz"]) + str(random.randint(0, 99)) for _ in range(n))


def test_against_brute_force(docs, odd_rows):
    random.seed(11)
    passage, base = words(90), words(300)
    texts = [words(200) + passage + words(50), passage + words(120), base, base, "x" * 900, "ab" * 450, words(80)[:399]]
    for _ in range(25):  # near copies, cut at many places
        at = random.randint(0, len(base) - 1)
        texts.append(base[:at] + "#" * random.randint(1, 9) + base[at + random.randint(0, 30):])
    rows = [*odd_rows, *((100 + i, t) for i, t in enumerate(texts))]
    out = remove_repeats(docs(rows)).collect()
    found = Counter((r["doc_id"], r["n_bytes"], len(r["spans"]), sum(s["end"] - s["start"] for s in r["spans"]), r["kept_sha256"])
                    for r in out)
    assert found == Counter((doc, *x) for (doc, *_), x in zip(rows, brute([r[1] for r in rows]), strict=True))
    assert remove_repeats(docs([])).count() == 0


def test_slices_of_long_texts_give_the_same_runs(monkeypatch):
    random.seed(2)
    texts = [words(4000).encode(), b"q" * 5000, b"", words(3000).encode()]
    whole = text_runs(texts)
    monkeypatch.setattr(repeats, "SLICE", 3000)
    cut = text_runs(texts)
    order = [np.lexsort((r["p1"], r["row"])) for r in (whole, cut)]
    for name in whole:
        assert (whole[name][order[0]] == cut[name][order[1]]).all()
