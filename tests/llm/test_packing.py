from __future__ import annotations

import random
import struct
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from alertledger.llm.packing import ChunkEncoder, default_vocabulary, encoder, pack, plan_sequences, sequences


def tokens(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_encode_like_the_tokenizer():
    random.seed(3)
    pieces = ["word", "it's", "é", "1234", "!!", " ", "  ", "\n", "\n\n", "\t", "a b", "<|endoftext|>", " ", "日本", "x_y", "\x1c", "'s"]
    encode = encoder(default_vocabulary())
    for _ in range(400):
        text = random.choice(["", " "]).join(random.choice(pieces) for _ in range(random.randint(0, 12)))
        ids = tokens(text)
        assert encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def test_added_tokens_are_one_id(docs):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # as it is read: added tokens match in text
    random.seed(9)
    pieces = ["word", " ", "  ", "\n", "\t", "<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "it's", "é", "12"]
    texts = ["hello <|endoftext|> world", *("".join(random.choices(pieces, k=random.randint(1, 9))) for _ in range(300))]
    encode = encoder(default_vocabulary(), added=True)
    for text in texts:
        ids = reference.encode(text, add_special_tokens=False).ids
        assert encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)
    row = pack(docs([(1, texts[0])]), with_ids=True).collect()[0]
    assert struct.unpack(f"<{row['length']}I", bytes(row["ids"])) == (31373, 220, 50256, 995, 2)


def test_plan_uses_every_piece_once():
    random.seed(5)
    for _ in range(20):
        counts = Counter(random.randint(1, 1024) for _ in range(random.randint(1, 3000)))
        plan = plan_sequences(counts)
        used = Counter()
        for lengths, times in plan:
            assert sum(lengths) <= 1024 and times > 0
            for x in lengths:
                used[x] += times
        assert used == counts
    exact = plan_sequences({1000: 5, 24: 5, 500: 3, 300: 3, 224: 3})
    assert sum(t for _, t in exact) == 8  # single and triple complements leave no gap
    assert plan_sequences({}) == []


def test_pack_round_trip(docs, odd_rows):
    packed = pack(docs(odd_rows), with_ids=True).cache()
    rows = packed.collect()
    expected = Counter()
    for doc, text, *_ in odd_rows:
        ids = [*tokens(text or ""), 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[doc, piece, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in by.values():
        parts.sort()
        at = 0
        for offset, length, _ in parts:
            assert offset == at
            at += length
        assert at <= 1024
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in sequences(packed).collect()}
    assert whole == {s: b"".join(x[2] for x in parts) for s, parts in by.items()}
    packed.unpersist()
    assert pack(docs([])).count() == 0


def test_a_worker_does_not_keep_every_chunk():
    """The chunks stay in a worker whatever it does next, so they are limited; before, 500,000 were kept."""
    encode = ChunkEncoder(default_vocabulary())
    for at in range(0, 220_000, 1000):
        encode(" ".join(f"k{i:x}" for i in range(at, at + 1000)))
        assert len(encode._cache) <= 202_000
