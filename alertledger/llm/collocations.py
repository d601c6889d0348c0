"""Phrases whose words occur together more often than apart, by weighted automata.

* Every shard of words (a bounded number, whatever the texts' lengths) gives its n-grams with their counts, in
  sorted order; they are cut at fixed keys into ranges, and each part becomes a minimal automaton
  (``automata``): n-grams with equal continuations share them, which most rare n-grams do. That is what is
  shuffled, so a very common word or phrase is one path per shard.
* Per range the automata are united and weights of equal paths are summed; what is too rare goes. The counts
  of all phrases and of all their parts are then in one automaton per range.
* The parts of the candidates are looked up by composing an automaton of the wanted parts with the counts of
  their range. A range with many wanted parts is dealt over several tasks, each with a copy of its counts.

The keys between ranges come from a bounded sample of words; it decides how even the ranges are, nothing else.

Defined results: NULL text is empty, NULL language is ``und``; rows without words add nothing; phrases never
cross a break or a row; equal rows all count; an empty table gives no phrase; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .automata import KEY, Automaton, Grams, Key, Level, compose, sum_by, union
from .common import map_batches, numbered, ship, stored

SHARD_WORDS = 1 << 19
SLICE = 1 << 22          # bytes that are split into words at once
RANGE_ENTRIES = 1 << 22  # n-grams of shards in a range, about
MAX_RANGES = 1 << 16
SAMPLE_BYTES = 1 << 25   # of texts, for the keys between ranges
WANTED_ROWS = 200_000    # parts looked up by one task

_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = re.compile(rb"[ \t.,;:!?\n-\r]")


class _Words:
    """Words of texts: their bytes, language and the piece (between breaks) that they are in."""

    def __init__(self):
        self.words: list[pa.Array] = []
        self.langs: list[np.ndarray] = []
        self.pieces: list[np.ndarray] = []
        self.count, self.piece, self.names = 0, 0, {}

    def add(self, texts: list[bytes], langs: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        broken = _BREAK[data]
        gap = broken | _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        self.words.append(pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])]))
        numbers = np.array([self.names.setdefault(x, len(self.names)) for x in langs], np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.langs.append(numbers[np.searchsorted(ends, start, side="right")] if len(start) else np.zeros(0, np.int64))
        pieces = np.cumsum(broken)
        self.pieces.append(pieces[start] + self.piece)
        self.piece += int(pieces[-1])
        self.count += len(start)

    def grams(self, longest: int, last: bool) -> Grams:
        """N-grams that start at the words so far. Unless ``last``, those of the last words are left for later."""
        words = pa.chunked_array(self.words, pa.binary()).combine_chunks()
        langs, pieces = np.concatenate(self.langs), np.concatenate(self.pieces)
        coded = words.dictionary_encode()
        names = pa.array(list(self.names), pa.binary())
        labels = pa.chunked_array([coded.dictionary, names]).unique()
        labels = labels.take(pc.sort_indices(labels))
        word = np.asarray(pc.index_in(coded.dictionary, labels)).astype(np.int64)[np.asarray(coded.indices)]
        lang = np.asarray(pc.index_in(names, labels)).astype(np.int64)[langs]
        starts = len(word) if last else max(0, len(word) - longest + 1)
        grams = _counted(labels, lang, word, pieces, starts, longest)
        self.words, self.langs, self.pieces = [words[starts:]], [langs[starts:]], [pieces[starts:]]
        self.count = len(word) - starts
        return grams


def _counted(labels: pa.Array, lang: np.ndarray, word: np.ndarray, piece: np.ndarray, starts: int, longest: int) -> Grams:
    """(language), (language, word), (language, word, word), ... with the number of times each starts at one of the first ``starts`` words."""
    levels, at, on = [], np.zeros(starts, np.int64), np.arange(starts)
    for depth in range(longest + 1):
        if depth > 1:
            last = on + depth - 1
            inside = last < len(word)
            inside[inside] = piece[last[inside]] == piece[on[inside]]
            on, at = on[inside], at[inside]
        column = lang[on] if depth == 0 else word[on + depth - 1]
        keys, sums, at = sum_by(at << 32 | column, np.ones(len(on), np.int64))
        levels.append(Level(keys >> 32, keys & 0xFFFFFFFF, sums))
    return Grams(labels, levels)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes], bool]]:
    """(texts, languages, whether the last text goes on) of at most about SLICE bytes, cut between words only."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            data, name = (x.as_buffer().to_pybytes() if x.is_valid else default for x, default in ((text, b""), (lang, b"und")))
            at = 0
            while len(data) - at > SLICE:
                if texts:
                    yield texts, langs, False
                    texts, langs, size = [], [], 0
                gap = _GAP.search(data, at + SLICE)
                end = gap.end() if gap else len(data)
                yield [data[at:end]], [name], True
                at = end
            texts.append(data[at:])
            langs.append(name)
            size += len(data) - at + 1
            if size >= SLICE:
                yield texts, langs, False
                texts, langs, size = [], [], 0
    if texts:
        yield texts, langs, False


def _shards(batches: Iterator[pa.RecordBatch], longest: int, shard_words: int) -> Iterator[Grams]:
    words, open_gap = _Words(), False
    for texts, langs, goes_on in _slices(batches):
        if open_gap:  # a text goes on: the break after its last slice was ours
            words.piece -= 1
        words.add(texts, langs)
        open_gap = goes_on
        if words.count >= shard_words:
            yield words.grams(longest, last=False)
    if words.count:
        yield words.grams(longest, last=True)


def _sampled_key(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = _Words()
    words.add([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch["text"]],
              [x.as_buffer().to_pybytes() if x.is_valid else b"und" for x in batch["lang"]])
    every, langs = words.words[0], [*words.names]
    at = np.arange(0, max(0, len(every) - 1), 61)
    columns = [pa.array([langs[i] for i in words.langs[0][at]], pa.binary()), every.take(pa.array(at)), every.take(pa.array(at + 1))]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "c"])


def _boundaries(docs: DataFrame, range_entries: int, longest: int) -> list[Key]:
    """Keys between ranges, from a sample of at most about SAMPLE_BYTES of texts (some 100,000 keys)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    entries = size // 6 * longest  # words are some six bytes each
    ranges = min(MAX_RANGES, -(-entries // range_entries))
    if ranges <= 1:
        return []
    part = docs.sample(min(1.0, SAMPLE_BYTES / size), seed=1)
    keys = sorted({tuple(bytes(x) for x in r) for r in map_batches(part, _sampled_key, "a binary, b binary, c binary").distinct().collect()})
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def count_ranges(docs: DataFrame, longest: int, min_count: int, shard_words: int = SHARD_WORDS,
                 range_entries: int = RANGE_ENTRIES) -> tuple[DataFrame, list[Key]]:
    """(range, counts): per range of keys the automaton of its n-grams that occur ``min_count`` times; and the keys between."""
    bounds = _boundaries(docs, range_entries, longest)

    def shard_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in _shards(batches, longest, shard_words):
            for number, (low, high) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):
                part = grams.part(low, high)
                if any(level.weight.any() for level in part.levels):
                    yield pa.RecordBatch.from_pydict({"range": pa.array([number], pa.int32()),
                                                      "part": pa.array([Automaton.build(part).to_bytes()], pa.binary())})

    def unite(table: pa.Table) -> pa.Table:
        whole = union([Automaton.from_bytes(x.as_py()).grams() for x in table["part"]])
        # a language's words are counted whatever their number
        total = Grams(whole.labels, [whole.levels[0]])
        common = union([whole.at_least(min_count), _lighter(total, min_count)])
        return pa.table({"range": table["range"][:1], "counts": pa.array([Automaton.build(common).to_bytes()], pa.binary())})

    ship(docs.sparkSession)
    # as many tasks as ranges: few ranges meet in one, however small their compressed parts look
    parts = docs.mapInArrow(shard_parts, "range int, part binary").repartition(2 * len(bounds) + 1, "range")
    return stored(parts.groupBy("range").applyInArrow(unite, "range int, counts binary"), "phrase-counts"), bounds


def _lighter(grams: Grams, weight: int) -> Grams:
    """The same sequences with only the weights below ``weight``."""
    return Grams(grams.labels, [Level(x.parent, x.label, np.where(x.weight < weight, x.weight, 0)) for x in grams.levels])


def _key(lang: bytes, words: list[bytes]) -> Key:
    key = (lang, *words)[:KEY]
    return key + (b"",) * (KEY - len(key))


def _wanted(counts: DataFrame, bounds: list[Key]) -> DataFrame:
    """Per candidate, cut and side: the range in which its part is counted."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for blob in batch["counts"]:
            grams = Automaton.from_bytes(blob.as_py()).grams()
            for depth in range(2, len(grams.levels)):
                for (lang, *words), a in zip(*grams.rows(depth), strict=True):
                    phrase = b" ".join(words)
                    for k in range(1, depth):
                        for first, part in ((True, words[:k]), (False, words[k:])):
                            out.append((bisect.bisect_right(bounds, _key(lang, part)), lang, phrase, int(a), k, first))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                          ["range", "lang", "phrase", "a", "k", "first"])

    return map_batches(counts, run, "range int, lang binary, phrase binary, a long, k int, first boolean", rows=1)


def _looked_up(wanted: pa.Table, counts: pa.Table) -> pa.Table:
    """``wanted`` with the count of each part."""
    parts = []
    for lang, phrase, k, first in zip(*(wanted[c].to_pylist() for c in ("lang", "phrase", "k", "first")), strict=True):
        words = phrase.split(b" ")
        parts.append((lang, *(words[:k] if first else words[k:])))
    found = np.zeros(len(parts), np.int64)
    if counts.num_rows and parts:
        lengths = np.array([len(p) for p in parts])
        columns = [pa.array([p[i] if i < len(p) else b"" for p in parts], pa.binary()) for i in range(int(lengths.max()))]
        labels = pa.chunked_array(columns).unique()
        labels = labels.take(pc.sort_indices(labels))
        numbers = [np.asarray(pc.index_in(c, labels)).astype(np.int64) for c in columns]
        asked, at = Grams.of(labels, numbers, lengths, np.ones(len(parts), np.int64))
        answers = compose(asked, Automaton.from_bytes(counts["counts"][0].as_py()).grams())
        for depth, weights in enumerate(answers):
            here = lengths == depth + 1
            found[here] = weights[at[here]]
    return pa.table({**{c: wanted[c] for c in ("lang", "phrase", "a", "k", "first")}, "found": pa.array(found)})


def _scored(batch: pa.RecordBatch, scale: int) -> pa.RecordBatch:
    """l, r and score of the cut with the lowest score; whole numbers of any size."""
    out = []
    for a, lefts, rights in zip(batch["a"].to_pylist(), batch["ls"].to_pylist(), batch["rs"].to_pylist(), strict=True):
        out.append(min((scale * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(zip(lefts, rights, strict=True))))
    score, _, left, right = zip(*out, strict=True)
    return pa.RecordBatch.from_pydict({"lang": batch["lang"], "phrase": batch["phrase"], "a": batch["a"],
                                       **{n: pa.array(v, pa.int64()) for n, v in (("l", left), ("r", right), ("score", score))}})


def _runs(words: Column, size: int) -> Column:
    """All runs of ``size`` of the words, each joined by spaces."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))


def collocations(df: DataFrame, longest: int = 3, min_count: int = 10, cover_percent: int = 50, top: int = 2000,
                 scale: int = 1_000_000, text_col: str = "text", lang_col: str = "lang",
                 shard_words: int = SHARD_WORDS, range_entries: int = RANGE_ENTRIES,
                 wanted_rows: int = WANTED_ROWS) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score."""
    docs = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts, bounds = count_ranges(docs, longest, min_count, shard_words, range_entries)

    # parts, dealt by range and, in ranges with many, by phrase: the counts of a range go to each of its shares
    wanted = stored(_wanted(counts, bounds), "phrase-parts")
    shares = stored(wanted.groupBy("range").agg(F.ceil(F.count("*") / wanted_rows).cast("int").alias("shares")), "phrase-shares")
    dealt = wanted.join(F.broadcast(shares), "range").withColumn("share", F.pmod(F.xxhash64("phrase"), F.col("shares")).cast("int"))
    copies = counts.join(F.broadcast(shares), "range").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    found = (dealt.drop("shares").groupBy("range", "share").cogroup(copies.drop("shares").groupBy("range", "share"))
             .applyInArrow(_looked_up, "lang binary, phrase binary, a long, k int, first boolean, found long"))

    def side(first: bool) -> list:
        return [F.max(F.when((F.col("k") == k) & (F.col("first") == first), F.col("found"))) for k in range(1, longest)]

    text = [F.col(c).cast("string").alias(c) for c in ("lang", "phrase")]
    cuts = found.select(*text, "a", "k", "first", "found").groupBy("lang", "phrase", "a").agg(
        F.array_compact(F.array(*side(True))).alias("ls"), F.array_compact(F.array(*side(False))).alias("rs"))
    scored = stored(map_batches(cuts, lambda batch: _scored(batch, scale),
                                "lang string, phrase string, a long, l long, r long, score long"), "phrase-scores")

    # a phrase goes if a longer candidate around it holds at least that share of its occurrences
    kept = scored
    if longest > 2:
        words = F.split("phrase", " ")
        parts = F.flatten(F.array(*(F.when(F.size(words) > size, _runs(words, size)).otherwise(F.array().cast("array<string>"))
                                    for size in range(2, longest))))
        around = scored.select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
        kept = scored.join(around, ["lang", "phrase"], "left").filter(f"around IS NULL OR 100 * around < {int(cover_percent)} * a")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = numbered(kept, "lang", best, best, "phrase-ranks", ["lang", "phrase", "a", "l", "r", "score"]).filter(F.col("_place") <= top)

    def totals(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for blob in batch["counts"]:
            names, weights = Automaton.from_bytes(blob.as_py()).grams().rows(0)
            out += [(lang, int(n)) for (lang,), n in zip(names, weights, strict=True)]
        names, weights = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_pydict({"lang": pa.array(names, pa.binary()), "n": pa.array(weights, pa.int64())})

    n = stored(map_batches(counts, totals, "lang binary, n long", rows=1).groupBy(F.col("lang").cast("string").alias("lang"))
               .agg(F.sum("n").alias("n")), "phrase-totals")
    return stored(ranked, "phrase-ranked").join(n, "lang").select(
        "lang", F.col("_place").alias("rank"), "phrase", "a", "l", "r", "n", "score")
