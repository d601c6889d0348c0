"""Weighted acyclic automata over label sequences, kept in arrays.

``Grams`` is the plain form: all sequences of a shard in sorted order, level by level, each with its weight.
``Automaton`` is the minimal form: sequences with equal continuations (labels, weights and what follows) share
one state. It is built from sorted sequences: the states of a level are finished once those below them are, and
a finished state that the register already has is not added again.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Key = tuple[bytes, ...]
KEY = 3  # sequences are put in order, and into ranges, by this many first labels


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def sum_by(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sums of their weights, and each key's place among them."""
    if not len(keys):
        return keys, weights, keys
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    return ordered[at], np.add.reduceat(weights[order], at), place


@dataclass
class Level:
    parent: np.ndarray  # row of the level above; rows are sorted by (parent, label)
    label: np.ndarray
    weight: np.ndarray  # 0: only a beginning of other sequences

    def keys(self) -> np.ndarray:
        return self.parent << 32 | self.label


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _empty() -> Level:
    return Level(*(np.zeros(0, np.int64) for _ in range(3)))


@dataclass
class Grams:
    labels: pa.Array  # binary, sorted and distinct
    levels: list[Level]

    @staticmethod
    def of(labels: pa.Array, columns: list[np.ndarray], lengths: np.ndarray, weights: np.ndarray) -> tuple[Grams, np.ndarray]:
        """Sequences given by column (label of each at that place, any number beyond its length); and the row of each in its last level."""
        levels, at = [], np.zeros(len(lengths), np.int64)
        for depth, column in enumerate(columns):
            on = np.flatnonzero(lengths > depth)
            ends = np.where(lengths[on] == depth + 1, weights[on], 0)
            keys, sums, place = sum_by(at[on] << 32 | column[on], ends)
            levels.append(Level(keys >> 32, keys & 0xFFFFFFFF, sums))
            at[on] = place
        return Grams(labels, levels), at

    def key_at(self, depth: int, row: int) -> Key:
        out: list[bytes] = []
        for level in reversed(self.levels[:depth + 1]):
            out.append(self.labels[int(level.label[row])].as_py())
            row = int(level.parent[row])
        return tuple(reversed(out)) + (b"",) * (KEY - depth - 1)

    def part(self, low: Key | None, high: Key | None) -> Grams:
        """The sequences whose key is at least ``low`` and below ``high``; beginnings of others have weight 0."""
        def first(depth: int, key: Key | None, none: int) -> int:
            rows = range(len(self.levels[depth].label))
            return none if key is None else bisect.bisect_left(rows, key, key=lambda row: self.key_at(depth, row))

        own = []
        for depth, level in enumerate(self.levels):
            if depth < KEY:
                own.append((first(depth, low, 0), first(depth, high, len(level.label))))
            else:
                own.append(tuple(int(x) for x in np.searchsorted(level.parent, own[-1])))
        taken = [(0, 0)] * (len(own) + 1)
        for depth in reversed(range(len(own))):  # with the rows that those below begin with
            a, b = own[depth]
            first_below, end_below = taken[depth + 1]
            if end_below > first_below:
                above = self.levels[depth + 1].parent
                c, d = int(above[first_below]), int(above[end_below - 1]) + 1
                a, b = (min(a, c), max(b, d)) if b > a else (c, d)
            taken[depth] = a, b
        levels, first_above = [], 0
        for level, (a, b), (own_a, own_b) in zip(self.levels, taken, own):
            here = np.arange(a, b)
            weight = np.where((here >= own_a) & (here < own_b), level.weight[a:b], 0)
            levels.append(Level(level.parent[a:b] - first_above, level.label[a:b], weight))
            first_above = a
        return Grams(self.labels, levels)

    def at_least(self, weight: int) -> Grams:
        """The sequences of that weight or more, with their beginnings (weight 0 where too light)."""
        keep = [level.weight >= weight for level in self.levels]
        for depth in range(len(self.levels) - 1, 0, -1):
            keep[depth - 1][self.levels[depth].parent[keep[depth]]] = True
        levels, place = [], np.zeros(1, np.int64)
        for level, kept in zip(self.levels, keep, strict=True):
            levels.append(Level(place[level.parent[kept]], level.label[kept], np.where(level.weight[kept] >= weight, level.weight[kept], 0)))
            place = np.cumsum(kept) - 1
        return Grams(self.labels, levels)

    def entries(self) -> int:
        return sum(len(level.label) for level in self.levels)

    def rows(self, depth: int) -> tuple[list[list[bytes]], np.ndarray]:
        """The sequences that end at ``depth`` with a weight, and their weights."""
        at = np.flatnonzero(self.levels[depth].weight)
        weights, columns = self.levels[depth].weight[at], []
        for level in reversed(self.levels[:depth + 1]):
            columns.append(self.labels.take(pa.array(level.label[at])).to_pylist())
            at = level.parent[at]
        return list(map(list, zip(*reversed(columns), strict=True))), weights


def union(parts: list[Grams]) -> Grams:
    """All sequences of the parts, weights of equal ones summed."""
    coded = pa.concat_arrays([p.labels for p in parts]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    labels, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    renamed = np.split(rank[np.asarray(coded.indices)], np.cumsum([len(p.labels) for p in parts])[:-1])
    levels, places = [], [np.zeros(1, np.int64) for _ in parts]
    for depth in range(max(len(p.levels) for p in parts)):
        here = [p.levels[depth] if depth < len(p.levels) else _empty() for p in parts]
        keys = np.concatenate([place[x.parent] << 32 | new[x.label] for x, place, new in zip(here, places, renamed, strict=True)])
        keys, sums, place = sum_by(keys, np.concatenate([x.weight for x in here]))
        levels.append(Level(keys >> 32, keys & 0xFFFFFFFF, sums))
        places = np.split(place, np.cumsum([len(x.label) for x in here])[:-1])
    return Grams(labels, levels)


def compose(wanted: Grams, counts: Grams) -> list[np.ndarray]:
    """Weights in ``counts`` of the sequences of ``wanted``, level by level (0: not there)."""
    renamed = np.asarray(pc.index_in(wanted.labels, counts.labels).fill_null(-1)).astype(np.int64)
    out, place = [], np.zeros(1, np.int64)
    for depth, level in enumerate(wanted.levels):
        there = counts.levels[depth].keys() if depth < len(counts.levels) else np.zeros(0, np.int64)
        above, label = place[level.parent], renamed[level.label]
        key = np.where((above < 0) | (label < 0), -1, above << 32 | label)
        at = np.searchsorted(there, key)
        found = (at < len(there)) & (key >= 0)
        found[found] = there[at[found]] == key[found]
        place = np.where(found, at, -1)
        out.append(np.where(found, counts.levels[depth].weight[np.where(found, at, 0)], 0) if len(there) else np.zeros(len(key), np.int64))
    return out


@dataclass
class Automaton:
    """Per level: states as offsets into arcs (label, weight, target state of the next level). State 0 has no arcs."""

    labels: pa.Array
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def build(grams: Grams) -> Automaton:
        levels, rows_above = [], [1] + [len(x.label) for x in grams.levels]
        target = np.zeros(rows_above[-1], np.int64)
        for depth in range(len(grams.levels) - 1, -1, -1):
            level = grams.levels[depth]
            starts = np.searchsorted(level.parent, np.arange(rows_above[depth] + 1))
            state, chosen = _register(starts, level.label, level.weight, target)
            lengths = np.concatenate([[0], (starts[1:] - starts[:-1])[chosen]])
            arcs = _spans(np.concatenate([[0], starts[:-1][chosen]]), lengths)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            levels.append((offsets, level.label[arcs], level.weight[arcs], target[arcs]))
            target = state
        return Automaton(grams.labels, [*reversed(levels), (target, *(np.zeros(0, np.int64),) * 3)])

    def grams(self) -> Grams:
        """The sequences that the paths from the start spell, in order."""
        out, at = [], self.levels[-1][0]
        for offsets, label, weight, target in self.levels[:-1]:
            lengths = offsets[at + 1] - offsets[at]
            arcs = _spans(offsets[at], lengths)
            out.append(Level(np.repeat(np.arange(len(at)), lengths), label[arcs], weight[arcs]))
            at = target[arcs]
        return Grams(self.labels, out)

    def to_bytes(self) -> bytes:
        used = np.unique(np.concatenate([label for _, label, _, _ in self.levels]))
        columns = {"labels": _one_list(self.labels.take(pa.array(used)))}
        for depth, (offsets, label, weight, target) in enumerate(self.levels):
            for name, values in (("o", offsets), ("l", np.searchsorted(used, label)), ("w", weight), ("t", target)):
                kind = pa.int64() if name == "w" else pa.int32()
                columns[f"{name}{depth}"] = _one_list(pa.array(values.astype(kind.to_pandas_dtype()), kind))
        batch = pa.RecordBatch.from_pydict(columns)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def from_bytes(data: bytes) -> Automaton:
        batch = pa.ipc.open_stream(data).read_next_batch()

        def numbers(name: str) -> np.ndarray:
            return batch[name].flatten().to_numpy().astype(np.int64)

        depth = (batch.num_columns - 1) // 4
        return Automaton(batch["labels"].flatten(), [tuple(numbers(f"{n}{d}") for n in "olwt") for d in range(depth)])


def _register(starts: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state (from 1; 0 has no arcs) of each row of arcs, and a row for each state."""
    lengths = starts[1:] - starts[:-1]
    state, chosen = np.zeros(len(lengths), np.int64), [np.zeros(0, np.int64)]
    single = np.flatnonzero(lengths == 1)
    if len(single):
        arc = starts[:-1][single]
        _, pair = np.unique(target[arc] << 32 | label[arc], return_inverse=True)
        weights, kind = np.unique(weight[arc], return_inverse=True)
        _, rows, place = np.unique(pair * len(weights) + kind, return_index=True, return_inverse=True)
        state[single] = place + 1
        chosen.append(single[rows])
    register: dict[bytes, int] = {}
    arcs, known, new = np.stack([label, weight, target], 1), sum(map(len, chosen)), []
    for row in np.flatnonzero(lengths > 1).tolist():
        signature = arcs[starts[row]:starts[row + 1]].tobytes()
        number = register.get(signature)
        if number is None:
            number = register[signature] = known + len(register) + 1
            new.append(row)
        state[row] = number
    return state, np.concatenate([*chosen, np.array(new, np.int64)])
