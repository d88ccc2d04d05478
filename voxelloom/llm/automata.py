"""Weighted acyclic automata over phrases of whole numbers, held as numpy arrays.

A count transducer reads a phrase label by label; the weight of a phrase is the sum of the weights on its path, and that is how
often the phrase occurs.  Every prefix of a phrase has a path, too.  A state is its transitions (label, weight, target), sorted by
label, and equal states are one.  Phrases are rows of positive labels below 2^31, zeros at the end.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from voxelloom.llm import words as W

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LABEL = np.uint64(0xFFFFFFFF)


class Level(NamedTuple):
    """The prefixes of one length, in phrase order: place of the prefix that is one label shorter, last label, occurrences."""

    parent: np.ndarray
    label: np.ndarray
    weight: np.ndarray


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    fresh = np.ones(len(columns[0]), dtype=bool)
    if len(fresh):
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return fresh


def levels(phrases: np.ndarray, counts: np.ndarray) -> tuple[list[Level], list[np.ndarray]]:
    """All prefixes of sorted distinct phrases by length, and each phrase's prefix of every length (its place there)."""
    out, places = [], []
    fresh, node = np.zeros(len(phrases), dtype=bool), np.zeros(len(phrases), dtype=np.int64)
    for label in phrases.T:
        fresh |= starts(label)
        edges = np.flatnonzero(fresh)
        real = label > 0
        sums = np.add.reduceat(counts, edges) if len(edges) else counts[:0]
        kept = edges[real[edges]]
        out.append(Level(node[kept], label[kept], sums[real[edges]]))
        node = np.cumsum(fresh & real) - 1
        places.append(node)
    return out, places


class Automaton:
    """Transitions lie state by state, size[s] of them at state s; state 0 has none, the last state is where reading starts.

    The arrays keep the types they come in: those of a dumped automaton are narrow.
    """

    def __init__(self, size: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray):
        self.size, self.label, self.weight, self.target = size, label, weight, target

    @property
    def root(self) -> int:
        return len(self.size) - 1

    def dumps(self) -> bytes:
        """Each array in the narrowest type that holds it, compressed."""
        heads, bodies = [], []
        for x in (self.size, self.label, self.weight, self.target):
            low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
            kind = np.promote_types(np.min_scalar_type(low), np.min_scalar_type(high)) if low < 0 else np.min_scalar_type(high)
            heads.append(struct.pack("<cI", kind.char.encode(), len(x)))
            bodies.append(x.astype(kind).tobytes())
        body = b"".join(heads + bodies)
        return struct.pack("<Q", len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def loads(data: bytes) -> Automaton:
    body = pa.decompress(data[8:], decompressed_size=struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True)
    heads = [struct.unpack_from("<cI", body, 5 * i) for i in range(4)]
    out, at = [], 20
    for kind, n in heads:
        kind = np.dtype(kind.decode())
        x = np.frombuffer(body, kind, n, at)
        out.append(x if kind != np.uint64 else x.astype(np.int64))  # with int64, uint64 would become float
        at += n * kind.itemsize
    return Automaton(*out)


class Builder:
    """Builds a minimal automaton from sorted phrases, run after run.

    A run holds whole subtrees below consecutive first labels.  No later phrase can change them, so their states are frozen at
    once, longest prefixes first: a state that the register knows is taken from there.  Only the transitions of the start stay
    open until `finish`.
    """

    def __init__(self):
        self.known, self.check, self.state = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.transitions, self.states = [np.zeros(1, np.int64)], [], 1
        self.open: list[tuple[np.ndarray, ...]] = []

    def _store(self, size: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray) -> np.ndarray:
        self.sizes.append(size)
        self.transitions.append((label, weight, target))
        self.states += len(size)
        return np.arange(self.states - len(size), self.states)

    def _freeze(self, nodes: int, owner: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The states of `nodes` nodes, given their transitions sorted by owner; a node without any is state 0."""
        out = np.zeros(nodes, dtype=np.int64)
        if not len(owner):
            return out
        with np.errstate(over="ignore"):
            mixed = W.mix(label.astype(np.uint64) * _ODD[0] + weight.astype(np.uint64) * _ODD[1] + target.astype(np.uint64) * _ODD[2])
            edge = np.flatnonzero(starts(owner))
            sign, proof = np.add.reduceat(mixed, edge), np.add.reduceat(W.mix(mixed ^ _ODD[3]), edge)
        size = np.diff(np.append(edge, len(owner)))
        ids = np.full(len(edge), -1, dtype=np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, sign), len(self.known) - 1)
            hit = (self.known[at] == sign) & (self.check[at] == proof)
            ids[hit] = self.state[at[hit]]
        new = np.flatnonzero(ids < 0)
        if len(new):
            _, index, inverse = np.unique(sign[new], return_index=True, return_inverse=True)
            like = new[index][inverse]
            like = np.where(proof[new] == proof[like], like, new)  # equal first hashes of unequal states: states of their own
            chosen, inverse = np.unique(like, return_inverse=True)
            n = size[chosen]
            at = np.repeat(edge[chosen] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            got = self._store(n, label[at], weight[at], target[at])
            ids[new] = got[inverse]
            known = np.concatenate((self.known, sign[chosen]))
            order = np.argsort(known, kind="stable")
            self.known, self.check, self.state = known[order], np.concatenate((self.check, proof[chosen]))[order], np.concatenate((self.state, got))[order]
        out[owner[edge]] = ids
        return out

    def add(self, run: list[Level]) -> None:
        target = np.zeros(len(run[-1].label), dtype=np.int64)
        for above, level in zip(run[-2::-1], run[:0:-1]):
            target = self._freeze(len(above.label), level.parent, level.label, level.weight - above.weight[level.parent], target)
        self.open.append((run[0].label, run[0].weight, target))

    def finish(self) -> Automaton:
        label, weight, target = (np.concatenate([x[i] for x in self.open] or [np.zeros(0, np.int64)]) for i in range(3))
        self._store(np.array([len(label)]), label, weight, target)
        return Automaton(np.concatenate(self.sizes), *(np.concatenate([t[i] for t in self.transitions]) for i in range(3)))


def runs(tree: list[Level], size: int = 1 << 17):
    """`tree` in runs of consecutive first labels with about `size` prefixes below them."""
    first = np.arange(len(tree[0].label) + 1)
    cuts = [first]
    for level in tree[1:]:  # the first prefix of each length below each first label
        cuts.append(np.searchsorted(level.parent, cuts[-1]))
    below = np.sum(cuts, axis=0)
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(below, below[a] + size, "right")) - 1)
        yield [Level(level.parent[c[a]:c[b]] - (0 if i == 0 else cuts[i - 1][a]), level.label[c[a]:c[b]], level.weight[c[a]:c[b]])
               for i, (level, c) in enumerate(zip(tree, cuts))]
        a = b


def build(tree: list[Level]) -> Automaton:
    builder = Builder()
    for run in runs(tree):
        builder.add(run)
    return builder.finish()


def union(automata: Iterable[Automaton], depth: int, least: int = 0, spared: Sequence[np.ndarray] = ()) -> list[Level]:
    """All prefixes that any of the automata reads, their weights summed: the automata are walked together, length by length.

    With `least`, what `prune` leaves of them: a prefix that occurs too seldom is dropped as soon as it is summed, and nothing
    is read below it, as no longer phrase occurs more often.
    """
    sizes, labels, weights, targets, roots, states = [], [], [], [], [], 0
    for a in automata:
        sizes.append(a.size)
        labels.append(a.label.astype(np.uint32))
        weights.append(a.weight)
        targets.append(a.target.astype(np.int64 if states + len(a.size) >= 1 << 31 else np.int32) + states)
        roots.append(states + a.root)
        states += len(a.size)
    first = np.zeros(states + 1, np.int64)
    np.cumsum(np.concatenate(sizes), dtype=np.int64, out=first[1:])
    sizes.clear()
    label, weight, target = (_joined(x) for x in (labels, weights, targets))
    state = np.array(roots, dtype=np.int64)
    total, merged = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    out, paths = [], [0 for _ in spared]
    for length in range(depth):
        n = first[state + 1] - first[state]
        at = np.repeat(first[state] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        total = np.repeat(total, n) + weight[at]
        key = np.repeat(merged, n).astype(np.uint64) << np.uint64(32) | label[at].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = starts(key)
        edge = np.flatnonzero(fresh)
        keys = key[edge]
        del key
        level = Level((keys >> np.uint64(32)).astype(np.int64), (keys & _LABEL).astype(np.int64),
                      np.add.reduceat(total[order], edge) if len(edge) else total[:0])
        keep = _kept(level, least, [p[length] for p in spared], paths)
        moved = np.cumsum(keep) - 1
        paths = [None if p is None else int(moved[p]) for p in paths]
        out.append(Level(*(x[keep] for x in level)))
        merged = np.empty(len(order), np.int64)
        merged[order] = np.cumsum(fresh) - 1
        on = keep[merged]
        merged, total, state = moved[merged[on]], total[on], target[at[on]].astype(np.int64)
    return out


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The arrays as one; they are let go."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def _kept(level: Level, least: int, labels: Sequence[int], paths: list[int | None]) -> np.ndarray:
    """Which prefixes stay; `paths`, the spared phrases' places in the level above, become those in this one."""
    keep = level.weight >= least
    for i, label in enumerate(labels):
        if paths[i] is not None:
            at = np.flatnonzero((level.parent == paths[i]) & (level.label == label))
            paths[i] = int(at[0]) if len(at) else None
            keep[at] = True
    return keep


def prune(tree: list[Level], least: int, spared: list[np.ndarray]) -> list[Level]:
    """The prefixes that occur `least` times or more, and all prefixes of the spared phrases."""
    out, moved, paths = [], np.zeros(1, np.int64), [0 for _ in spared]
    for depth, level in enumerate(tree):
        keep = _kept(level, least, [p[depth] for p in spared], paths)
        out.append(Level(moved[level.parent[keep]], level.label[keep], level.weight[keep]))
        moved = np.cumsum(keep) - 1
    return out


def phrases(tree: list[Level]):
    """(phrases, weights) of every length: rows of that many labels."""
    rows = np.zeros((1, 0), dtype=np.int64)
    for level in tree:
        rows = np.column_stack((rows[level.parent], level.label))
        yield rows, level.weight


def compose(asked: np.ndarray, counts: Automaton) -> np.ndarray:
    """Weights of sorted distinct phrases, 0 where the transducer does not read them.

    The phrases are an acyclic acceptor; its states are paired with states of the transducer, length by length.
    """
    tree, places = levels(asked, np.ones(len(asked), np.int64))
    key = np.repeat(np.arange(len(counts.size), dtype=np.uint64), counts.size) << np.uint64(32) | counts.label.astype(np.uint64)
    state, total, out = np.array([counts.root], np.int64), np.zeros(1, np.int64), np.zeros(len(asked), np.int64)
    for level, place, column in zip(tree, places, asked.T):
        wanted = state[level.parent].astype(np.uint64) << np.uint64(32) | level.label.astype(np.uint64)
        at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
        hit = key[at] == wanted if len(key) else np.zeros(len(wanted), dtype=bool)
        total = np.where(hit, total[level.parent] + counts.weight[at], 0) if len(key) else np.zeros(len(wanted), np.int64)
        state = np.where(hit, counts.target[at], 0) if len(key) else np.zeros(len(wanted), np.int64)  # state 0 reads nothing more
        real = column > 0
        out[real] = total[place[real]]
    return out
