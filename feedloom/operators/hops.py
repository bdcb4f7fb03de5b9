"""What tasks do for two hops: followees in packed lists, and whom these follow, counted beside the lists without a row for each path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Paths that are counted at once, and ids of one packed row at most.
STEP, ROW = 1 << 21, 1024
#: Below this, a number of three parts is sorted as one.
WIDEST = 1 << 62


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _found(names: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted names, and the places of these."""
    if not len(names):
        return np.zeros(len(values), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(names, values), len(names) - 1)
    hit = names[at] == values
    return hit, at[hit]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, id, n, ids) of pairs (id, other) that come sorted: part is the task, an id may have several rows, n is a row's length."""
    part = TaskContext.get().partitionId()
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        starts = _cuts(key, np.arange(len(key)) // ROW)
        ends = np.append(starts, len(key)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), part, np.int32)), pa.array(key[starts]), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), batch.column(1))], ["part", "id", "n", "ids"])


class _Cell:
    """The lists of one cell, and its viewers as they come: what is held of them is up to STEP paths, or one viewer's."""

    def __init__(self, n: int, step: int) -> None:
        self.n, self.step = n, step
        self.lists: list[tuple[np.ndarray, ...]] = []
        self.ready = False
        self.open = [np.zeros(0, np.int64)] * 4

    def hold(self, ids: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
        self.lists.append((ids.copy(), sizes, values.copy()))

    def _settle(self) -> None:
        """Ids of all lists as places among the different ones, in their order."""
        ids, sizes, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*self.lists, strict=True) if self.lists else [()] * 3))
        self.lists = []
        first = _cuts(ids) if len(ids) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        self.vias, self.starts = ids[first], ends[first]
        self.sizes = np.diff(np.append(self.starts, ends[-1]))
        self.names = np.unique(values)
        self.places = np.empty(len(values), np.int32)
        for k in range(0, len(values), self.step):
            self.places[k : k + self.step] = np.searchsorted(self.names, values[k : k + self.step])
        self.ready = True

    def ask(self, ids: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Viewers in order with those they follow."""
        if not self.ready:
            self._settle()
        viewers = np.repeat(ids, sizes)
        via, at = _found(self.vias, values)
        known, place = _found(self.names, values)
        for k, x in enumerate((viewers[via], at, viewers[known], place)):
            self.open[k] = np.concatenate([self.open[k], x])
        if self.sizes[self.open[1]].sum() + len(self.open[2]) > self.step:
            # the last viewer may have more rows
            ends = np.searchsorted(self.open[0], ids[-1]), np.searchsorted(self.open[2], ids[-1])
            done = [x[: ends[k // 2]] for k, x in enumerate(self.open)]
            self.open = [x[ends[k // 2] :] for k, x in enumerate(self.open)]
            yield from self._count(*done)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.ready:
            yield from self._count(*self.open)

    def _count(self, viewers: np.ndarray, vias: np.ndarray, owners: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        """In steps of whole viewers. Paths go by once for all: their sum is known before they are made."""
        if not len(viewers):
            return
        cuts = np.append(_cuts(viewers), len(viewers))
        paths = np.concatenate([[0], np.cumsum(self.sizes[vias])])[cuts]
        most = max(1, WIDEST // ((len(self.vias) + 1) * len(self.names)))
        k = 0
        while k < len(cuts) - 1:
            to = min(max(k + 1, int(np.searchsorted(paths, paths[k] + self.step, "right")) - 1), k + most, len(cuts) - 1)
            part = slice(cuts[k], cuts[to])
            mine = slice(np.searchsorted(owners, viewers[cuts[k]]), np.searchsorted(owners, viewers[cuts[to] - 1], "right"))
            yield self._top(viewers[cuts[k:to]], np.diff(cuts[k : to + 1]), vias[part], owners[mine], own[mine])
            k = to

    def _top(self, viewers: np.ndarray, follows: np.ndarray, vias: np.ndarray, owners: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        wide, sizes = len(self.names), self.sizes[vias]
        at = np.repeat(self.starts[vias] - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        # a pair of a viewer and an id is one number, in the order of both
        pairs = np.repeat(np.repeat(np.arange(len(viewers)) * wide, follows), sizes)
        pairs += self.places[at]
        del at
        known, self_at = _found(self.names, viewers)
        # who follows nobody with a list here has no paths to leave out
        here, owner = _found(viewers, owners)
        out = np.concatenate([owner * wide + own[here], np.flatnonzero(known) * wide + self_at])
        if len(viewers) * wide <= 4 * len(pairs):
            counts = np.bincount(pairs, minlength=len(viewers) * wide)
            counts[out] = 0
            pairs = np.flatnonzero(counts)
            counts = counts[pairs]
        else:
            pairs.sort()
            first = _cuts(pairs)
            counts = np.diff(np.append(first, len(pairs)))
            pairs = pairs[first]
            counts[_found(pairs, out)[1]] = 0
            pairs, counts = pairs[counts > 0], counts[counts > 0]
        # the viewer, the most paths first, then the smaller id: again one number; a viewer's pairs stay in their places
        most = int(counts.max(initial=1))
        first = np.searchsorted(pairs, np.arange(len(viewers) + 1) * wide)
        who = np.repeat(np.arange(len(viewers)), np.diff(first))
        pairs += (who * (most - 1) + (most - counts)) * wide
        pairs.sort()
        order = pairs[np.arange(len(pairs)) - first[who] < self.n]
        who, rest = np.divmod(order, wide * most)
        less, place = np.divmod(rest, wide)
        return pa.RecordBatch.from_arrays([pa.array(viewers[who]), pa.array(self.names[place]), pa.array(most - less)], ["viewer", "id", "paths"])


def counted(n: int, step: int = STEP):
    """(viewer, id, paths): of every cell the n ids with the most paths, for each viewer; from rows (block, shard, kind, id, ids) in that order, lists (kind 0) before viewers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, _Cell(n, step)
        for batch in batches:
            if not batch.num_rows:
                continue
            block, shard, kind, ids = (batch.column(k).to_numpy() for k in range(4))
            sizes = batch.column(4).value_lengths().to_numpy().astype(np.int64)
            values, ends = batch.column(4).flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            cuts = np.append(_cuts(block, shard, kind), len(ids))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if (block[lo], shard[lo]) != now:
                    yield from cell.rest()
                    now, cell = (block[lo], shard[lo]), _Cell(n, step)
                for at in range(lo, hi, ROW):
                    to = min(at + ROW, hi)
                    rows = ids[at:to], sizes[at:to], values[ends[at] : ends[to]]
                    if kind[lo]:
                        yield from cell.ask(*rows)
                    else:
                        cell.hold(*rows)
        yield from cell.rest()

    return run
