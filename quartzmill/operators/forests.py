"""Forests of balanced classes on binned rows: large nodes by histograms of all tasks, the rest of each tree by one task a node.

Features are cut into at most ``bins`` bins by quantiles of all rows (all midpoints, where there are no more different values).  A row
takes part in a tree a Poisson number of times, and a node sees a drawn subset of the features; both come from hashes of the
row's, tree's and node's names, so neither partitions nor the way a node is split change the forest.

A node of more than ``NODE_ROWS`` rows is split from histograms that the tasks add up, a level of all trees a pass.  Then the
rows of each tree go to its open nodes in packed blocks, once, and one task grows all that is below a node, level by level: a
level sorts packed (node, bin, class, count) of each drawn feature.  So a level costs the rows that are still in open nodes, however
many nodes there are, and rows are read once for all deep levels, not once for each group of nodes.

Splits have the largest Gini gain; a split whose children are leaves of one class is taken back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import delete, folder

#: Rows of a node that one task may hold, rows of a packed block, points of a block's summary of a feature.
NODE_ROWS, BLOCK_ROWS, POINTS = 1 << 17, 8192, 1024
#: Gains below this are rounding; gains this close are equal, and the first feature and cut count.
NO_GAIN = 1e-12
#: A node as it travels: its left child (the right one follows it), feature and bin of its split, and the rows of each class.
NODE = np.dtype([("left", "<i4"), ("feature", "<i2"), ("bin", "u1"), ("n0", "<i4"), ("n1", "<i4")])
#: Chances of taking part 0, 1, 2, ... times, added up.
_POISSON = np.cumsum([0.36787944117144233 / f for f in np.cumprod([1.0, *range(1, 15)])])


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit names."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Plan:
    """What a task needs to grow a tree."""

    seed: int
    depth: int
    drawn: bool
    features: int
    weight: np.ndarray

    def _name(self, tree: int) -> np.uint64:
        return mixed(np.array([self.seed * 1_000_003 + tree + 1], np.uint64))[0]

    def times(self, keys: np.ndarray, tree: int) -> np.ndarray:
        """How often each row takes part in a tree."""
        if not self.drawn:
            return np.ones(len(keys), np.uint8)
        chance = (mixed(keys.view(np.uint64) ^ self._name(tree)) >> np.uint64(11)) * 2.0**-53
        return np.searchsorted(_POISSON, chance, side="right").astype(np.uint8)

    def chosen(self, tree: int, paths: np.ndarray) -> np.ndarray:
        """The features that each node may split, in order: the root of their number, rounded up."""
        if not self.drawn:
            return np.tile(np.arange(self.features), (len(paths), 1))
        many = int(np.ceil(np.sqrt(self.features)))
        names = mixed(mixed(paths.astype(np.uint64) ^ ~self._name(tree))[:, None] + mixed(np.arange(1, self.features + 1, dtype=np.uint64)))
        return np.sort(np.argpartition(names, many - 1, axis=1)[:, :many], axis=1)

    def gains(self, left: np.ndarray, every: np.ndarray) -> np.ndarray:
        """Gini gains of splits, from the rows of each class on the left side and in the node."""
        a, t = left * self.weight, every * self.weight
        b = t - a
        part = lambda v: (v**2).sum(axis=1) / v.sum(axis=1)
        return (part(a) + part(b) - part(t)) / t.sum(axis=1)

    def positive(self, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        return n1 * self.weight[1] > n0 * self.weight[0]


def _first_best(gains: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of gains in order of node: the nodes, and the place of the first of the largest of each."""
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    most = np.maximum.reduceat(gains, starts)
    near = np.flatnonzero(gains >= np.repeat(most, np.diff(np.r_[starts, len(node)])) - NO_GAIN)
    nodes, first = np.unique(node[near], return_index=True)
    return nodes, near[first]


def _splits(plan: Plan, base: np.ndarray, node: np.ndarray, bins: np.ndarray, rows: np.ndarray, chosen: np.ndarray, own: np.ndarray):
    """Feature, bin, gain and left rows of each node's best split; no feature where nothing is gained."""
    a = len(own)
    feature, cut, best, left = np.full(a, -1), np.zeros(a, int), np.full(a, NO_GAIN), np.zeros((a, 2), int)
    before = np.cumsum(own, axis=0) - own
    for s in range(chosen.shape[1]):
        key = base | (bins[rows, chosen[node, s]].astype(np.int64) << 5)
        key.sort()
        cell = key >> 5
        ends = np.flatnonzero(cell[1:] != cell[:-1])
        ends = ends[cell[ends] >> 8 == cell[ends + 1] >> 8]
        if not len(ends):
            continue
        times, one = key & 15, key >> 4 & 1
        upto, ones = np.cumsum(times), np.cumsum(times * one)
        at = cell[ends] >> 8
        side = np.stack([upto[ends] - ones[ends], ones[ends]], axis=1) - before[at]
        gains = plan.gains(side, own[at])
        nodes, first = _first_best(gains, at)
        better = gains[first] > best[nodes] + NO_GAIN
        nodes, first = nodes[better], first[better]
        best[nodes], feature[nodes], cut[nodes], left[nodes] = gains[first], chosen[nodes, s], cell[ends[first]] & 255, side[first]
    return feature, cut, best, left


def grown(plan: Plan, codes: np.ndarray, bins: np.ndarray, tree: int, root: int) -> tuple[np.ndarray, np.ndarray]:
    """All nodes below ``root`` (the name of a node; its children are 2 * root and the next), level by level, and the gains of each feature.

    ``codes`` are class << 4 | times taken part.
    """
    times, one = codes & 15, codes >> 4
    paths, depth, rows, node = np.array([root]), int(root).bit_length() - 1, np.arange(len(codes)), np.zeros(len(codes), np.int64)
    totals = np.array([[times[one == c].sum(dtype=int) for c in (0, 1)]])
    levels: list[list[np.ndarray]] = []
    while len(paths):
        level = [np.full(len(paths), -1), np.full(len(paths), -1), np.zeros(len(paths), int), totals, np.zeros(len(paths))]
        levels.append(level)
        open_ = np.flatnonzero((totals.min(axis=1) > 0) & (depth < plan.depth))
        if not len(open_):
            break
        place = np.full(len(paths), -1)
        place[open_] = np.arange(len(open_))
        live = place[node] >= 0
        rows, node = rows[live], place[node[live]]
        own = totals[open_]
        feature, cut, gain, left = _splits(plan, node << 13 | codes[rows], node, bins, rows, plan.chosen(tree, paths[open_]), own)
        split = np.flatnonzero(feature >= 0)
        at = open_[split]
        level[0][at], level[1][at], level[2][at], level[4][at] = 2 * np.arange(len(split)), feature[split], cut[split], gain[split]
        place = np.full(len(open_), -1)
        place[split] = np.arange(len(split))
        live = place[node] >= 0
        rows, node = rows[live], node[live]
        node = 2 * place[node] + (bins[rows, feature[node]] > cut[node])
        paths = (2 * paths[at][:, None] + np.arange(2)).ravel()
        totals = np.stack([left[split], own[split] - left[split]], axis=1).reshape(-1, 2)
        depth += 1
    return _packed(plan, levels)


def _packed(plan: Plan, levels: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Levels of (left, feature, bin, rows, gain) -> nodes in one array without splits that are taken back, and the gains of each feature."""
    for (left, feature, *_), (below, _, _, totals, _) in zip(levels[-2::-1], levels[:0:-1], strict=True):
        inner = np.flatnonzero(left >= 0)
        a, b = left[inner], left[inner] + 1
        sign = plan.positive(totals[:, 0], totals[:, 1])
        same = inner[(below[a] < 0) & (below[b] < 0) & (sign[a] == sign[b])]
        left[same] = feature[same] = -1
    out, gains, keep, start = [], np.zeros(plan.features), np.zeros(1, int), 0
    for left, feature, cut, totals, gain in levels:
        part = np.zeros(len(keep), NODE)
        inner = left[keep] >= 0
        part["left"] = np.where(inner, start + len(keep) + 2 * (np.cumsum(inner) - 1), -1)
        part["feature"], part["bin"], part["n0"], part["n1"] = feature[keep], cut[keep], totals[keep, 0], totals[keep, 1]
        gains += np.bincount(feature[keep][inner], gain[keep][inner] * (totals[keep][inner] @ plan.weight), plan.features)
        out.append(part)
        start += len(keep)
        keep = (left[keep][inner][:, None] + np.arange(2)).ravel()
        if not len(keep):
            break
    return np.concatenate(out), gains


# -- large nodes ------------------------------------------------------------------


@dataclass
class Top:
    """The splits of a tree's large nodes, by name."""

    paths: np.ndarray
    feature: np.ndarray
    bin: np.ndarray

    @staticmethod
    def of(splits: dict[int, tuple]) -> Top:
        paths = sorted(splits)
        return Top(np.array(paths, np.int64), np.array([splits[p][0] for p in paths], int), np.array([splits[p][1] for p in paths], int))

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node below the large ones that each row is in."""
        at = np.ones(len(bins), np.int64)
        live = np.arange(len(bins) if len(self.paths) else 0)
        while len(live):
            i = np.minimum(np.searchsorted(self.paths, at[live]), len(self.paths) - 1)
            known = self.paths[i] == at[live]
            live, i = live[known], i[known]
            at[live] = 2 * at[live] + (bins[live, self.feature[i]] > self.bin[i])
        return at


def _unpacked(batch: pa.RecordBatch, features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of keys, classes and bins."""
    for keys, one, bins in zip(*(batch.column(i) for i in range(3)), strict=True):
        yield np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(one.as_buffer(), np.uint8), np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, features)


def _large_splits(blocks: DataFrame, plan: Plan, tops: dict[int, Top], wanted: dict[int, np.ndarray]) -> list:
    """One pass: of each wanted (tree, node) the feature, bin, gain, rows on the left and rows of its best split."""
    features = plan.features

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = {t: plan.chosen(t, p) for t, p in wanted.items()}
        held = {t: np.zeros((*c.shape, 256, 2), np.int64) for t, c in chosen.items()}
        some = False
        for batch in batches:
            for keys, one, bins in _unpacked(batch, features):
                some = True
                for t, names in wanted.items():
                    times = plan.times(keys, t)
                    at = tops[t].place(bins)
                    i = np.minimum(np.searchsorted(names, at), len(names) - 1)
                    own = np.flatnonzero((names[i] == at) & (times > 0))
                    i = i[own]
                    for s in range(chosen[t].shape[1]):
                        cell = (i * 256 + bins[own, chosen[t][i, s]]) * 2 + one[own]
                        held[t][:, s] += np.bincount(cell, times[own], len(names) * 512).astype(np.int64).reshape(-1, 256, 2)
        for t, names in wanted.items() if some else ():
            cells = [h.tobytes() for h in held[t]]
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(cells, pa.binary())], ["tree", "node", "cells"])

    def split(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best split of one node, its tasks' histograms added up one after another."""
        tree, name = (k.as_py() for k in key)
        cells = sum(np.frombuffer(c.as_buffer(), np.int64) for part in parts for c in part.column("cells")).reshape(-1, 256, 2)
        chosen, every = plan.chosen(tree, np.array([name]))[0], cells[0].sum(axis=0)
        found = (-1, 0, NO_GAIN, 0, 0, int(every[0]), int(every[1]))
        for s, f in enumerate(chosen):
            left = np.cumsum(cells[s], axis=0)
            # a bin without rows cuts as the one before it
            cuts = np.flatnonzero((cells[s].sum(axis=1) > 0) & (left.sum(axis=1) < every.sum()))
            if len(cuts):
                gains = plan.gains(left[cuts], np.tile(every, (len(cuts), 1)))
                best = int(np.flatnonzero(gains >= gains.max() - NO_GAIN)[0])
                if gains[best] > found[2] + NO_GAIN:
                    found = (int(f), int(cuts[best]), float(gains[best]), int(left[cuts[best], 0]), int(left[cuts[best], 1]), int(every[0]), int(every[1]))
        yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(("tree", "node", "feature", "bin", "gain", "l0", "l1", "n0", "n1"), (tree, name, *found), strict=True)})

    form = "tree int, node long, feature long, bin long, gain double, l0 long, l1 long, n0 long, n1 long"

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                now = (batch.column(0)[i], batch.column(1)[i])
                if now != key:
                    if held:
                        yield from _cast(split(key, iter(held)))
                    key, held = now, []
                held = [batch.slice(i, 1)] if not held else [_added(held[0], batch.slice(i, 1))]
        if held:
            yield from _cast(split(key, iter(held)))

    many = 4 * sum(map(len, wanted.values()))
    met = blocks.mapInArrow(counted, "tree int, node long, cells binary").repartition(many, "tree", "node").sortWithinPartitions("tree", "node")
    return met.mapInArrow(best, form).collect()  # a row a large node


def _added(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
    cells = np.frombuffer(a.column("cells")[0].as_buffer(), np.int64) + np.frombuffer(b.column("cells")[0].as_buffer(), np.int64)
    return pa.RecordBatch.from_arrays([a.column(0), a.column(1), pa.array([cells.tobytes()], pa.binary())], ["tree", "node", "cells"])


def _cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), *b.columns[1:]], b.schema.names)


# -- the fit ------------------------------------------------------------------------


def _cut_points(data: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """The cuts of each feature, fewer than ``bins``, from summaries of all blocks."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
            for f in range(features):
                value, n = np.unique(x[:, f], return_counts=True)
                if len(value) > POINTS:
                    upto = np.cumsum(n)
                    at = np.unique(np.searchsorted(upto, np.linspace(0, upto[-1], POINTS + 1)[1:]))
                    value, n = value[at], np.diff(upto[at], prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), f, np.int32)), pa.array(value), pa.array(n.astype(np.int64))], ["f", "value", "n"])

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.groupby("value", sort=True)["n"].sum()
        value, upto = own.index.to_numpy(float), own.to_numpy().cumsum()
        at = np.arange(len(value) - 1)
        if len(value) > bins:
            at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins))
            at = at[at < len(value) - 1]
        return pd.DataFrame({"f": [int(pdf["f"].iloc[0])], "cuts": [((value[at] + value[at + 1]) / 2).tolist()]})

    found = data.select("x").mapInArrow(summed, "f int, value double, n long").groupBy("f").applyInPandas(cuts, "f int, cuts array<double>")
    return [np.array(r.cuts, float) for r in sorted(found.collect(), key=lambda r: r.f)]  # a row a feature


def _binned(data: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``data(x, key, y)`` in packed blocks of keys, classes and bins."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
            bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
            keys, one = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.uint8)
            for at in range(0, len(x), BLOCK_ROWS):
                parts = [a[at : at + BLOCK_ROWS].tobytes() for a in (keys, one, bins)]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], ["keys", "one", "bins"])

    return data.select("x", "key", "y").mapInArrow(pack, "keys binary, one binary, bins binary")


def _grow_all(blocks: DataFrame, plan: Plan, tops: dict[int, Top], groups: int) -> list:
    """``(tree, node, nodes, gains)`` of what lies below the large nodes."""
    features = plan.features

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, one, bins in _unpacked(batch, features):
                for t, top in tops.items():
                    times = plan.times(keys, t)
                    rows = np.flatnonzero(times)
                    at = top.place(bins[rows])
                    cells = np.column_stack([one[rows] << 4 | times[rows], bins[rows]])
                    names = np.unique(at)
                    parts = [cells[at == n].tobytes() for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(parts, pa.binary())], ["tree", "node", "cells"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            cells = np.frombuffer(b"".join(held), np.uint8).reshape(-1, features + 1)
            nodes, gains = grown(plan, cells[:, 0].copy(), np.ascontiguousarray(cells[:, 1:]), *key)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([nodes.tobytes()], pa.binary()), pa.array([gains.tobytes()], pa.binary())], ["tree", "node", "nodes", "gains"])

        key, held = None, []
        for batch in batches:
            for t, n, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (t, n) != key:
                    if held:
                        yield done()
                    key, held = (t, n), []
                held.append(cells.as_py())
        if held:
            yield done()

    met = blocks.mapInArrow(dealt, "tree int, node long, cells binary").repartition(2 * groups, "tree", "node").sortWithinPartitions("tree", "node")
    return met.mapInArrow(grow, "tree int, node long, nodes binary, gains binary").collect()  # the packed model


def _joined(plan: Plan, splits: dict[int, tuple], below: dict[int, np.ndarray], gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One tree from the splits of its large nodes and what lies below them; ``splits[name]`` is (feature, bin, n0, n1, gain)."""
    gains = gains.copy()
    for name in sorted(splits, reverse=True):
        f, _, n0, n1, gain = splits[name]
        pair = [below.get(2 * name), below.get(2 * name + 1)]
        if all(p is not None and len(p) == 1 for p in pair) and plan.positive(pair[0]["n0"], pair[0]["n1"]) == plan.positive(pair[1]["n0"], pair[1]["n1"]):
            below[name] = np.array([(-1, -1, 0, n0, n1)], NODE)
            del splits[name]
        else:
            gains[f] += gain * (np.array([n0, n1]) @ plan.weight)
    head, order, tails = [], [1], []
    for name in order:
        if name in splits:
            f, b, n0, n1, _ = splits[name]
            head.append((len(order), f, b, n0, n1))
            order += [2 * name, 2 * name + 1]
        else:
            head.append(tuple(below[name][0].tolist()))
    head, start = np.array(head, NODE), len(order)
    for slot, name in enumerate(order):
        if name not in splits and len(below[name]) > 1:
            part = below[name].copy()
            part["left"] = np.where(part["left"] >= 0, part["left"] - 1 + start, -1)
            head["left"][slot] = part["left"][0]
            tails.append(part[1:])
            start += len(part) - 1
    return np.concatenate([head, *tails]), gains


@dataclass
class ForestClassifier:
    seed: int
    trees: int = 100
    depth: int = 30
    bins: int = 128
    drawn: bool = True

    def fit(self, rows: DataFrame) -> Forest:
        """``rows(features, y, weight, row_id if there is one)``; rows without a class are left out, and a class has one weight."""
        from pyspark.ml.functions import vector_to_array

        if not 2 <= self.bins <= 256:
            raise ValueError("2 to 256 bins")
        spark = rows.sparkSession
        key = F.xxhash64("row_id") if "row_id" in rows.columns else F.monotonically_increasing_id()
        data = rows.where("y is not null").select(vector_to_array("features").alias("x"), key.alias("key"), F.col("y").cast("int"), F.col("weight").cast("double"))
        classes = data.groupBy("y").agg(F.count("*").alias("n"), F.min("weight").alias("w"), F.max("weight").alias("most"), F.max(F.size("x")).alias("m")).collect()
        if not classes or any(r.y not in (0, 1) or r.w != r.most for r in classes):
            raise ValueError("a forest needs rows of classes 0 and 1, each of one weight")
        weight, n, features = np.ones(2), sum(r.n for r in classes), classes[0].m
        for r in classes:
            weight[r.y] = r.w
        plan = Plan(self.seed, self.depth, self.drawn, features, weight)
        even = data.repartition(-(-n // BLOCK_ROWS))
        cuts = _cut_points(even, features, self.bins)
        path = f"{folder(spark)}/binned-{uuid.uuid4().hex}"
        _binned(even, cuts).write.parquet(path)
        try:
            found = self._grown(spark.read.schema("keys binary, one binary, bins binary").parquet(path), plan, n)
        finally:
            delete(spark, path)
        return Forest([t for t, _ in found], cuts, weight, np.stack([g for _, g in found]))

    def _grown(self, blocks: DataFrame, plan: Plan, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        splits: dict[int, dict[int, tuple]] = {t: {} for t in range(self.trees)}
        wanted = {t: np.array([1], np.int64) for t in splits} if n > NODE_ROWS and self.depth else {}
        tops = {t: Top.of(s) for t, s in splits.items()}
        while wanted:
            found, wanted = _large_splits(blocks, plan, tops, wanted), {}
            for r in found:
                if r.feature < 0:
                    continue
                splits[r.tree][r.node] = (r.feature, r.bin, r.n0, r.n1, r.gain)
                for name, a, b in ((2 * r.node, r.l0, r.l1), (2 * r.node + 1, r.n0 - r.l0, r.n1 - r.l1)):
                    if a + b > NODE_ROWS and min(a, b) > 0 and name.bit_length() <= self.depth:
                        wanted.setdefault(r.tree, []).append(name)
            wanted = {t: np.array(sorted(names), np.int64) for t, names in wanted.items()}
            tops = {t: Top.of(s) for t, s in splits.items()}
        below: dict[int, dict[int, np.ndarray]] = {t: {} for t in splits}
        gains = {t: np.zeros(plan.features) for t in splits}
        for r in _grow_all(blocks, plan, tops, sum(len(s) + 1 for s in splits.values())):
            below[r.tree][r.node] = np.frombuffer(r.nodes, NODE)
            gains[r.tree] += np.frombuffer(r.gains)
        for t in splits:
            below[t] = below[t] or {1: np.array([(-1, -1, 0, 0, 0)], NODE)}  # a tree that drew no row
        return [_joined(plan, splits[t], below[t], gains[t]) for t in splits]


class Forest:
    """A fitted forest: packed nodes of each tree, the cuts of each feature, the classes' weights, the gains of each tree's features."""

    def __init__(self, trees: list[np.ndarray], cuts: list[np.ndarray], weight: np.ndarray, gains: np.ndarray):
        self.trees, self.cuts, self.weight, self.gains = trees, cuts, weight, gains
        total = gains.sum(axis=1, keepdims=True)
        shares = np.divide(gains, total, out=np.zeros(gains.shape), where=total > 0).sum(axis=0)
        self.featureImportances = shares / shares.sum() if shares.sum() > 0 else shares

    def hasParam(self, name: str) -> bool:  # noqa: N802
        return name in ("probabilityCol", "rawPredictionCol")

    def table(self) -> np.ndarray:
        """The nodes by tree and number, with cuts, covers and positive shares."""
        width = max(map(len, self.cuts), default=0)
        cuts = np.zeros((len(self.cuts) + 1, width + 1))
        for f, c in enumerate(self.cuts):
            cuts[f, : len(c)] = c
        nodes = np.concatenate(self.trees)
        inner = nodes["left"] >= 0
        form = [("treeID", "i4"), ("id", "i4"), ("left", "i4"), ("right", "i4"), ("feature", "i4"), ("cut", "f8"), ("cover", "f8"), ("share", "f8")]
        out = np.zeros(len(nodes), form)
        sizes = [len(t) for t in self.trees]
        out["treeID"], out["id"] = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])
        out["left"], out["right"], out["feature"] = nodes["left"], np.where(inner, nodes["left"] + 1, -1), nodes["feature"]
        out["cut"] = np.where(inner, cuts[nodes["feature"], np.minimum(nodes["bin"], width)], 0.0)
        out["cover"] = nodes["n0"] * self.weight[0] + nodes["n1"] * self.weight[1]
        out["share"] = np.divide(nodes["n1"] * self.weight[1], out["cover"], out=np.zeros(len(out)), where=out["cover"] > 0)
        return out.view(np.recarray)

    def positive(self, x: np.ndarray) -> np.ndarray:
        """The mean positive share of the leaves that rows reach."""
        bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(self.cuts)], axis=1)
        total = np.zeros(len(x))
        for nodes in self.trees:
            at, live = np.zeros(len(x), np.int64), np.arange(len(x))
            left, feature, cut = nodes["left"], nodes["feature"], nodes["bin"]
            while len(live := live[left[at[live]] >= 0]):
                own = at[live]
                at[live] = left[own] + (bins[live, feature[own]] > cut[own])
            end = nodes[at]
            cover = end["n0"] * self.weight[0] + end["n1"] * self.weight[1]
            total += np.divide(end["n1"] * self.weight[1], cover, out=np.zeros(len(x)), where=cover > 0)
        return total / len(self.trees)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``rawPrediction`` (sums over trees), ``probability`` and ``prediction``."""
        from pyspark.ml.functions import array_to_vector, vector_to_array

        sent, many = rows.sparkSession.sparkContext.broadcast(self), float(len(self.trees))

        @F.pandas_udf("double")
        def share(x: pd.Series) -> pd.Series:
            return pd.Series(sent.value.positive(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        out = rows.withColumn("__p", share(vector_to_array("features")))
        p = F.col("__p")
        pair = F.array(1 - p, p)
        cells = {"rawPrediction": array_to_vector(F.transform(pair, lambda v: v * many)), "probability": array_to_vector(pair), "prediction": (p > 0.5).cast("double")}
        return out.withColumns(cells).drop("__p")

    # -- saved form: a table of trees and one of the rest

    def write(self) -> Forest:
        return self

    def overwrite(self) -> Forest:
        return self

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        rest = [(f, c.tolist(), self.gains[:, f].tolist(), self.weight.tolist()) for f, c in enumerate(self.cuts)]
        spark.createDataFrame([(t, bytearray(n.tobytes())) for t, n in enumerate(self.trees)], "tree int, nodes binary").write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame(rest, "feature int, cuts array<double>, gains array<double>, weight array<double>").write.mode("overwrite").parquet(f"{path}/features")

    @staticmethod
    def load(path: str) -> Forest:
        spark = SparkSession.getActiveSession()
        trees = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
        rest = spark.read.parquet(f"{path}/features").orderBy("feature").collect()
        return Forest([np.frombuffer(r.nodes, NODE) for r in trees], [np.array(r.cuts, float) for r in rest], np.array(rest[0].weight), np.stack([r.gains for r in rest], axis=1))
