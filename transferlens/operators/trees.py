"""Second-order boosted trees and random forests, grown level by level on distributed split searches.

Many models (settings, folds, training subsets) grow side by side in the same passes over the rows.
"""

from __future__ import annotations

import base64
import json
import math
import pickle
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from transferlens.operators.splits import (
    BINS, PASS_NUMBERS, Block, Gini, Newton, Packed, Rows, Split, blocks_of, histograms, pack, released, search, summed, with_margins, without_values,
)

# Rounds after which margins are written instead of being recomputed from the trees.
KEPT_ROUNDS = 8
# The same where rows are written without their values.
CODED_ROUNDS = 2
# A node with at most this many rows is finished inside one task.
TASK_ROWS = 1 << 16
# Trees of a forest that are grown in the same passes.
TREES_TOGETHER = 256


# ---------------------------------------------------------------- trees


class Tree:
    """Nodes as columns; a leaf has feature -1."""

    def __init__(self, feature=(), threshold=(), left=(), right=(), value=()):
        self.feature, self.threshold, self.left, self.right, self.value = (list(c) for c in (feature, threshold, left, right, value))

    def add(self, value: float) -> int:
        for column, v in zip(self.columns(), (-1, 0.0, 0, 0, value)):
            column.append(v)
        return len(self.value) - 1

    def split(self, node: int, feature: int, threshold: float, values: tuple[float, float]) -> tuple[int, int]:
        left, right = self.add(values[0]), self.add(values[1])
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, left, right
        return left, right

    def columns(self) -> tuple:
        return self.feature, self.threshold, self.left, self.right, self.value

    def graft(self, node: int, other: "Tree") -> None:
        """Puts a whole tree in the place of a leaf."""
        base = len(self.value) - 1  # the other root takes the leaf's place, its other nodes follow

        def moved(i: int) -> int:
            return base + i

        for i in range(len(other.value)):
            at = node if i == 0 else self.add(other.value[i])
            self.feature[at], self.threshold[at], self.value[at] = other.feature[i], other.threshold[i], other.value[i]
            self.left[at], self.right[at] = moved(other.left[i]), moved(other.right[i])

    def fixed(self) -> "FixedTree":
        return FixedTree(
            np.array(self.feature, np.int16), np.array(self.threshold, np.float64), np.array(self.left, np.int32), np.array(self.right, np.int32), np.array(self.value, np.float64)
        )


@dataclass(frozen=True)
class FixedTree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every column of ``x`` (features in rows)."""
        node = np.zeros(x.shape[1], np.int32)
        moving = np.arange(x.shape[1]) if self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(moving):
            at = node[moving]
            left = x[self.feature[at], moving] <= self.threshold[at]
            at = np.where(left, self.left[at], self.right[at])
            node[moving] = at
            moving = moving[self.feature[at] >= 0]
        return node

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]

    def coded(self, edges: list[np.ndarray]) -> "FixedTree":
        """The tree for codes instead of values, where its thresholds are borders of bins."""
        code = [float(np.searchsorted(edges[f], t)) if f >= 0 else 0.0 for f, t in zip(self.feature, self.threshold)]
        return replace(self, threshold=np.array(code, np.float64))


def packed_trees(trees: list[FixedTree]) -> str:
    return base64.b64encode(pickle.dumps([(t.feature, t.threshold, t.left, t.right, t.value) for t in trees])).decode()


class _Plain(pickle.Unpickler):
    """Reads arrays only."""

    def find_class(self, module: str, name: str):
        if module.split(".")[0] == "numpy":
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"unexpected {module}.{name}")


def unpacked_trees(text: str) -> list[FixedTree]:
    import io

    return [FixedTree(*columns) for columns in _Plain(io.BytesIO(base64.b64decode(text))).load()]


# ---------------------------------------------------------------- settings


@dataclass(frozen=True)
class BoostedSetting:
    """``penalty`` is added to every leaf's hessian; ``min_gain`` is what a split must bring to be kept."""

    rounds: int
    rate: float = 0.3
    depth: int = 6
    penalty: float = 1.0
    min_gain: float = 0.0
    min_hessian: float = 1.0
    min_split: int = 2
    min_leaf: int = 1
    subsample: float = 1.0
    seed: int = 42
    rows: Rows = Rows()


@dataclass(frozen=True)
class ForestSetting:
    """``depth`` None grows until nodes are pure or have fewer than ``min_split`` rows."""

    trees: int
    depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    features: int | None = None
    bootstrap: bool = True
    seed: int = 42
    rows: Rows = Rows()


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _uniform(key: np.ndarray, *salts: int) -> np.ndarray:
    """A number from 0 to 1 per key and salts."""
    h = key.copy()
    with np.errstate(over="ignore"):
        for s in salts:
            h = (h ^ np.uint64(s & (2**64 - 1))) * _MIX
            h ^= h >> np.uint64(32)
            h = h * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)) / float(1 << 53)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def bootstrap_counts(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn: independent Poisson(1) counts by hash, the large-table form of drawing with replacement."""
    return np.searchsorted(_POISSON, _uniform(key, seed, tree), side="right").astype(np.float64)


# ---------------------------------------------------------------- boosting


def _grouped(sizes: list[int], limit: int) -> list[list[int]]:
    """Numbers of neighbouring items whose sizes add up to at most the limit (or single ones)."""
    out: list[list[int]] = []
    room = 0
    for i, size in enumerate(sizes):
        if not out or size > room:
            out.append([])
            room = limit
        out[-1].append(i)
        room -= size
    return out


class _Round:
    """One tree per setting, grown level by level."""

    def __init__(self, data: Packed, settings: list[BoostedSetting], active: list[int], number: int, since: list[list[FixedTree]], exact: bool):
        self.data, self.settings, self.active, self.number, self.since, self.exact = data, settings, active, number, since, exact
        self.trees = {s: Tree() for s in active}
        self.gains: dict[int, dict[int, float]] = {s: {} for s in active}

    def weigh(self, places: list[tuple[int, int, FixedTree, np.ndarray]]):
        """``places``: (setting, number of its first node, its tree so far, local number of each tree node or -1)."""
        settings, since, number, exact = self.settings, self.since, self.number, self.exact

        def run(block: Block):
            for s, first, tree, local in places:
                setting = settings[s]
                x = block.x if exact else block.codes
                p = 1 / (1 + np.exp(-margin(block, s, since[s], x)))
                on = setting.rows.mask(block)
                if setting.subsample < 1:
                    on &= _uniform(block.key, setting.seed, number) < setting.subsample
                node = np.where(on, local[tree.leaves(x)], -1)
                positive = block.y == 1
                yield first, int(local.max()) + 1, node, np.stack([np.where(positive, 0, p), np.where(positive, 1 - p, 0), p * (1 - p), np.ones(block.n)])

        return run

    def seen(self, tree: FixedTree) -> FixedTree:
        """A tree by what passes read of the rows: values, or codes where thresholds are borders."""
        return tree if self.exact else tree.coded(self.data.edges)

    def leaf(self, s: int, sums: np.ndarray) -> float:
        setting = self.settings[s]
        weight = sums[2] + setting.penalty
        return float(-(sums[0] - sums[1]) / weight * setting.rate) if weight > 0 else 0.0

    def rule(self, s: int) -> Newton:
        setting = self.settings[s]
        return Newton(setting.penalty, setting.min_hessian, setting.min_leaf)

    def run(self) -> dict[int, FixedTree]:
        frontier = {s: [(self.trees[s].add(0.0), None)] for s in self.active}  # (node, sums)
        kept: dict[tuple[int, int], np.ndarray] = {}  # histograms of the level above by (setting, node)
        pairs: dict[int, list[tuple[int, int, int]]] = {}
        for level in range(max(self.settings[s].depth for s in self.active)):
            frontier = {s: nodes for s, nodes in frontier.items() if nodes and level < self.settings[s].depth}
            if not frontier:
                break
            following: dict[int, list] = {}
            tables: dict[tuple[int, int], np.ndarray] = {}
            groups = _grouped([len(n) for n in frontier.values()], max(1, PASS_NUMBERS // (Newton.channels * self.data.width * BINS)))
            for group in groups:
                members = [list(frontier)[i] for i in group]
                self._level({s: frontier[s] for s in members}, kept, pairs, following, tables)
            frontier, kept = following, tables
        return {s: self._pruned(s).fixed() for s in self.active}

    def _level(self, frontier, kept, pairs, following, tables) -> None:
        def places_of(nodes_by_setting: dict[int, list[int]]):
            out, first = [], 0
            for s, nodes in nodes_by_setting.items():
                local = np.full(len(self.trees[s].value), -1, np.int32)
                local[nodes] = np.arange(len(nodes))
                if nodes:
                    out.append((s, first, self.seen(self.trees[s].fixed()), local))
                first += len(nodes)
            return out, first

        # Of two children only the smaller one is added up; the other is the parent less it.
        built = {}
        for s, nodes in frontier.items():
            known = {n for n, _ in nodes}
            skip = {other for small, other, parent in pairs.get(s, []) if small in known and other in known and (s, parent) in kept}
            built[s] = [n for n, _ in nodes if n not in skip]
        places, n_built = places_of(built)
        channels = Newton.channels
        sums = histograms(self.data, self.weigh(places), n_built, channels)
        at = {(s, n): k for k, (s, n) in enumerate((s, n) for s, nodes in built.items() for n in nodes)}
        tables_here = {key: sums[:, :, k] for key, k in at.items()}
        for s, nodes in frontier.items():
            for small, other, parent in pairs.get(s, []):
                if (s, small) in tables_here and (s, other) not in tables_here and (s, parent) in kept:
                    tables_here[s, other] = kept[s, parent] - tables_here[s, small]
        order = [(s, n) for s, nodes in frontier.items() for n, _ in nodes]
        for s in {self.rule(s): s for s in frontier}.values():  # settings of one rule are searched together
            members = [t for t in frontier if self.rule(t) == self.rule(s)]
            places, n_nodes = places_of({t: [n for n, _ in frontier[t]] for t in members})
            mine = [key for key in order if key[0] in members]
            table = np.stack([tables_here[key] for key in mine], axis=2)
            found = search(self.data, self.weigh(places), n_nodes, self.rule(s), exact=self.exact, sums=table)
            whole = table.sum(axis=3)[:, 0]
            for k, ((t, node), split) in enumerate(zip(mine, found)):
                self._apply(t, node, whole[:, k], split, following, pairs, tables, tables_here)

    def _apply(self, s: int, node: int, whole: np.ndarray, split: Split | None, following, pairs, tables, tables_here) -> None:
        setting, tree = self.settings[s], self.trees[s]
        tree.value[node] = self.leaf(s, whole)
        if split is None or split.score <= 1e-6 or whole[3] < setting.min_split:
            return
        left, right = tree.split(node, split.feature, split.threshold, (self.leaf(s, split.left), self.leaf(s, split.right)))
        self.gains[s][node] = split.score
        tables[s, node] = tables_here[s, node]
        following.setdefault(s, []).extend([(left, split.left), (right, split.right)])
        small, other = (left, right) if split.left[3] <= split.right[3] else (right, left)
        pairs.setdefault(s, []).append((small, other, node))

    def _pruned(self, s: int) -> Tree:
        """Splits under the minimum gain go, from the bottom up."""
        tree, least = self.trees[s], self.settings[s].min_gain
        for node in sorted(self.gains[s], reverse=True):
            children = tree.left[node], tree.right[node]
            if self.gains[s][node] < least and all(tree.feature[c] < 0 for c in children):
                tree.feature[node] = -1
        return tree


def margin(block: Block, s: int, since: list[FixedTree], x: np.ndarray) -> np.ndarray:
    """``x`` has what the trees' thresholds are of: the block's values or its codes."""
    out = block.margin[s].copy() if len(block.margin) else np.zeros(block.n)
    for tree in since:
        out += tree.values(x)
    return out


def grow_boosted(data: Packed, settings: list[BoostedSetting], exact: bool = False) -> list[list[FixedTree]]:
    """The trees of every setting, all settings in the same passes: one per level (more with ``exact``) and round."""
    trees: list[list[FixedTree]] = [[] for _ in settings]
    since: list[list[FixedTree]] = [[] for _ in settings]
    data = first = data if exact else without_values(data)
    for number in range(max(s.rounds for s in settings)):
        active = [i for i, s in enumerate(settings) if number < s.rounds]
        grown = _Round(data, settings, active, number, since, exact)
        for s, tree in grown.run().items():
            trees[s].append(tree)
            since[s].append(grown.seen(tree))
        if (number + 1) % (KEPT_ROUNDS if exact else CODED_ROUNDS) == 0 and number + 1 < max(s.rounds for s in settings):
            waiting = [list(t) for t in since]

            def margins(block: Block, waiting=waiting) -> np.ndarray:
                return np.stack([margin(block, s, t, block.x if exact else block.codes) for s, t in enumerate(waiting)])

            before, data = data, with_margins(data, margins)
            since = [[] for _ in settings]
            if before is not first:
                released(before)
    if data is not first:
        released(data)
    return trees


def stage_counts(data: Packed, jobs: list[tuple[list[FixedTree], list[int], Rows, bool]], mean: bool) -> list[list[tuple[int, int, int, int]]]:
    """(tn, fp, fn, tp) after the first n trees, for every n of each job (trees, stages, rows, held-out rows instead).

    A row is positive if the sum of its trees' values is over 0, or their mean over one half.
    """
    places, size = [], 0
    for _, stages, _, _ in jobs:
        places.append(size)
        size += 4 * len(stages)

    def add(block: Block, total: np.ndarray) -> None:
        for (trees, stages, rows, held), first in zip(jobs, places):
            on = np.flatnonzero(block.fold == rows.held_out if held else rows.mask(block))
            if not len(on):
                continue
            x, y, sums = np.ascontiguousarray(block.x[:, on]), 2 * block.y[on].astype(np.int64), np.zeros(len(on))
            wanted = {n: first + 4 * i for i, n in enumerate(stages)}
            for n in range(1, max(stages) + 1):
                if n <= len(trees):
                    sums += trees[n - 1].values(x)
                if n in wanted:
                    says = sums > (0.5 * min(n, len(trees)) if mean else 0)
                    total[wanted[n] : wanted[n] + 4] += np.bincount(y + says, minlength=4)

    counts = summed(data, size, add).astype(int)
    return [[tuple(counts[first + 4 * i : first + 4 * i + 4].tolist()) for i in range(len(stages))] for (_, stages, _, _), first in zip(jobs, places)]


# ---------------------------------------------------------------- forests


def _feature_order(seed: int, tree: int, path: int, width: int) -> np.ndarray:
    """Random order of the features at a node, by hash of its place in the tree."""
    draws = _uniform(np.arange(width, dtype=np.uint64), seed + 1, tree, path, path >> 64, path >> 128)
    return np.argsort(draws, kind="stable")


def grow_inside_task(x: np.ndarray, y: np.ndarray, weight: np.ndarray, setting: ForestSetting, tree_no: int, path: int, depth: int) -> Tree:
    """A whole subtree from a node's rows (features in rows), by sorting them at each node."""
    out, width = Tree(), x.shape[0]
    take = setting.features or max(1, int(math.sqrt(width)))
    positive = np.where(y == 1, weight, 0.0)
    waiting = [(out.add(0.0), np.arange(len(y)), path, depth)]
    while waiting:
        node, rows, path, depth = waiting.pop()
        w, w1 = weight[rows], positive[rows]
        whole = np.array([0.0, w1.sum(), len(rows)])
        whole[0] = w.sum() - whole[1]
        out.value[node] = float(whole[1] / (whole[0] + whole[1]))
        if _is_leaf(whole, setting, depth):
            continue
        order = _feature_order(setting.seed, tree_no, path, width)
        best = None
        for group in (order[:take], *order[take:, None]):
            for f in sorted(group.tolist()):
                found = _best_value(x[f, rows], w, w1, whole, setting.min_leaf)
                if found is not None and (best is None or found[0] > best[0]):
                    best = (*found, f)
            if best is not None:
                break
        if best is None:
            continue
        _, low, high, feature = best
        middle = low + (high - low) / 2
        threshold = middle if low <= middle < high else low
        goes = x[feature, rows] <= threshold
        left, right = out.split(node, feature, threshold, (0.0, 0.0))
        waiting += [(right, rows[~goes], 2 * path + 1, depth + 1), (left, rows[goes], 2 * path, depth + 1)]
    return out


def _best_value(values: np.ndarray, w: np.ndarray, w1: np.ndarray, whole: np.ndarray, min_leaf: int) -> tuple[float, float, float] | None:
    """(score, value, next value) of the first best split of one feature, scored as ``Gini`` does."""
    order = np.argsort(values)
    values = values[order]
    at = np.flatnonzero(values[1:] > values[:-1])
    if min_leaf > 1:
        at = at[(at + 1 >= min_leaf) & (len(values) - at - 1 >= min_leaf)]
    if not len(at):
        return None
    left, left1 = np.cumsum(w[order])[at], np.cumsum(w1[order])[at]
    total = whole[0] + whole[1]
    right, right1 = total - left, whole[1] - left1
    score = np.round(-(2 * (left - left1) * left1 / left + 2 * (right - right1) * right1 / right) / total, Gini.digits)
    k = int(score.argmax())
    return float(score[k]), float(values[at[k]]), float(values[at[k] + 1])


def _is_leaf(whole: np.ndarray, setting: ForestSetting, depth: int) -> bool:
    pure = whole[0] == 0 or whole[1] == 0
    return pure or whole[2] < max(setting.min_split, 2 * setting.min_leaf) or (setting.depth is not None and depth >= setting.depth)


def grow_forests(data: Packed, settings: list[ForestSetting], task_rows: int = TASK_ROWS) -> list[list[FixedTree]]:
    """The trees of every forest. ``min_split`` counts a node's different rows, however often they were drawn.

    Nodes with more rows than ``task_rows`` are split by distributed searches, level by level; the rows of the
    others are brought together and a task finishes each. Where a node's first features have one value only,
    the next ones in its random order are tried.
    """
    wanted = [(s, t) for s, setting in enumerate(settings) for t in range(setting.trees)]
    forests: list[list[FixedTree]] = [[] for _ in settings]
    for a in range(0, len(wanted), TREES_TOGETHER):
        part = wanted[a : a + TREES_TOGETHER]
        for (s, _), tree in zip(part, _grow_some(data, settings, part, task_rows)):
            forests[s].append(tree)
    return forests


def _grow_some(data: Packed, settings: list[ForestSetting], wanted: list[tuple[int, int]], task_rows: int) -> list[FixedTree]:
    trees = [Tree() for _ in wanted]

    def terms(block: Block, i: int) -> np.ndarray:
        s, t = wanted[i]
        setting = settings[s]
        weight = bootstrap_counts(block.key, setting.seed, t) if setting.bootstrap else np.ones(block.n)
        weight = np.where(setting.rows.mask(block), weight, 0.0)
        return np.stack([np.where(block.y == 0, weight, 0), np.where(block.y == 1, weight, 0), (weight > 0).astype(np.float64)])

    def roots(block: Block, total: np.ndarray) -> None:
        for i in range(len(wanted)):
            total[3 * i : 3 * i + 3] += terms(block, i).sum(axis=1)

    whole = summed(data, 3 * len(wanted), roots).reshape(-1, 3)
    large: list[tuple[int, int, int, int]] = []  # (tree, node, path, depth)
    small: list[tuple[int, int, int, int]] = []

    def place(i: int, node: int, path: int, depth: int, sums: np.ndarray) -> None:
        trees[i].value[node] = float(sums[1] / (sums[0] + sums[1])) if sums[0] + sums[1] else 0.0
        if sums[2] and not _is_leaf(sums, settings[wanted[i][0]], depth):
            (large if sums[2] > task_rows else small).append((i, node, path, depth))

    for i in range(len(wanted)):
        place(i, trees[i].add(0.0), 1, 0, whole[i])
    while large:
        level, large = large, []
        room = max(1, PASS_NUMBERS // (Gini.channels * data.width * BINS))
        for a in range(0, len(level), room):
            _split_large(data, settings, wanted, trees, level[a : a + room], terms, place)
    if small:
        _finish_small(data, settings, wanted, trees, small, terms)
    return [t.fixed() for t in trees]


def _weigh_nodes(trees: list[Tree], nodes: list[tuple], terms):
    """``Weigh`` of some nodes of several trees."""
    by_tree: dict[int, list[tuple[int, int]]] = {}
    for k, (i, node, *_) in enumerate(nodes):
        by_tree.setdefault(i, []).append((k, node))
    places = []
    for i, members in by_tree.items():
        local = np.full(len(trees[i].value), -1, np.int32)
        local[[n for _, n in members]] = np.arange(len(members))
        places.append((i, members[0][0], trees[i].fixed(), local, len(members)))

    def run(block: Block):
        for i, first, tree, local, k in places:
            t = terms(block, i)
            yield first, k, np.where(t[2] > 0, local[tree.leaves(block.x)], -1), t

    return run


def _split_large(data, settings, wanted, trees, nodes, terms, place) -> None:
    nodes = sorted(nodes, key=lambda n: n[0])  # a tree's nodes stand together
    width = data.width
    orders = [_feature_order(settings[wanted[i][0]].seed, wanted[i][1], path, width) for i, _, path, _ in nodes]
    takes = [settings[wanted[i][0]].features or max(1, int(math.sqrt(width))) for i, *_ in nodes]
    tried, open_nodes = list(takes), list(range(len(nodes)))
    sums = histograms(data, _weigh_nodes(trees, nodes, terms), len(nodes), Gini.channels)
    # Where all rows of a node have one value of a feature, no search is needed to see that it cannot be split there.
    held = sums[-1] > 0
    varied = (held.sum(axis=2) > 1) | (held & data.mixed[:, None, :]).any(axis=2)
    for k, order in enumerate(orders):
        while tried[k] < width and not varied[order[: tried[k]], k].any():
            tried[k] += 1
    while open_nodes:
        here = [nodes[k] for k in open_nodes]
        allowed = np.zeros((len(here), width), bool)
        for row, k in enumerate(open_nodes):
            allowed[row, orders[k][: tried[k]]] = True
        leaf_sizes = {settings[wanted[n[0]][0]].min_leaf for n in here}
        found: list[Split | None] = [None] * len(here)
        for least in leaf_sizes:
            members = [row for row, n in enumerate(here) if settings[wanted[n[0]][0]].min_leaf == least]
            some = [here[row] for row in members]
            mine = sums[:, :, [open_nodes[row] for row in members]]
            for row, split in zip(members, search(data, _weigh_nodes(trees, some, terms), len(some), Gini(least), allowed[members], sums=mine)):
                found[row] = split
        still = []
        for k, split in zip(open_nodes, found):
            i, node, path, depth = nodes[k]
            if split is None:
                if tried[k] < width:
                    tried[k] += 1
                    still.append(k)
                continue
            left, right = trees[i].split(node, split.feature, split.threshold, (0.0, 0.0))
            place(i, left, 2 * path, depth + 1, split.left)
            place(i, right, 2 * path + 1, depth + 1, split.right)
        open_nodes = still


def _finish_small(data, settings, wanted, trees, small, terms) -> None:
    weigh, width = _weigh_nodes(trees, small := sorted(small, key=lambda n: n[0]), terms), data.width

    def deal(batches):
        for block in blocks_of(batches, width):
            for first, k, node, t in weigh(block):
                order = np.argsort(node, kind="stable")
                bounds = np.searchsorted(node[order], np.arange(k + 1))
                for j in range(k):
                    rows = order[bounds[j] : bounds[j + 1]]
                    if len(rows):
                        weight = t[0, rows] + t[1, rows]
                        blob = (np.ascontiguousarray(block.x[:, rows]).tobytes(), block.y[rows].tobytes(), weight.tobytes())
                        yield pd.DataFrame([(first + j, len(rows), *blob)], columns=["node", "n", "x", "y", "weight"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["node"].iloc[0])
        i, _, path, depth = small[k]
        x = np.concatenate([np.frombuffer(b, np.float64).reshape(width, n) for b, n in zip(pdf["x"], pdf["n"])], axis=1)
        y = np.concatenate([np.frombuffer(b, np.uint8) for b in pdf["y"]])
        weight = np.concatenate([np.frombuffer(b, np.float64) for b in pdf["weight"]])
        s, t = wanted[i]
        tree = grow_inside_task(x, y, weight, settings[s], t, path, depth)
        return pd.DataFrame({"node": [k], "tree": [pickle.dumps(tree.columns())]})

    dealt = data.blocks.mapInPandas(deal, "node int, n int, x binary, y binary, weight binary")
    finished = dealt.groupBy("node").applyInPandas(finish, "node int, tree binary").toArrow()
    for k, columns in zip(finished["node"].to_pylist(), finished["tree"].to_pylist()):
        i, node, *_ = small[k]
        trees[i].graft(node, Tree(*pickle.loads(columns)))


# ---------------------------------------------------------------- estimators


class _TreeParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    keyCol = Param(Params._dummy(), "keyCol", "column whose hash decides random draws; without it the row's content does", TypeConverters.toString)

    def _pack(self, df: DataFrame) -> Packed:
        key = self.getOrDefault(self.keyCol)
        return pack(df, self.getFeaturesCol(), self.getLabelCol(), key=key if key in df.columns else None)


class _TreeModel(Model, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    trees = Param(Params._dummy(), "trees", "the packed trees", TypeConverters.toString)

    def __init__(self, trees: list[FixedTree] | None = None):
        super().__init__()
        self._setDefault(keyCol="row_key")
        self._set(trees=packed_trees(trees or []))

    def tree_list(self) -> list[FixedTree]:
        return unpacked_trees(self.getOrDefault(self.trees))

    def first(self, n: int):
        """The model of the first ``n`` trees."""
        out = self._copyValues(type(self)(), {})
        return out._set(trees=packed_trees(self.tree_list()[:n]))

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, probability = self.tree_list(), self._probability

        @F.pandas_udf("struct<raw double, p double>")
        def apply(features: pd.Series) -> pd.DataFrame:
            if not len(features):
                return pd.DataFrame({"raw": [], "p": []}, dtype=float)
            raw = sum((t.values(np.vstack(features).T) for t in trees), np.zeros(len(features)))
            return pd.DataFrame({"raw": raw, "p": probability(raw, len(trees))})

        scored = df.withColumn("_score", apply(vector_to_array(self.getFeaturesCol())))
        raw, p = F.col("_score")["raw"], F.col("_score")["p"]
        return scored.withColumns({
            self.getRawPredictionCol(): array_to_vector(F.array(-raw, raw)),
            self.getProbabilityCol(): array_to_vector(F.array(1 - p, p)),
            self.getPredictionCol(): F.when(p > 0.5, 1.0).otherwise(0.0),
        }).drop("_score")


class BoostedTrees(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Second-order boosted trees. Thresholds are borders of 256 bins unless ``exact``."""

    rounds = Param(Params._dummy(), "rounds", "number of trees", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "factor on every leaf", TypeConverters.toFloat)
    depth = Param(Params._dummy(), "depth", "levels of splits", TypeConverters.toInt)
    penalty = Param(Params._dummy(), "penalty", "added to a leaf's hessian", TypeConverters.toFloat)
    minGain = Param(Params._dummy(), "minGain", "gain under which a split is taken back", TypeConverters.toFloat)
    minHessian = Param(Params._dummy(), "minHessian", "least hessian of a side", TypeConverters.toFloat)
    minSplit = Param(Params._dummy(), "minSplit", "least rows of a node that is split", TypeConverters.toInt)
    minLeaf = Param(Params._dummy(), "minLeaf", "least rows of a side", TypeConverters.toInt)
    subsample = Param(Params._dummy(), "subsample", "share of the rows a tree is grown on", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of the subsamples", TypeConverters.toInt)
    exact = Param(Params._dummy(), "exact", "search all distinct values", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self, *, rounds=100, rate=0.3, depth=6, penalty=1.0, minGain=0.0, minHessian=1.0, minSplit=2, minLeaf=1, subsample=1.0, seed=42, exact=False,
        featuresCol="features", labelCol="label", keyCol="row_key",
    ):
        super().__init__()
        self._setDefault(
            rounds=100, rate=0.3, depth=6, penalty=1.0, minGain=0.0, minHessian=1.0, minSplit=2, minLeaf=1, subsample=1.0, seed=42, exact=False, keyCol="row_key"
        )
        self._set(**self._input_kwargs)

    def setting(self, rows: Rows = Rows()) -> BoostedSetting:
        get = self.getOrDefault
        return BoostedSetting(
            get(self.rounds), get(self.rate), get(self.depth), get(self.penalty), get(self.minGain), get(self.minHessian), get(self.minSplit), get(self.minLeaf),
            get(self.subsample), get(self.seed), rows,
        )

    def _fit(self, df: DataFrame) -> "BoostedTreesModel":
        data = self._pack(df)
        trees = grow_boosted(data, [self.setting()], self.getOrDefault(self.exact))[0]
        released(data)
        return self._copyValues(BoostedTreesModel(trees))


class BoostedTreesModel(_TreeModel):
    @staticmethod
    def _probability(raw: np.ndarray, trees: int) -> np.ndarray:
        return 1 / (1 + np.exp(-raw))


class Forest(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Random forest whose trees split at any distinct value; ``depth`` 0 or less sets no limit."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of splits, no limit if under 1", TypeConverters.toInt)
    minSplit = Param(Params._dummy(), "minSplit", "least rows of a node that is split", TypeConverters.toInt)
    minLeaf = Param(Params._dummy(), "minLeaf", "least rows of a side", TypeConverters.toInt)
    bootstrap = Param(Params._dummy(), "bootstrap", "draw each tree's rows with replacement", TypeConverters.toBoolean)
    featuresPerNode = Param(Params._dummy(), "featuresPerNode", "features tried at a node, the square root of all if under 1", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of rows and features drawn", TypeConverters.toInt)
    taskRows = Param(Params._dummy(), "taskRows", "a node with at most so many rows is finished inside one task", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, numTrees=100, depth=0, minSplit=2, minLeaf=1, bootstrap=True, featuresPerNode=0, seed=42, taskRows=TASK_ROWS,
        featuresCol="features", labelCol="label", keyCol="row_key",
    ):
        super().__init__()
        self._setDefault(numTrees=100, depth=0, minSplit=2, minLeaf=1, bootstrap=True, featuresPerNode=0, seed=42, taskRows=TASK_ROWS, keyCol="row_key")
        self._set(**self._input_kwargs)

    def setting(self, rows: Rows = Rows()) -> ForestSetting:
        get = self.getOrDefault
        depth, features = get(self.depth), get(self.featuresPerNode)
        return ForestSetting(
            get(self.numTrees), depth if depth > 0 else None, get(self.minSplit), get(self.minLeaf), features if features > 0 else None, get(self.bootstrap), get(self.seed), rows
        )

    def _fit(self, df: DataFrame) -> "ForestModel":
        data = self._pack(df)
        trees = grow_forests(data, [self.setting()], self.getOrDefault(self.taskRows))[0]
        released(data)
        return self._copyValues(ForestModel(trees))


class ForestModel(_TreeModel):
    @staticmethod
    def _probability(raw: np.ndarray, trees: int) -> np.ndarray:
        return raw / max(trees, 1)
