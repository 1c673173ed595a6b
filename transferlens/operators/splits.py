"""Best splits of many tree nodes at once, over all distinct values of the features.

Rows lie in packed blocks with their values and, per feature, the number of a coarse bin. One pass adds up
each node's sums by feature and bin. Inside a bin the left side's sums move from one end to the other, and
the score is concave or convex in them, so the corners of that box bound what any value inside can reach.
Bins that cannot beat the best bin border are done; the others are looked at again by their distinct values
(or, where they hold many rows, by finer bins), until no bin is left that could. The result is the split
that a search over all sorted values finds, and the coarse bins only decide how much is looked at twice.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from transferlens.session import discard, materialise, reread

# Partial sums of up to this many tasks are added on the driver.
DIRECT_TASKS = 64
BINS = 256
# A bin with at most this many rows is looked at value by value.
LISTED_ROWS = 8192
# Numbers in one pass's sums; more nodes take several passes.
PASS_NUMBERS = 1 << 22
# A block is one large Parquet value. A row group holds 16 of them, as a reader unpacks a whole group at once, and
# group sizes are those of compressed bytes; pages are closed by size from the first block on.
SMALL_PARTS = {"parquet.block.row.count.limit": 16, "parquet.page.size.row.check.min": 1}
# Most bytes of a block and of the blocks that go to Python at once. Spark's 64 MB stand several times in a task: as Arrow
# buffers, as the bytes sent, and twice in Python. Values of a megabyte and more make the JVM's heap grow, as they lie outside
# its young generation. Blocks that come together are joined again for the sums.
BLOCK_BYTES = 320 << 10
BATCH_BYTES = 1 << 20
# Columns sketched for quantiles at once: a task holds 50,000 boxed values of each.
SKETCHED_COLUMNS = 4


# ---------------------------------------------------------------- packed rows


@dataclass
class Block:
    """Some rows, column by column: values, coarse bins, label, fold, key hash, first step per fold, margins by setting."""

    x: np.ndarray
    codes: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    key: np.ndarray
    steps: np.ndarray
    margin: np.ndarray

    @property
    def n(self) -> int:
        return len(self.y)


@dataclass(frozen=True)
class Rows:
    """Rows that a model learns from: all but a fold, and of those a nested training subset."""

    held_out: int | None = None
    step: int | None = None

    def mask(self, block: Block) -> np.ndarray:
        if self.held_out is None:
            return np.ones(block.n, bool)
        on = block.fold != self.held_out
        return on if self.step is None else on & (block.steps[self.held_out] <= self.step)


@dataclass
class Packed:
    """Written blocks, read anew by every pass: they are not cached, so an executor's memory does not grow with the rows."""

    written: DataFrame
    blocks: DataFrame
    tasks: int
    edges: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray
    #: (feature, bin): whether the bin holds different values
    mixed: np.ndarray
    #: rows that a node's neighbours to a split were looked up in, see ``_halfway``
    known_gaps: dict = field(default_factory=dict)

    @property
    def width(self) -> int:
        return len(self.edges)

    def bounds(self, f: int, code: int) -> tuple[float, float]:
        """Values of a bin: greater than the first, up to the second."""
        e = self.edges[f]
        return (float(e[code - 1]) if code else -math.inf), (float(e[code]) if code < len(e) else math.inf)


_SHAPE = "n int, x binary, codes binary, y binary, fold binary, key binary, steps binary, margin binary"


def _written_blocks(pdf: pd.DataFrame, width: int) -> Iterator[Block]:
    for r in pdf.itertuples(index=False):
        n = r.n
        yield Block(
            np.frombuffer(r.x, np.float64).reshape(width, -1), np.frombuffer(r.codes, np.uint8).reshape(width, n), np.frombuffer(r.y, np.uint8),
            np.frombuffer(r.fold, np.int32), np.frombuffer(r.key, np.uint64), np.frombuffer(r.steps, np.int32).reshape(-1, n),
            np.frombuffer(r.margin, np.float64).reshape(-1, n),
        )


def blocks_of(batches: Iterator[pd.DataFrame], width: int) -> Iterator[Block]:
    """The written blocks of each batch as one, so that few passes of Python code see many rows."""
    names = [f.name for f in fields(Block)]
    for pdf in batches:
        parts = list(_written_blocks(pdf, width))
        if parts:
            yield Block(*[np.concatenate([getattr(b, c) for b in parts], axis=-1) for c in names]) if len(parts) > 1 else parts[0]


def pack(df: DataFrame, features: str, label: str, fold: str | None = None, key: str | None = None, steps: str | None = None, bins: int = BINS) -> Packed:
    """Packs rows for split searches; ``key`` (else the row's content) decides what draws by hash take.

    ``steps`` is an array column: for each fold, the number of the first training subset that holds the row.
    """
    if not 2 <= bins <= BINS:
        raise ValueError(f"bins must be from 2 to {BINS}, not {bins}")
    array = vector_to_array(features)
    fold_column = (F.col(fold) if fold else F.lit(-1)).cast("int")
    hashed = F.xxhash64(key) if key else F.xxhash64(array, F.col(label))
    rows = df.select(
        array.alias("x"), F.col(label).cast("int").alias("y"), fold_column.alias("fold"), hashed.alias("key"),
        (F.col(steps).cast("array<int>") if steps else F.array().cast("array<int>")).alias("steps"),
    )
    first = rows.select(F.size("x")).first()
    if first is None:
        raise ValueError("there are no rows to learn from")
    width = first[0]
    wide = rows.select(*[F.col("x")[i].alias(f"f{i}") for i in range(width)])
    probabilities, found = [i / (bins - 1) for i in range(bins)], []
    for i in range(0, width, SKETCHED_COLUMNS):
        found += wide.approxQuantile(wide.columns[i : i + SKETCHED_COLUMNS], probabilities, 0.1 / bins)
    edges = [np.array(sorted(set(v))[:-1], np.float64) for v in found]

    def to_blocks(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.ascontiguousarray(np.vstack(pdf["x"]).T.astype(np.float64))
            codes = np.vstack([np.searchsorted(e, x[f], side="left") for f, e in enumerate(edges)]).astype(np.uint8)
            steps = np.ascontiguousarray(np.vstack([np.asarray(s, np.int32) for s in pdf["steps"]]).T)
            parts = [x, codes, pdf["y"].to_numpy(np.uint8), pdf["fold"].to_numpy(np.int32), pdf["key"].to_numpy(np.int64), steps]
            cuts = np.linspace(0, len(pdf), math.ceil(sum(a.nbytes for a in parts) / BLOCK_BYTES) + 1).astype(int)
            cut = [(int(b - a), *[p[..., a:b].tobytes() for p in parts], b"") for a, b in zip(cuts, cuts[1:]) if b > a]
            yield pd.DataFrame(cut, columns=[c.split()[0] for c in _SHAPE.split(", ")])

    blocks = reread(materialise(rows.mapInPandas(to_blocks, _SHAPE), **SMALL_PARTS), spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES))
    tasks = max(1, min(blocks.count(), blocks.rdd.getNumPartitions()))
    low, high = np.array([v[0] for v in found]), np.array([v[-1] for v in found])
    data = Packed(blocks, blocks.coalesce(tasks), tasks, edges, low, high, np.zeros((width, BINS), bool))
    data.mixed = _mixed_bins(data)
    return data


def _mixed_bins(data: Packed) -> np.ndarray:
    """Which bins hold more than one value: in some block, or the greatest values of two blocks differ."""
    width = data.width

    def ends(batches):
        least, most = np.full((width, BINS), np.inf), np.full((width, BINS), -np.inf)
        for block in blocks_of(batches, width):
            for f in range(width):
                np.minimum.at(least[f], block.codes[f], block.x[f])
                np.maximum.at(most[f], block.codes[f], block.x[f])
        yield pd.DataFrame({"least": [least.tobytes()], "most": [most.tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        least = np.minimum.reduce([np.frombuffer(b, np.float64) for b in pdf["least"]])
        most = np.maximum.reduce([np.frombuffer(b, np.float64) for b in pdf["most"]])
        return pd.DataFrame({"least": [least.tobytes()], "most": [most.tobytes()]})

    parts = data.blocks.mapInPandas(ends, "least binary, most binary")
    parts = parts.groupBy((F.spark_partition_id() % DIRECT_TASKS).alias("p")).applyInPandas(merge, "least binary, most binary")
    whole = merge(parts.toPandas())
    least, most = (np.frombuffer(whole[c][0], np.float64).reshape(width, BINS) for c in ("least", "most"))
    return least < most


def without_values(data: Packed) -> Packed:
    """The same rows with codes only: passes that need no values read an eighth of the bytes."""
    return replace(data, blocks=data.blocks.withColumn("x", F.lit(b"")))


def with_margins(data: Packed, margins: Callable[[Block], np.ndarray]) -> Packed:
    """The same rows with new margins, as a written table: no state is lost with a task and no lineage grows."""
    width = data.width

    def run(batches):
        for pdf in batches:
            made = [margins(b) for b in _written_blocks(pdf, width)]
            yield pdf.assign(margin=[np.ascontiguousarray(m, np.float64).tobytes() for m in made])

    written = materialise(data.blocks.mapInPandas(run, _SHAPE), **SMALL_PARTS)
    return replace(data, written=written, blocks=written.coalesce(data.tasks))


def released(data: Packed) -> None:
    """Deletes the written table of rows that are needed no more."""
    discard(data.written)


def summed(data: Packed, size: int, add: Callable[[Block, np.ndarray], None]) -> np.ndarray:
    """Sum over all blocks of what ``add`` adds to an array of ``size`` numbers."""
    width = data.width

    def partial(batches):
        total, seen = np.zeros(size), False
        for block in blocks_of(batches, width):
            add(block, total)
            seen = True
        if seen:
            yield pd.DataFrame({"part": [total.tobytes()]})

    parts, tasks = data.blocks.mapInPandas(partial, "part binary"), data.tasks

    def add_up(batches):
        total = None
        for pdf in batches:
            for part in pdf["part"]:
                array = np.frombuffer(part, np.float64)
                total = array.copy() if total is None else total + array
        if total is not None:
            yield pd.DataFrame({"part": [total.tobytes()]})

    while tasks > DIRECT_TASKS:
        tasks = math.ceil(tasks / DIRECT_TASKS)
        parts = parts.repartition(tasks).mapInPandas(add_up, "part binary")
    out = np.zeros(size)
    for part in parts.toArrow()["part"].to_pylist():
        out += np.frombuffer(part, np.float64)
    return out


# ---------------------------------------------------------------- what a split is worth


@dataclass(frozen=True)
class Gini:
    """Less impurity is better. Sums: weight of class 0, weight of class 1, rows."""

    min_leaf: int = 1
    channels = 3
    digits = 10

    def score(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minus the impurity of both sides, as a share of the node's weight; -inf for a split that may not be."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 0.0
            for s in (left, right):
                out = out - np.nan_to_num(2 * s[0] * s[1] / (s[0] + s[1]))
            out = out / (left[0] + left[1] + right[0] + right[1])
        return np.where((left[-1] < self.min_leaf) | (right[-1] < self.min_leaf), -np.inf, np.round(out, self.digits))

    def corner(self, left, right):
        free = np.full_like(left[-1], np.inf)
        return self.score(np.stack([left[0], left[1], free]), np.stack([right[0], right[1], free]))


@dataclass(frozen=True)
class Newton:
    """Second-order gain of a split with leaf penalty. Sums: gradient of class 0, minus gradient of class 1, hessian, rows."""

    penalty: float = 1.0
    min_hessian: float = 1.0
    min_leaf: int = 1
    channels = 4
    digits = 7

    def score(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = self._gain(left, right)
        bad = (left[-1] < self.min_leaf) | (right[-1] < self.min_leaf) | (left[2] < self.min_hessian) | (right[2] < self.min_hessian)
        return np.where(bad, -np.inf, np.round(out, self.digits))

    def _gain(self, left, right):
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 0.0
            for s, sign in ((left, 1), (right, 1), (left + right, -1)):
                out = out + sign * np.nan_to_num((s[0] - s[1]) ** 2 / (s[2] + self.penalty))
        return out

    def corner(self, left, right):
        return np.round(self._gain(left, right), self.digits)


def bound(rule: Gini | Newton, left: np.ndarray, inside: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What a split inside a bin can reach at most: the best corner of the box that the left side's sums cross.

    Corners where the sums are those of one of the bin's ends count only if that end is no split itself: a
    value inside scores as much as such a corner only where the other corners do too.
    """
    best = np.full(left.shape[1:], -np.inf)
    ends = ~np.isfinite(rule.score(left, inside + right)) | ~np.isfinite(rule.score(left + inside, right))
    sums = range(rule.channels - 1)
    for corner in product((False, True), repeat=rule.channels - 1):
        part = np.zeros_like(inside)
        some = [np.zeros(best.shape, bool), np.zeros(best.shape, bool)]
        for c in sums:
            some[corner[c]] |= inside[c] > 0
            if corner[c]:
                part[c] = inside[c]
        best = np.where(ends | (some[0] & some[1]), np.maximum(best, rule.corner(left + part, right + inside - part)), best)
    return best


@dataclass
class Split:
    """Rows with x[feature] <= threshold go left; ``left`` and ``right`` are the sides' sums."""

    feature: int
    threshold: float
    left: np.ndarray
    right: np.ndarray
    score: float


#: For one block: (number of the first node, how many, node of every row or -1, sums' terms by channel) per model.
Weigh = Callable[[Block], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]


# ---------------------------------------------------------------- the search


def histograms(data: Packed, weigh: Weigh, n_nodes: int, channels: int) -> np.ndarray:
    """Sums by (channel, feature, node, bin)."""
    width = data.width
    shape = (channels, width, n_nodes, BINS)

    def add(block: Block, total: np.ndarray) -> None:
        total = total.reshape(shape)
        for first, k, node, terms in weigh(block):
            on = np.flatnonzero(node >= 0)
            if not len(on):
                continue
            every = len(on) == block.n
            nodes = (node if every else node[on]).astype(np.int64)
            parts = terms if every else terms[:, on]
            # A row has a term of one class only and counts once, so both classes are added up by one pass over a bin number with the class.
            joint = not np.logical_and(parts[0], parts[1]).any() and bool((parts[-1] == 1).all())
            value, of_class, base = (parts[0] + parts[1], (2 * nodes + (parts[1] != 0)) * BINS, nodes * BINS) if joint else (None, None, nodes * BINS)
            here = slice(first, first + k)
            for f in range(width):
                codes = block.codes[f] if every else block.codes[f, on]
                if joint:
                    at = of_class + codes
                    total[:2, f, here] += np.bincount(at, value, 2 * k * BINS).reshape(k, 2, BINS).swapaxes(0, 1)
                    total[-1, f, here] += np.bincount(at, minlength=2 * k * BINS).reshape(k, 2, BINS).sum(axis=1)
                left = range(2, channels - 1) if joint else range(channels)
                if left:
                    at = base + codes
                    for c in left:
                        total[c, f, here] += np.bincount(at, parts[c], k * BINS).reshape(k, BINS)

    return summed(data, math.prod(shape), add).reshape(shape)


def search(
    data: Packed, weigh: Weigh, n_nodes: int, rule: Gini | Newton, allowed: np.ndarray | None = None, exact: bool = True,
    sums: np.ndarray | None = None, same_rows: list | None = None,
) -> list[Split | None]:
    """The best split of every node, None where there is none.

    ``allowed`` (node, feature) says which features a node may split by. Equal scores go to the feature, then
    the value, that comes first. Without ``exact`` only the borders of the coarse bins are candidates, and
    thresholds are the borders. Otherwise a threshold lies halfway between the values next to it. ``sums`` are
    histograms made before. Nodes with the same entry in ``same_rows`` hold the same rows in every call.
    """
    sums = histograms(data, weigh, n_nodes, rule.channels) if sums is None else sums
    width = data.width
    n_edges = np.array([len(e) for e in data.edges])
    may = np.ones((n_nodes, width), bool) if allowed is None else allowed
    upto = sums.cumsum(axis=3)
    whole = upto[:, :, :, -1:]
    borders = np.arange(BINS)[None, None, :] < n_edges[:, None, None]
    scores = np.where(borders & may.T[:, :, None], rule.score(upto, whole - upto), -np.inf)
    best: list[tuple | None] = []
    flat = scores.transpose(1, 0, 2).reshape(n_nodes, -1)
    for k, place in enumerate(flat.argmax(axis=1)):
        f, b = divmod(int(place), BINS)
        edge = float(data.edges[f][b]) if flat[k, place] > -np.inf else None
        best.append((float(flat[k, place]), f, edge, upto[:, f, k, b], None) if edge is not None else None)
    if exact:
        before = upto - sums
        most = bound(rule, before, sums, whole - upto)
        least = np.array([b[0] if b else -np.inf for b in best])[None, :, None]
        # Of equal scores the first counts, so bins that come before the best border matter also at its score.
        place = np.arange(width)[:, None, None] * BINS + np.arange(BINS)[None, None, :]
        earlier = place <= flat.argmax(axis=1)[None, :, None]
        open_bins = (sums[-1] > 1) & ((most > least) | ((most == least) & earlier)) & may.T[:, :, None] & data.mixed[:, None, :]
        pending = []
        for f, k, b in zip(*np.nonzero(open_bins)):
            low, high = data.bounds(f, b)
            pending.append(_Inside(int(k), int(f), low, high, before[:, f, k, b], sums[:, f, k, b], whole[:, f, k, 0], float(most[f, k, b])))
        _refine(data, weigh, rule, pending, best)
        _halfway(data, weigh, best, same_rows)
    return [None if b is None else Split(b[1], b[2], b[3], whole[:, b[1], k, 0] - b[3], b[0]) for k, b in enumerate(best)]


@dataclass
class _Inside:
    """Rows of a node with low < x[feature] <= high, whose values might split better than the best so far."""

    node: int
    feature: int
    low: float
    high: float
    before: np.ndarray
    sums: np.ndarray
    whole: np.ndarray
    bound: float


_LOW_BITS = np.int64(2**63 - 1)


def _ordered_key(x: float) -> int:
    """An integer that orders as the numbers do."""
    i = np.array([x + 0.0], np.float64).view(np.int64)
    return int(np.where(i < 0, i ^ _LOW_BITS, i)[0])


def _number_of(key: int) -> float:
    i = np.array([key], np.int64)
    return float(np.where(i < 0, i ^ _LOW_BITS, i).view(np.float64)[0])


def _may_win(p: _Inside, best: tuple | None) -> bool:
    return p.bound > -math.inf and (best is None or (-p.bound, p.feature, p.low) < (-best[0], best[1], best[2]))


def _refine(data: Packed, weigh: Weigh, rule, pending: list[_Inside], best: list[tuple | None]) -> None:
    while True:
        pending = [p for p in pending if _may_win(p, best[p.node])]
        if not pending:
            return
        listed = [p.sums[-1] <= LISTED_ROWS for p in pending]
        edges = [None if one else _finer(p, data) for p, one in zip(pending, listed)]
        found = _looked_at(data, weigh, rule.channels, pending, edges)
        following: list[_Inside] = []
        for p, one, (values, sums) in zip(pending, listed, found):
            upto = p.before[:, None] + sums.cumsum(axis=1)
            score = rule.score(upto, p.whole[:, None] - upto)
            score[-1] = -np.inf  # the last value's split is the bin's border
            at = int(score.argmax()) if len(score) else 0
            if len(score) and score[at] > -np.inf:
                new = (float(score[at]), p.feature, float(values[at]), upto[:, at], float(values[at + 1]) if one else None)
                old = best[p.node]
                if old is None or (-new[0], new[1], new[2]) < (-old[0], old[1], old[2]):
                    best[p.node] = new
            if not one:
                before = upto - sums
                most = bound(rule, before, sums, p.whole[:, None] - upto)
                lows = [_lower_end(p, data), *values[:-1]]
                following += [
                    _Inside(p.node, p.feature, float(lows[j]), float(values[j]), before[:, j], sums[:, j], p.whole, float(most[j]))
                    for j in range(len(values))
                    if sums[-1, j] > 1 and _ordered_key(values[j]) - _ordered_key(lows[j]) > 1
                ]
        pending = following


def _lower_end(p: _Inside, data: Packed) -> float:
    return max(p.low, float(np.nextafter(data.low[p.feature], -np.inf)))


def _finer(p: _Inside, data: Packed) -> np.ndarray:
    """Borders that cut a bin evenly in the order of floating-point numbers; its upper end, often a frequent
    value, gets a part of its own."""
    low, high = _ordered_key(_lower_end(p, data)), _ordered_key(min(p.high, data.high[p.feature]))
    parts = min(BINS, high - low)
    keys = {low + (high - low) * (j + 1) // parts for j in range(parts)} | ({high - 1} if high - 1 > low else set())
    return np.array([_number_of(k) for k in sorted(keys)])


def _looked_at(data: Packed, weigh: Weigh, channels: int, pending: list[_Inside], edges: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, sums by channel and value) of each bin: its distinct values, or the borders given."""
    width, by_node = data.width, {}
    for i, p in enumerate(pending):
        by_node.setdefault(p.node, []).append((i, p.feature, p.low, p.high))

    def collect(batches):
        out: dict[int, list] = {}  # at most LISTED_ROWS rows each
        cut: dict[int, np.ndarray] = {}
        for block in blocks_of(batches, width):
            for first, k, node, terms in weigh(block):
                wanted = [j for j in range(k) if first + j in by_node]
                if not wanted:
                    continue
                order = np.argsort(node, kind="stable")
                begin = np.searchsorted(node[order], wanted)
                end = np.searchsorted(node[order], wanted, side="right")
                for j, a, b in zip(wanted, begin, end):
                    rows = order[a:b]
                    for i, f, low, high in by_node[first + j]:
                        x = block.x[f, rows]
                        at = rows[(x > low) & (x <= high)]
                        if not len(at):
                            continue
                        if edges[i] is None:
                            out.setdefault(i, []).append((block.x[f, at], terms[:, at]))
                            continue
                        place = np.searchsorted(edges[i], block.x[f, at], side="left")
                        part = np.vstack([np.bincount(place, t, len(edges[i])) for t in terms[:, at]])
                        cut[i] = cut[i] + part if i in cut else part
        results = [(i, np.arange(len(edges[i])), sums) for i, sums in cut.items()]
        for i, parts in out.items():
            values, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            terms = np.concatenate([p[1] for p in parts], axis=1)
            results.append((i, values, np.vstack([np.bincount(place, t, len(values)) for t in terms])))
        yield pd.DataFrame({"part": [pickle.dumps(results)]})

    gathered: dict[int, list] = {}
    for part in data.blocks.mapInPandas(collect, "part binary").toArrow()["part"].to_pylist():
        for i, values, sums in pickle.loads(part):
            gathered.setdefault(i, []).append((values, sums))
    out = []
    for i in range(len(pending)):
        parts = gathered.get(i, [])
        if edges[i] is not None:
            out.append((edges[i], sum((s for _, s in parts), np.zeros((channels, len(edges[i]))))))
            continue
        values, place = np.unique(np.concatenate([np.zeros(0), *[v for v, _ in parts]]), return_inverse=True)
        sums = np.zeros((channels, len(values)))
        at = 0
        for v, s in parts:
            for c in range(channels):
                np.add.at(sums[c], place[at : at + len(v)], s[c])
            at += len(v)
        out.append((values, sums))
    return out


def _halfway(data: Packed, weigh: Weigh, best: list[tuple | None], same_rows: list | None) -> None:
    """Moves thresholds from the greatest value on the left to halfway to the next value of the node's rows."""
    names = [(same_rows[k] if same_rows else None, b[1], b[2]) if b else None for k, b in enumerate(best)]
    open_nodes = {k: b for k, b in enumerate(best) if b and b[4] is None and not (same_rows and names[k] in data.known_gaps)}
    if open_nodes:
        width = data.width
        wanted = {k: (b[1], b[2]) for k, b in open_nodes.items()}

        def neighbours(batches):
            out: dict[int, tuple[float, float]] = {}
            for block in blocks_of(batches, width):
                for first, k, node, terms in weigh(block):
                    for j in range(k):
                        if first + j in wanted:
                            f, t = wanted[first + j]
                            x = block.x[f, (node == j) & (terms[-1] > 0)]
                            low, high = out.get(first + j, (-math.inf, math.inf))
                            out[first + j] = (max(low, x[x <= t].max(initial=-math.inf)), min(high, x[x > t].min(initial=math.inf)))
            yield pd.DataFrame({"part": [pickle.dumps(out)]})

        ends = {k: (-math.inf, math.inf) for k in wanted}
        for part in data.blocks.mapInPandas(neighbours, "part binary").toArrow()["part"].to_pylist():
            for k, (low, high) in pickle.loads(part).items():
                ends[k] = (max(ends[k][0], low), min(ends[k][1], high))
        for k, pair in ends.items():
            if same_rows:
                data.known_gaps[names[k]] = pair
            best[k] = (*best[k][:2], pair[0], best[k][3], pair[1])
    for k, b in enumerate(best):
        if b:
            low, high = data.known_gaps[names[k]] if same_rows and b[4] is None else (b[2], b[4])
            middle = low + (high - low) / 2
            best[k] = (b[0], b[1], middle if low <= middle < high else low, b[3], high)
