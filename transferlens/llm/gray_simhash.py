"""SimHash near-duplicates through a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transferlens.llm.common import cuts, linked, part_of
from transferlens.session import discard, materialise

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Neighbouring bytes of a sketch that make a candidate.
_BAND = 4
#: Odd numbers, one for each of the orders in which a sketch takes the least shingle.
_ORDERS = np.array([int.from_bytes(xxhash.xxh64_digest(str(i), 7), "big") | 1 for i in range(64)], np.uint64)


def _digests(text: str | None, words_per_shingle: int, seed: int = 42) -> list[bytes]:
    """XXH64 values of the text's shingles in order, 8 bytes each, in blocks; no words: no block."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    k, joined = min(words_per_shingle, len(words)), b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, stops = (ends - size).tolist(), ends.tolist()
    digest, n, m = xxhash.xxh64_digest, len(words) - k + 1, 1 << 18
    return [b"".join([digest(joined[a:b], seed) for a, b in zip(starts[i : min(i + m, n)], stops[i + k - 1 : i + m + k - 1])]) for i in range(0, n, m)]


def _folded(digests: list[bytes]) -> int:
    total, n = np.zeros(64, np.int64), sum(map(len, digests)) // 8
    for raw in digests:
        lanes = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, 8).T)
        if lanes.shape[1] < 512:
            total += np.unpackbits(lanes[::-1], axis=0, bitorder="little").sum(axis=1, dtype=np.int64)
        else:
            total += np.concatenate([np.bincount(lane, minlength=256) @ _BITS for lane in lanes[::-1]])
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _distinct(digests: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(digests), np.uint64))


def _set_key(shingles: np.ndarray) -> int:
    """64 bits that name a set of shingles, as a signed number."""
    return int.from_bytes(xxhash.xxh64_digest(shingles.tobytes()), "big", signed=True)


def _sketch(shingles: np.ndarray) -> bytes:
    """64 bytes, each a byte of the least shingle in an order of its own; sets of similarity J share about 64 J of them."""
    least = np.full(64, _ALL)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * _ORDERS).min(axis=0))
    return (least >> np.uint64(16)).astype(np.uint8).tobytes()


def simhash(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """64-bit fingerprint: a bit is set if over half of the shingles' XXH64 values have it; no words: 0."""
    return _folded(_digests(text, words_per_shingle, seed))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words_per_shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(id, of(F.col(text).cast("string")).alias("fp"))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Levels over codes in Gray order: each node keeps which bits all its members have (``ones``) and which any has.

    Children of a node stand in one row, the last one repeated where a node has fewer.
    """

    def __init__(self, codes: np.ndarray, height: int, fan: int = 8):
        self.count, self.sizes = len(codes), [len(codes)]
        self.ones, self.some = [], []
        ones = some = codes
        for _ in range(height):
            fill = -len(ones) % fan
            ones, some = (np.append(x, np.full(fill, x[-1])).reshape(-1, fan) for x in (ones, some))
            self.ones.append(ones)
            self.some.append(some)
            ones, some = np.bitwise_and.reduce(ones, axis=1), np.bitwise_or.reduce(some, axis=1)
            self.sizes.append(len(ones))


class _Groups:
    """Union of numbered members with vectorised joining."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def flatten(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.flatten()
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])


def link_codes(left: np.ndarray, right: np.ndarray | None, distance: int, block: int = 1 << 14) -> np.ndarray:
    """Pairs (code, smallest code of its group) that connect all codes within ``distance``.

    ``left`` and ``right`` are distinct codes in Gray order; with ``right`` None the codes are joined
    with themselves, else only across. Both indexes are walked together: a pair of nodes is pruned when
    the bits both share already differ in more than ``distance`` places, joined at once when no member
    can be farther, and skipped when all members are in one group; so a large group is not paired out.
    """
    own, fan = right is None, 8
    codes = left if own else np.concatenate((left, right))
    if not len(left) or (not own and not len(right)):
        return np.zeros((0, 2), np.uint64)
    height = 1
    while fan**height < max(len(left), 0 if own else len(right)):
        height += 1
    a = GrayIndex(left, height, fan)
    b = a if own else GrayIndex(right, height, fan)
    shift = 0 if own else len(left)
    groups = _Groups(len(codes))
    if own:  # neighbours in Gray order first: most groups join here
        for step in range(1, min(4, len(codes))):
            near = np.flatnonzero(np.bitwise_count(codes[step:] ^ codes[:-step]) <= distance)
            groups.join(near, near + step)
    low: dict[bool, list[np.ndarray]] = {}
    high: dict[bool, list[np.ndarray]] = {}

    def refresh() -> None:
        """Least and greatest group of each node's members."""
        root = groups.flatten()
        for other, index, start in ((False, a, 0), (True, b, shift)):
            low[other], high[other] = [root[start : start + index.count]], [root[start : start + index.count]]
            for size in index.sizes[1:]:
                at = np.arange(size) * fan
                low[other].append(np.minimum.reduceat(low[other][-1], at))
                high[other].append(np.maximum.reduceat(high[other][-1], at))

    def members(index: GrayIndex, level: int, node: int, start: int) -> np.ndarray:
        width = fan**level
        return start + np.arange(node * width, min((node + 1) * width, index.count))

    refresh()
    stack, stale = [(height, np.zeros(1, np.int64), np.zeros(1, np.int64))], 0
    while stack:
        level, i, j = stack.pop()
        if len(i) > block:
            stack += [(level, i[block:], j[block:]), (level, i[:block], j[:block])]
            continue
        same = (low[False][level][i] == high[False][level][i]) & (low[True][level][j] == high[True][level][j]) & (low[False][level][i] == low[True][level][j])
        i, j = i[~same], j[~same]
        level -= 1
        ones_a, ones_b = a.ones[level][i][:, :, None], b.ones[level][j][:, None, :]
        differ = ones_a ^ ones_b
        if level:
            both = ~(ones_a ^ a.some[level][i][:, :, None]) & ~(ones_b ^ b.some[level][j][:, None, :])
            differ &= both
        least = np.bitwise_count(differ)
        pair, x, y = np.nonzero(least <= distance)
        ci, cj = i[pair] * fan + x, j[pair] * fan + y
        fits = (ci < a.sizes[level]) & (cj < b.sizes[level])
        if own:
            fits &= (ci <= cj) if level else (ci < cj)
        ci, cj = ci[fits], cj[fits]
        if not level:
            groups.join(ci, cj + shift)
            stale += len(ci)
        elif len(ci):
            pair, x, y = pair[fits], x[fits], y[fits]
            sure = least[pair, x, y] + np.bitwise_count(~both[pair, x, y]) <= distance
            for n, m in zip(ci[sure].tolist(), cj[sure].tolist()):
                group = np.concatenate((members(a, level, n, 0), members(b, level, m, shift)))
                groups.join(group[1:], np.full(len(group) - 1, group[0]))
                stale += len(group)
            stack.append((level, ci[~sure], cj[~sure]))
        if stale > 4096:
            refresh()
            stale = 0
    root = groups.flatten()
    linked_to = np.flatnonzero(root != np.arange(len(codes)))
    return np.stack((codes[linked_to], codes[root[linked_to]]), axis=1)


def near_pairs(left: np.ndarray, right: np.ndarray | None, distance: int, block: int = 1 << 14, ratio: float = 0.0) -> Iterator[np.ndarray]:
    """All pairs within ``distance`` whose labels differ, as blocks of rows (name, name).

    ``left`` and ``right`` have rows of codes in Gray order (some may be equal), names and labels; with
    ``right`` None ``left`` is paired with itself. Pairs of nodes are pruned by their shared bits, or
    when all members have one label. With a ``ratio`` a fourth row has sizes, of which the smaller must be
    at least that share of the greater.
    """
    own, fan = right is None, 8
    right = left if own else right
    if not left.shape[1] or not right.shape[1]:
        return
    height = 1
    while fan**height < max(left.shape[1], right.shape[1]):
        height += 1
    a = GrayIndex(left[0], height, fan)
    b = a if own else GrayIndex(right[0], height, fan)
    bounds = []
    for index, labels in ((a, left[2]), (b, right[2])):
        low, high = [labels], [labels]
        for size in index.sizes[1:]:
            at = np.arange(size) * fan
            low.append(np.minimum.reduceat(low[-1], at))
            high.append(np.maximum.reduceat(high[-1], at))
        bounds.append((low, high))
    (low_a, high_a), (low_b, high_b) = bounds
    stack = [(height, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > block:
            stack += [(level, i[block:], j[block:]), (level, i[:block], j[:block])]
            continue
        mixed = (low_a[level][i] != high_a[level][i]) | (low_b[level][j] != high_b[level][j]) | (low_a[level][i] != low_b[level][j])
        i, j = i[mixed], j[mixed]
        level -= 1
        ones_a, ones_b = a.ones[level][i][:, :, None], b.ones[level][j][:, None, :]
        differ = ones_a ^ ones_b
        if level:
            differ &= ~(ones_a ^ a.some[level][i][:, :, None]) & ~(ones_b ^ b.some[level][j][:, None, :])
        pair, x, y = np.nonzero(np.bitwise_count(differ) <= distance)
        i, j = i[pair] * fan + x, j[pair] * fan + y
        fits = (i < a.sizes[level]) & (j < b.sizes[level])
        if own:
            fits &= (i <= j) if level else (i < j)
        if not level:
            i, j = i[fits], j[fits]
            fits = left[2][i] != right[2][j]
            if ratio:
                fits &= np.minimum(left[3][i], right[3][j]) >= ratio * np.maximum(left[3][i], right[3][j])
            yield np.stack((left[1][i[fits]], right[1][j[fits]]), axis=1)
        elif fits.any():
            stack.append((level, i[fits], j[fits]))


def _shard_pairs(nodes: DataFrame, n: int, distance: int, shard_size: int, ratio: float = 0.0) -> DataFrame:
    """(a, b, left, right): shards of neighbouring Gray ranks whose members can be within ``distance``, one row a partition.

    ``left`` and ``right`` hold the columns of ``nodes`` (longs, fp first), one after another, in Gray order. With a
    ``ratio`` the last column has sizes, of which the smaller must be at least that share of the greater: shards then
    hold neighbouring sizes (eighths of a power of two, in Gray order each) and meet only those whose sizes allow a
    link. As each meets few others they can be a quarter as large.
    """
    spark, columns = nodes.sparkSession, nodes.columns
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    size = F.col(columns[-1]) if ratio else F.lit(1).cast("long")
    if ratio:
        step = F.floor(8 * F.log2(F.greatest(size, F.lit(1)))).cast("long")
        rank, least, factor = F.shiftleft(step, 54) + F.shiftrightunsigned(rank, 10), ceil(shard_size / 4), 16
    else:
        rank, least, factor = rank.bitwiseXOR(F.lit(-(1 << 63)).cast("long")), shard_size, 64
    ranked = materialise(nodes.withColumn("rank", rank).withColumn("span", size))
    bounds = cuts(ranked, "rank", ceil(n / max(least, factor * sqrt(max(n, 1)))))

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().view(np.uint64)
        order = np.argsort(gray_rank(fp))
        ones, some = np.bitwise_and.reduce(fp), np.bitwise_or.reduce(fp)
        raw = b"".join(rows[c].to_numpy()[order].tobytes() for c in columns)
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "ones": np.array([ones]).view(np.int64), "some": np.array([some]).view(np.int64), "low": [rows["span"].min()], "high": [rows["span"].max()], "codes": [raw]})

    dealt = ranked.select(*columns, "span", part_of(F.col("rank"), bounds).alias("shard"))
    packed = materialise(dealt.groupBy("shard").applyInPandas(gather, "shard int, ones long, some long, low long, high long, codes binary"))
    tops = packed.select("shard", "ones", "some", "low", "high").toPandas()  # one row a shard
    ones, some = tops["ones"].to_numpy().view(np.uint64), tops["some"].to_numpy().view(np.uint64)
    low, high = tops["low"].to_numpy(), tops["high"].to_numpy()
    pairs = []
    for k in range(len(tops)):
        both = ~(ones[k] ^ some[k]) & ~(ones[k:] ^ some[k:])
        fits = (high[k:] >= ratio * low[k]) & (high[k] >= ratio * low[k:])
        near = k + np.flatnonzero(fits & (np.bitwise_count((ones[k] ^ ones[k:]) & both) <= distance))
        pairs += [(int(tops["shard"][k]), int(tops["shard"][m])) for m in near]
    todo = spark.createDataFrame(pairs, "a int, b int").repartition(max(1, len(pairs)), "a", "b")
    left, right = packed.select(F.col("shard").alias("a"), F.col("codes").alias("left")), packed.select(F.col("shard").alias("b"), F.col("codes").alias("right"))
    return todo.join(left, "a").join(right, "b").repartition(max(1, len(pairs)), "a", "b")


def components(prints: DataFrame, id: str = "doc_id", distance: int = 4, shard_size: int = 1 << 15) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable over fingerprints within ``distance``.

    Distinct fingerprints are cut into shards of neighbouring Gray ranks. A shard's summary (the bits
    all its members share) is the upper node of the index: pairs of shards whose shared bits differ too
    much are never compared. Each remaining pair is one task that returns at most one link per code.
    Shards hold about max(shard_size, 64 * sqrt(n)) codes, so their pairs grow slower than n. Equal
    texts are one code from the start. A null id gets the smallest id of its group that is not null.
    """
    prints = materialise(prints.select(id, "fp"))
    codes = materialise(prints.groupBy("fp").agg(F.min(id).alias("least")))
    n = codes.count()
    work = _shard_pairs(codes.select("fp"), n, distance, shard_size)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, x, y in zip(batch["a"], batch["b"], batch["left"], batch["right"]):
                edges = link_codes(np.frombuffer(x, np.uint64), None if a == b else np.frombuffer(y, np.uint64), distance)
                yield pd.DataFrame(edges.view(np.int64), columns=["a", "b"])

    edges = work.mapInPandas(link, "a long, b long").distinct()
    owner = codes.where("least IS NOT NULL").select("fp", "least")
    edges = edges.join(owner.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(owner.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    roots = linked(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    of = codes.join(roots, codes["least"] == roots["node"], "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    return prints.join(of, "fp").select(id, "fp", "component_id")


def _banded_pairs(nodes: DataFrame, distance: int, similarity: float, shared: float) -> DataFrame:
    """(a, b): pairs over ``distance`` bits apart, of different labels, that agree in four neighbouring bytes of their sketches
    (from a multiple of four on) and in ``shared`` bytes in all.

    ``nodes`` has key, fp, label, size and sketch. Only groups of equal bytes with more than one label move their
    sketches. A pair comes from the first bytes that it agrees in.
    """
    part = F.conv(F.hex(F.expr(f"substring(sketch, {_BAND} * band + 1, {_BAND})")), 16, 10).cast("long")
    bands = nodes.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(64 // _BAND - 1)))).withColumn("group", F.shiftleft(F.col("band").cast("long"), 8 * _BAND) + part)
    mixed = bands.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("group")

    def listed(rows: pd.DataFrame) -> pd.DataFrame:
        key, label, size, band = (rows[c].to_numpy() for c in ("key", "label", "size", "band"))
        fp, sketch = rows["fp"].to_numpy().view(np.uint64), np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, 64)
        found, step = [np.zeros((0, 2), np.int64)], max(1, (1 << 20) // len(key))
        for at in range(0, len(key), step):
            here = slice(at, at + step)
            fits = (label[here, None] != label) & (np.arange(len(key))[here, None] < np.arange(len(key)))
            fits &= np.minimum(size[here, None], size) >= similarity * np.maximum(size[here, None], size)
            fits &= np.bitwise_count(fp[here, None] ^ fp) > distance
            x, y = np.nonzero(fits)
            for k in range(0, len(x), 1 << 16):
                i, j = x[k : k + (1 << 16)] + at, y[k : k + (1 << 16)]
                same = sketch[i] == sketch[j]
                whole = same[:, : 64 // _BAND * _BAND].reshape(len(i), -1, _BAND).all(axis=2)
                first = (same.sum(axis=1) >= shared) & (whole.argmax(axis=1) == band[0])
                found.append(np.stack((key[i[first]], key[j[first]]), axis=1))
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    return bands.join(mixed, "group").groupBy("group").applyInPandas(listed, "a long, b long")


def similar_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", words_per_shingle: int = 5, similarity: float = 0.8, distance: int = 14, tight: int = 6, shard_size: int = 1 << 15) -> DataFrame:
    """(id, component_id): the smallest id reachable over texts whose sets of shingles have Jaccard ``similarity`` or more.

    Candidates are texts whose sets have sizes that allow the similarity and whose fingerprints differ in ``distance``
    bits or fewer, or whose sketches of 64 bytes agree in one of 16 runs of 4 bytes and in 64 * (similarity - 0.2) in all:
    at 0.8, with independent orders, the latter misses 34 in 100,000. Of all, pairs whose sketches of 64 bytes share fewer than 64 * (similarity
    - 0.3) are left out: with independent orders a pair at 0.8 falls there once in 50 million. Each link is confirmed on
    the exact sets, so only likely links move their sets. Equal sets are one node. Groups at ``tight`` bits
    are tried first, each member with the least one, so that large groups of near copies are joined before
    all remaining candidates between different groups are listed. A null id joins no texts and has no row.
    Rows of one id are nodes of their own with that id. Written steps are deleted, but for small ones.
    """
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp, key, size, sketch = [], [], [], []
            for digests in (_digests(t, words_per_shingle) for t in batch["t"]):
                shingles = _distinct(digests)
                fp.append(_folded(digests))
                key.append(_set_key(shingles))
                size.append(len(shingles))
                sketch.append(_sketch(shingles))
            out = {id: batch[id], "fp": np.array(fp, np.uint64).view(np.int64), "key": np.array(key, np.int64)}
            yield pd.DataFrame(out | {"size": np.array(size, np.int64), "sketch": sketch})

    kind = docs.schema[id].dataType.simpleString()
    texts = docs.where(F.col(id).isNotNull()).select(id, F.col(text).cast("string").alias("t"))
    rows = materialise(texts.mapInPandas(keys, f"{id} {kind}, fp long, key long, size long, sketch binary"))
    nodes = materialise(rows.groupBy("key").agg(F.min("fp").alias("fp"), F.min(id).alias("least"), F.min("size").alias("size"), F.min("sketch").alias("sketch")))
    n = nodes.count()

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [_distinct(_digests(t, words_per_shingle)) for t in batch["t"]]
            out = pd.DataFrame({"key": np.array([_set_key(s) for s in sets], np.int64), "shingles": [s.tobytes() for s in sets]})
            yield out[out["key"] == batch["wanted"].to_numpy()]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(common > 0 and common / (len(x) + len(y) - common) >= similarity)
            yield batch.loc[keep, ["a", "b"]]

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            u, v = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, 64) for c in ("u", "v"))
            yield batch.loc[(u == v).sum(axis=1) >= 64 * (similarity - 0.3), ["a", "b"]]

    def confirmed(listed: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of node keys whose sets are similar enough."""
        listed = materialise(listed)
        u, v = nodes.select(F.col("key").alias("a"), F.col("sketch").alias("u")), nodes.select(F.col("key").alias("b"), F.col("sketch").alias("v"))
        pairs = materialise(listed.join(u, "a").join(v, "b").mapInPandas(screen, "a long, b long"))
        wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        wanted = wanted.join(nodes, "key").select(F.col("key").alias("wanted"), F.col("least").alias(id))
        sets = texts.join(wanted, id).select("wanted", "t").mapInPandas(shingles, "key long, shingles binary")
        sets = materialise(sets.dropDuplicates(["key"]))
        x, y = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
        found = materialise(pairs.join(x, "a").join(y, "b").mapInPandas(measure, "a long, b long"))
        discard(listed, pairs, sets)
        return found

    stars = components(nodes.select("key", "fp"), "key", tight).where("key <> component_id")
    sure = confirmed(stars.select(F.col("key").alias("a"), F.col("component_id").alias("b")))
    roots = linked(sure)
    labelled = nodes.join(roots, nodes["key"] == roots["node"], "left").select("fp", "key", F.coalesce("root", "key").alias("label"), "size", "sketch")

    def list_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, x, y in zip(batch["a"], batch["b"], batch["left"], batch["right"]):
                x, y = (np.frombuffer(raw, np.uint64).reshape(4, -1) for raw in (x, y))
                for found in filter(len, near_pairs(x, None if a == b else y, distance, ratio=similarity)):
                    yield pd.DataFrame(found.view(np.int64), columns=["a", "b"])

    near = _shard_pairs(labelled.drop("sketch"), n, distance, shard_size, similarity).mapInPandas(list_pairs, "a long, b long")
    rest = confirmed(near.union(_banded_pairs(labelled, distance, similarity, 64 * (similarity - 0.2))))
    owner = nodes.select("key", "least")
    edges = sure.union(rest).join(owner.select(F.col("key").alias("a"), F.col("least").alias("x")), "a").join(owner.select(F.col("key").alias("b"), F.col("least").alias("y")), "b")
    roots = linked(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    of = nodes.join(roots, nodes["least"] == roots["node"], "left").select("key", F.coalesce("root", "least").alias("component_id"))
    return rows.join(of, "key").select(id, "component_id")
