"""Repeated byte strings over a collection, found by column-wise construction of its suffix order."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transferlens.llm.common import bucketed, shards
from transferlens.session import materialise

#: Length of the content anchors that align pieces; any value below the width gives the same result.
ANCHOR = 16
_FULL = np.iinfo(np.int64).max
#: Stands for a null id: a null among numbers would turn a pandas column into floats.
_NO_ID = -(2**63)
_digest = xxhash.xxh3_128_digest


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; ``_unpacked`` takes their types in the same order."""
    head = np.array([a.nbytes for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k bytes, built by doubling."""
    h, size, power = raw.astype(np.uint64), 1, np.uint64(0x9E3779B97F4A7C15)
    whole, length, scale = None, 0, None
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if whole is None:
                    whole, length = h, size
                else:
                    n = len(whole) - size
                    whole = whole[:n] * power + h[length : length + n] if n > 0 else whole[:0]
                    length += size
            if 2 * size > k:
                break
            n = len(h) - size
            h = h[:n] * power + h[size:] if n > 0 else h[:0]
            power, size = power * power, 2 * size
    return _mix(whole)


def anchors(raw: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts laid end to end: every ``width`` bytes of a text hold the
    one with the least hash, at the same place in equal strings."""
    k = min(ANCHOR, width)
    span = width - k + 1
    if len(raw) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _hashes(raw, k)
    least = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    ends = np.append(starts[1:], len(raw))
    inside = np.zeros(len(raw) + 1, np.int32)  # windows that begin in a text and end in it
    whole = ends - starts >= width
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - width + 1, -1)
    places = (least[np.cumsum(inside[: len(least)]) > 0] & np.uint64(0xFFFFFF)).astype(np.int64)
    places = places[np.append(True, places[1:] != places[:-1])] if len(places) else places
    return places, h[places]


def _segments(texts: list[bytes], width: int, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``size`` bytes: (number of the first, bytes, starts). Longer texts go in
    overlapping parts, so that places fit the anchors' 24 bits; parts share width - 1 bytes."""
    first, held, total = 0, [], 0

    def out():
        return first, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])[:-1]

    for i, t in enumerate(texts):
        held.append(t)
        total += len(t)
        if total >= size:
            yield out()
            first, held, total = i + 1, [], 0
    if held:
        yield out()


def _block_anchors(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, place in it, hash) of all anchors, in order."""
    for first, raw, starts in _segments(texts, width):
        if len(raw) < 1 << 24:
            places, h = anchors(raw, starts, width)
            text = np.searchsorted(starts, places, side="right") - 1
            yield first + text, places - starts[text], h
            continue
        for n, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(raw)))):
            seen = -1
            for c in range(a, max(b - width + 1, a + 1), 1 << 23):
                places, h = anchors(raw[c : min(b, c + (1 << 23) + width - 1)], np.zeros(1, np.int64), width)
                new = places + c - a > seen
                places, h = places[new] + c - a, h[new]
                if len(places):
                    seen = int(places[-1])
                yield np.full(len(places), first + n), places, h


def later_windows(pieces: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Bit c of the result: the ``width`` bytes of a piece from column c on also stand, at the same
    column, in a piece of a smaller doc. Columns outside low..high of a piece are padding.

    The collection is built column by column from the right. Each round inserts one symbol per piece
    in front of its suffix: a stable sort by the symbols (the transform of the round before, read in
    suffix order) gives the new order, and the common prefix of two neighbours grows by one over the
    least common prefix between their old places. Columns are laid out in a file and read one after
    another; only the order, the common prefixes and one column are in memory.
    """
    n, columns = pieces.shape
    found = np.zeros(n, np.uint64)
    with tempfile.TemporaryFile() as file:
        for c in range(columns - 1, -1, -1):
            file.write(np.ascontiguousarray(pieces[:, c]).tobytes())
        file.seek(0)
        order, lcp = np.arange(n), np.zeros(n, np.uint8)
        for c in range(columns - 1, -1, -1):
            column = np.frombuffer(file.read(n), np.uint8)
            symbols = column[order]
            places = np.argsort(symbols, kind="stable")
            bounds = np.append(np.flatnonzero(np.append(True, np.diff(symbols[places]) != 0)), n)
            new = np.zeros(n, np.uint8)
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a > 1:
                    p = places[a:b]
                    new[a + 1 : b] = np.minimum.reduceat(lcp[: p[-1] + 1], p[:-1] + 1)
                    new[a + 1 : b] += new[a + 1 : b] < 255
            order, lcp = order[places], new
            if c <= columns - width:
                start = np.flatnonzero(lcp < width)
                size = np.diff(np.append(start, n))
                member = np.repeat(size > 1, size)  # suffixes whose neighbours share the window
                if not member.any():
                    continue
                at, sizes = order[member], size[size > 1]
                valid = (low[at] <= c) & (c <= high[at])
                docs = np.where(valid, doc[at], _FULL)
                least = np.repeat(np.minimum.reduceat(docs, np.cumsum(sizes) - sizes), sizes)
                found[at[valid & (docs > least)]] |= np.uint64(1 << c)
    return found


def _texts(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["_id", "_raw"], kind="stable", ignore_index=True)


def remove_repeats(docs: DataFrame, finish: Callable[[DataFrame], DataFrame], width: int = 50, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Removes each byte covered by ``width`` bytes that also start in a document with a smaller id.

    ``finish`` gets rows (id, kept columns, kept binary, n_bytes, n_removed, n_spans) and its result is
    written before the intermediate tables go. Texts are UTF-8 bytes; null counts as empty; a null id
    counts as smaller than any other; rows of one id do not remove from each other.

    1. Documents are laid out once by blocks (a hash of the id), so later steps shuffle no text.
    2. Every window of ``width`` bytes holds an anchor chosen by content. Blocks send each distinct
       anchor's hash (5 bytes) to parts by hash, which send back one bit: in two documents or not.
    3. Pieces (all windows around an anchor) of repeated anchors go to the part of their hash, and
       ``later_windows`` orders each part's collection column by column. Of equal pieces a block sends
       those of its smallest document and marks the others itself, so a passage that a third of all
       documents share adds one piece per block, however many copies there are.
    4. Marks return to the blocks, which cut the bytes.
    """
    spark = docs.sparkSession
    blocks = shards(spark)
    if width > 63 + ANCHOR:
        raise ValueError("the width must be at most 79")
    left = width - min(ANCHOR, width)
    columns = left + width
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(
        F.pmod(F.xxhash64(id), F.lit(blocks)).cast("int").alias("_block"), F.coalesce(F.col(id).cast("long"), F.lit(_NO_ID)).alias("_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_raw"), *[F.col(k).alias(f"_keep_{i}") for i, k in enumerate(keep)],
    )

    def own_hashes(rows: pd.DataFrame) -> tuple:
        """A block's texts and anchors, dealt by part: (ids, texts, number, place, hash, order, bounds)."""
        rows = _texts(rows)
        ids, texts = rows["_id"].to_numpy("int64"), rows["_raw"].tolist()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)), *_block_anchors(texts, width)]
        number, place, h = (np.concatenate([f[i] for f in found]) for i in range(3))
        part = ((h >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return ids, texts, number, place, h & np.uint64(2**40 - 1), order, np.searchsorted(part[order], np.arange(blocks + 1))

    def hashes(rows: pd.DataFrame) -> pd.DataFrame:
        block = rows["_block"].iloc[0]
        ids, _, number, _, h, order, bounds = own_hashes(rows)
        out = []
        for p in range(blocks):
            at = order[bounds[p] : bounds[p + 1]]
            if len(at):
                at = at[np.argsort(h[at], kind="stable")]
                start = np.flatnonzero(np.append(True, np.diff(h[at].view(np.int64)) != 0))
                doc = ids[number[at]]
                several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
                low = np.ascontiguousarray(h[at[start]].view(np.uint8).reshape(-1, 8)[:, :5])
                out.append((p, block, _packed(low, np.packbits(several))))
        return pd.DataFrame(out, columns=["part", "block", "blob"])

    def repeated(rows: pd.DataFrame) -> pd.DataFrame:
        # one id is in one block only, so a hash from two blocks is in two documents
        blobs = [_unpacked(b, "u1", "u1") for b in rows["blob"]]
        sizes = [len(x) // 5 for x, _ in blobs]
        h = np.zeros((sum(sizes), 8), np.uint8)
        h[:, :5] = np.concatenate([x.reshape(-1, 5) for x, _ in blobs])
        h = h.view(np.uint64).ravel()
        several = np.concatenate([np.unpackbits(s, count=n) for (_, s), n in zip(blobs, sizes)]).astype(bool)
        order = np.argsort(h, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(h[order].view(np.int64)) != 0))
        size = np.diff(np.append(start, len(h)))
        flag = np.zeros(len(h), bool)
        flag[order] = np.repeat((size > 1) | np.logical_or.reduceat(several[order], start), size)
        bits = [np.packbits(f).tobytes() for f in np.split(flag, np.cumsum(sizes)[:-1])]
        return pd.DataFrame({"part": rows["part"], "block": rows["block"], "blob": bits})

    def cut_pieces(rows: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(flags):
            block = rows["_block"].iloc[0]
            ids, texts, number, place, h, order, bounds = own_hashes(rows)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            raw = np.frombuffer(bytes(columns) + b"".join(texts) + bytes(columns), np.uint8)
            start = np.cumsum(size) - size + columns
            for p, bits in zip(flags["part"], flags["blob"]):
                at = order[bounds[p] : bounds[p + 1]]
                distinct, inverse = np.unique(h[at], return_inverse=True)
                at = at[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(distinct)).astype(bool)[inverse]]
                if not len(at):
                    continue
                n, x = number[at], place[at] - left
                low, high = np.maximum(-x, 0), np.minimum(size[n] - width - x, columns - width)
                pieces = np.column_stack((raw[(start[n] + x)[:, None] + np.arange(columns)], low.astype(np.uint8), high.astype(np.uint8)))
                flat, step = pieces.tobytes(), columns + 2
                key = np.frombuffer(b"".join([_digest(flat[i : i + step]) for i in range(0, len(flat), step)]), np.uint64).reshape(-1, 2)
                doc = ids[n]
                by_key = np.lexsort((doc, key[:, 0], key[:, 1]))
                first = np.append(True, (np.diff(key[by_key].view(np.int64), axis=0) != 0).any(axis=1))
                least = np.repeat(doc[by_key[first]], np.diff(np.append(np.flatnonzero(first), len(at))))
                again, sent = by_key[doc[by_key] > least], by_key[doc[by_key] == least]
                blob = _packed(pieces[sent, :columns], doc[sent], n[sent].astype(np.int32), x[sent], low[sent].astype(np.uint8), high[sent].astype(np.int8))
                out.append((int(p), 0, block, blob))
                if len(again):  # the same piece in a smaller document of the block: all its windows are later ones
                    windows = np.maximum(high[again] - low[again] + 1, 0).astype(np.uint64)
                    every = ((np.uint64(1) << windows) - np.uint64(1)) << low[again].astype(np.uint64)
                    out.append((int(p), 1, block, _packed(n[again].astype(np.int32), x[again], every)))
        return pd.DataFrame(out, columns=["part", "done", "block", "blob"])

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["done"].iloc[0]:
            return rows[["block", "blob"]]
        blobs = [_unpacked(b, "u1", "i8", "i4", "i8", "u1", "i1") for b in rows["blob"]]
        pieces = np.concatenate([b[0].reshape(-1, columns) for b in blobs])
        doc, number, place, low, high = (np.concatenate([b[i] for b in blobs]) for i in range(1, 6))
        block = np.repeat(rows["block"].to_numpy(), [len(b[1]) for b in blobs])
        del blobs
        found = later_windows(pieces, low, high, doc, width)
        marked = np.flatnonzero(found)
        out = []
        for b in np.unique(block[marked]):
            at = marked[block[marked] == b]
            out.append((int(b), _packed(number[at], place[at], found[at])))
        return pd.DataFrame(out, columns=["block", "blob"])

    names = ["_id", "_kept", "n_bytes", "n_removed", "n_spans", *[f"_keep_{i}" for i in range(len(keep))]]

    def cut(rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        rows = _texts(rows)
        texts = rows["_raw"].tolist()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(size) - size
        change = np.zeros(int(size.sum()) + 1, np.int32)
        for blob in marks["blob"]:
            number, place, bits = _unpacked(blob, "i4", "i8", "u8")
            for c in range(columns - width + 1):
                at = (bits >> np.uint64(c)) & np.uint64(1) > 0
                begin = start[number[at]] + place[at] + c
                np.add.at(change, begin, 1)
                np.add.at(change, begin + width, -1)
        gone = np.cumsum(change)[:-1] > 0
        kept, removed, spans = [], [], []
        for t, a, n in zip(texts, start, size):
            g = gone[a : a + n]
            r = int(g.sum())
            removed.append(r)
            spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if r else 0)
            kept.append(np.frombuffer(t, np.uint8)[~g].tobytes() if r else t)
        out = rows.drop(columns=["_raw", "_block"])
        return out.assign(_kept=kept, n_bytes=size, n_removed=removed, n_spans=spans)[names]

    with bucketed(rows, "_block", blocks) as laid:
        by_block = laid.groupBy("_block")
        told = by_block.applyInPandas(hashes, "part int, block int, blob binary")
        flags = told.groupBy("part").applyInPandas(repeated, "part int, block int, blob binary")
        pieces = by_block.cogroup(flags.groupBy("block")).applyInPandas(cut_pieces, "part int, done int, block int, blob binary")
        marks = pieces.groupBy("part", "done").applyInPandas(compare, "block int, blob binary")
        fields = {f"_keep_{i}": docs.schema[k].dataType.simpleString() for i, k in enumerate(keep)}
        shape = "_id long, _kept binary, n_bytes long, n_removed long, n_spans long" + "".join(f", {n} {t}" for n, t in fields.items())
        result = by_block.cogroup(marks.groupBy("block")).applyInPandas(cut, shape)
        result = result.select(F.when(F.col("_id") != _NO_ID, F.col("_id")).cast(kind).alias(id), *[F.col(f"_keep_{i}").alias(k) for i, k in enumerate(keep)], F.col("_kept").alias("kept"), "n_bytes", "n_removed", "n_spans")
        return materialise(finish(result))
