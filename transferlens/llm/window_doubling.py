"""Repeated word windows, found level by level: windows that repeat at one length are extended to twice that length."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transferlens.llm.common import bucketed, shards
from transferlens.session import discard, materialise

#: Bytes of text that are hashed together; longer words than the second are hashed one by one.
_CHUNK, _LONG_WORD = 1 << 18, 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLES = np.random.default_rng(20_240_601).integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, first 64-bit hash, second one) of the words of a text, from running sums over its bytes.

    The running sum weights byte i with base^i; what it gains over a word, times base^-start, is the word's
    polynomial hash. Such hashes are weak for long words of a special form, so those get another one.
    """
    out = []
    at = 0
    while at < len(raw):
        end = min(at + _CHUNK, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:  # words are not cut
            end += 1
        text = np.frombuffer(raw, np.uint8, end - at, at)
        inside = np.append(~_SPACE[text], False)
        edges = np.flatnonzero(inside != np.append(False, inside[:-1]))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            hashes, size = [], 1 << len(text).bit_length()
            for table, base in zip(_TABLES, _BASES):
                with np.errstate(over="ignore"):
                    sums = np.append(np.uint64(0), np.cumsum(table[text] * _powers(base, size)[: len(text)], dtype=np.uint64))
                    h = (sums[ends] - sums[starts]) * _powers(pow(base, -1, 2**64), size)[starts]
                hashes.append(_joined(h, (ends - starts).astype(np.uint64)))
            for i in np.flatnonzero(ends - starts > _LONG_WORD):
                digest = xxhash.xxh3_128_digest(raw[at + int(starts[i]) : at + int(ends[i])])
                hashes[0][i], hashes[1][i] = np.frombuffer(digest, np.uint64)
            out.append((starts + at, *hashes))
        at = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8 * len(kinds)
    for size, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of two neighbouring windows together, from their names."""
    h = a >> np.uint64(31)
    h ^= a
    h *= np.uint64(0x9E3779B97F4A7C15)
    h += b
    high = h >> np.uint64(32)
    h ^= high
    h *= np.uint64(0xD6E8FEB86659FD93)
    np.right_shift(h, np.uint64(32), out=high)
    h ^= high
    return h


def window_names(words: np.ndarray, width: int) -> np.ndarray:
    """Names of all windows of ``width`` words, put together from windows of half that length."""
    if width == 1:
        return words
    half = window_names(words, width // 2)
    n = max(len(words) - width + 1, 0)
    names = _joined(half[:n], half[width // 2 : width // 2 + n])
    return _joined(names, words[width - 1 : width - 1 + n]) if width % 2 else names


def _least_of(names: np.ndarray, span: int) -> np.ndarray:
    """Least of every ``span`` neighbouring names."""
    n, size = len(names) - span + 1, 1
    while 2 * size <= span:
        names = np.minimum(names[:-size], names[size:])
        size *= 2
    return names[:n] if span == size else np.minimum(names[:n], names[span - size : span - size + n])


def _part(names: np.ndarray, parts: int) -> np.ndarray:
    """Part of a name, rising with it."""
    return ((names >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_keys[0]), bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _name_order(names: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Order by name, then check; equal ones in any order. Names alone decide but for the rare equal ones with two checks."""
    order = np.argsort(names)
    same = names[order[1:]] == names[order[:-1]]
    return np.lexsort((checks, names)) if (same & (checks[order[1:]] != checks[order[:-1]])).any() else order


def _by_part(part: np.ndarray, parts: int):
    """(part, slice) of the parts that occur in rising ``part``."""
    bounds = np.searchsorted(part, np.arange(parts + 1))
    return [(p, slice(a, b)) for p, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a]


class _Block:
    """The windows of a block's documents; documents without an id have none."""

    def __init__(self, rows: pd.DataFrame, width: int):
        rows = ordered(rows)
        self.ids = rows["_id"].to_numpy("int64")
        texts = [b"" if skip else t for t, skip in zip(rows["_text"], rows["_null"])]
        begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
        starts, words, checks = word_hashes(b"\n".join(texts))
        bounds = np.searchsorted(starts, begins)
        sizes = np.diff(bounds)
        first = np.cumsum(sizes) - sizes
        number = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(words)) - first[number]
        whole = place + width <= sizes[number]  # windows that end in their document
        self.at = np.flatnonzero(whole)
        self.number, self.place = number[self.at], place[self.at]
        self._words, self._checks, self.width = words, checks, width

    def keys(self) -> np.ndarray:
        """Per window the least name among its windows of half its length: equal in equal windows."""
        half = (self.width + 1) // 2
        if not len(self.at):
            return np.zeros(0, np.uint64)
        return _joined(_least_of(window_names(self._words, half), self.width - half + 1)[self.at], np.uint64(half))

    def names(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of name of the chosen windows, as two arrays."""
        if not some.any():
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        at = self.at[some]
        return window_names(self._words, self.width)[at], (window_names(self._checks, self.width)[at] >> np.uint64(32)).astype(np.uint32)


def ordered(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's documents in the order that gives them their numbers, the same in every task."""
    return rows.sort_values(["_null", "_id", "_text"], kind="stable", ignore_index=True)


def _shared(names: list[np.ndarray], several: list[np.ndarray]) -> list[np.ndarray]:
    """Per block: which of its names are in two documents or more, in this block or another."""
    sizes = [len(n) for n in names]
    flat = np.concatenate(names)
    order = np.argsort(flat)
    start = _starts(flat[order])
    size = np.diff(np.append(start, len(flat)))
    flag = np.zeros(len(flat), bool)
    flag[order] = np.repeat((size > 1) | np.logical_or.reduceat(np.concatenate(several)[order], start), size)
    return np.split(flag, np.cumsum(sizes)[:-1])


def _flags(rows: pd.DataFrame) -> pd.DataFrame:
    blobs = [_unpacked(b, "u8", "u1") for b in rows["blob"]]
    shared = _shared([n for n, _ in blobs], [np.unpackbits(s, count=len(n)).astype(bool) for n, s in blobs])
    return pd.DataFrame({"part": rows["part"], "block": rows["block"], "blob": [_packed(np.packbits(s), np.array([len(s)])) for s in shared]})


def _told(names: np.ndarray, number_ids: np.ndarray, block: int, parts: int) -> list[tuple]:
    """Messages (part, block, blob) on a block's distinct names: which are there, which of them in several documents."""
    order = np.argsort(names)
    start = _starts(names[order])
    doc, distinct = number_ids[order], names[order][start]
    several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start) if len(start) else np.zeros(0, bool)
    return [(p, block, _packed(distinct[s], np.packbits(several[s]))) for p, s in _by_part(_part(distinct, parts), parts)]


def _answers(flags: pd.DataFrame) -> np.ndarray:
    bits = []
    for blob in flags.sort_values("part")["blob"]:
        packed, n = _unpacked(blob, "u1", "i8")
        bits.append(np.unpackbits(packed, count=int(n[0])).astype(bool))
    return np.concatenate([np.zeros(0, bool), *bits])


_MESSAGE = "part int, block int, blob binary"
_STATE = "part int, block int, n long, blob binary"


def remove_repeated_windows(docs: DataFrame, finish: Callable[[DataFrame], DataFrame], width: int = 13, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes each word covered by ``width`` words that also start in a document with a smaller id.

    ``finish`` gets rows (id, kept, n_words, n_removed, longest) and its result is written before the
    intermediate tables go. Words are what white space (U+0020, U+0009 to U+000D) sets apart; ``kept`` has
    the remaining ones, joined by one space. ``longest`` is the greatest of the lengths width, 2 * width,
    4 * width, ... at which a window of the document also starts in another one, 0 for none. Null texts
    have no words. Rows of one id do not remove from each other, each keeps its row; a null id is no
    document's copy and no document is a copy of it. Other columns are not read.

    1. Documents are laid out once by blocks (a hash of the id); later steps shuffle no text.
    2. Half the width: every window has the least name of its half-length windows as key. Blocks send each
       distinct key to the part of its range, which sends back one bit: in two documents or not.
    3. The width: windows with a repeated key are extended to it, by 96-bit names. Blocks send each distinct
       name with its smallest id, however many copies they hold, and get back the smallest id of all.
    4. Twice the length, again and again: a window stays if it and its right neighbour repeat at the length
       before, and so does the name made of their two names. It ends when nothing repeats. A block keeps the
       windows that are left, in a table laid out by block that replaces the one of the length before.
    5. Marks return to the blocks, which cut the words.
    """
    if width < 2:
        raise ValueError("windows have two words or more")
    parts = shards(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(
        F.pmod(F.xxhash64(id), F.lit(parts)).cast("int").alias("_block"), F.coalesce(F.col(id).cast("long"), F.lit(0)).alias("_id"),
        F.col(id).isNull().alias("_null"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_text"),
    )

    def tell_keys(rows: pd.DataFrame) -> pd.DataFrame:
        block = _Block(rows, width)
        keys = block.keys()
        new = np.append(True, (np.diff(keys.view(np.int64)) != 0) | (np.diff(block.number) != 0))[: len(keys)]
        told = _told(keys[new], block.ids[block.number[new]], int(rows["_block"].iloc[0]), parts)
        return pd.DataFrame(told, columns=["part", "block", "blob"])

    def candidates(rows: pd.DataFrame, flags: pd.DataFrame) -> tuple:
        """A block's windows with a repeated key, by name: (ids, number, place, starts of equal names, names, checks)."""
        block = _Block(rows, width)
        keys, answers = block.keys(), _answers(flags)
        run = _starts(keys)  # neighbouring windows often share their key
        place = np.unique(keys[run], return_inverse=True)[1]
        some = np.repeat(answers[place], np.diff(np.append(run, len(keys)))) if len(answers) else np.zeros(len(keys), bool)
        names, checks = block.names(some)
        order = _name_order(names, checks)
        names, checks = names[order], checks[order]
        return block.ids, block.number[some][order], block.place[some][order], _starts(names, checks), names, checks

    def tell_names(rows: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(flags):
            own = int(rows["_block"].iloc[0])
            ids, number, _, start, names, checks = candidates(rows, flags)
            if len(start):
                least, distinct, check = np.minimum.reduceat(ids[number], start), names[start], checks[start]
                out = [(p, own, _packed(distinct[s], check[s], least[s])) for p, s in _by_part(_part(distinct, parts), parts)]
        return pd.DataFrame(out, columns=["part", "block", "blob"])

    def least_ids(rows: pd.DataFrame) -> pd.DataFrame:
        blobs = [_unpacked(b, "u8", "u4", "i8") for b in rows["blob"]]
        names, checks, ids = (np.concatenate([b[i] for b in blobs]) for i in range(3))
        order = _name_order(names, checks)
        start = _starts(names[order], checks[order])
        size = np.diff(np.append(start, len(names)))
        several, least = np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        several[order] = np.repeat(size > 1, size)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], start), size)
        ends = np.cumsum([len(b[0]) for b in blobs])[:-1]
        out = [_packed(np.packbits(s), np.array([len(s)]), x[s]) for s, x in zip(np.split(several, ends), np.split(least, ends))]
        return pd.DataFrame({"part": rows["part"], "block": rows["block"], "blob": out})

    def mark(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Part -1: windows to remove. Part -2: the repeated windows."""
        out: list[tuple] = []
        if len(rows) and len(told):
            own, replies = int(rows["_block"].iloc[0]), told[told["kind"] == 1].sort_values("part")["blob"]
            ids, number, place, start, names, _ = candidates(rows, told[told["kind"] == 0])
            if len(start):
                doc, size = ids[number], np.diff(np.append(start, len(number)))
                least, most = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
                several, found = [], []
                for blob in replies:
                    bits, n, x = _unpacked(blob, "u1", "i8", "i8")
                    several.append(np.unpackbits(bits, count=int(n[0])).astype(bool))
                    found.append(x)
                several = np.concatenate(several)
                on = np.repeat(several | (least != most), size)
                least[several] = np.concatenate(found)
                gone = doc > np.repeat(least, size)
                out.append((-1, own, 0, _packed(number[gone].astype(np.int32), place[gone].astype(np.int32))))
                here = number[on] << 32 | place[on]
                order = np.argsort(here)
                out.append((-2, own, len(here), _state(ids, here[order], names[on][order], np.zeros(len(ids), np.int32), width)))
        return pd.DataFrame(out, columns=["part", "block", "n", "blob"])

    def extend(length: int):
        def run(batches):
            for batch in batches:
                told = []
                for own, blob in zip(batch["block"], batch["blob"]):
                    ids, here, names, _ = _doubled(blob, length)
                    told += _told(names, ids[here >> 32], int(own), parts)
                yield pd.DataFrame(told, columns=["part", "block", "blob"])

        return run

    def keep(length: int):
        def run(state: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(state):
                ids, here, names, reached = _doubled(state["blob"].iloc[0], length)
                on = _answers(flags)[np.searchsorted(np.unique(names), names)] if len(flags) else np.zeros(len(names), bool)
                out.append((-2, int(state["block"].iloc[0]), int(on.sum()), _state(ids, here[on], names[on], reached, 2 * length)))
            return pd.DataFrame(out, columns=["part", "block", "n", "blob"])

        return run

    def cut(rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        rows = ordered(rows)
        number = place = np.zeros(0, np.int32)
        reached = np.zeros(len(rows), np.int64)
        for part, blob in zip(marks["part"], marks["blob"]):
            if part == -1:
                number, place = _unpacked(blob, "i4", "i4")
            else:
                reached = _unpacked(blob, "i8", "i8", "u8", "i4")[3]
        order = np.argsort(number, kind="stable")
        number, place = number[order], place[order]
        bounds = np.searchsorted(number, np.arange(len(rows) + 1))
        kept, n_words, n_removed = [], [], []
        for i, t in enumerate(rows["_text"]):
            words = t.split()  # of bytes, at exactly these white-space signs
            n_words.append(len(words))
            at = place[bounds[i] : bounds[i + 1]]
            if len(at):
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + width, -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        out = rows[["_id", "_null"]].assign(kept=kept, n_words=n_words, n_removed=n_removed, longest=reached)
        return out[["_id", "_null", "kept", "n_words", "n_removed", "longest"]]

    with bucketed(rows, "_block", parts) as laid:
        by_block = laid.groupBy("_block")
        keys = by_block.applyInPandas(tell_keys, _MESSAGE)
        flags = materialise(keys.groupBy("part").applyInPandas(_flags, _MESSAGE))
        names = by_block.cogroup(flags.groupBy("block")).applyInPandas(tell_names, _MESSAGE)
        replies = names.groupBy("part").applyInPandas(least_ids, _MESSAGE)
        told = flags.withColumn("kind", F.lit(0)).unionByName(replies.withColumn("kind", F.lit(1)))
        with ExitStack() as held:
            marked = held.enter_context(bucketed(by_block.cogroup(told.groupBy("block")).applyInPandas(mark, _STATE), "block", parts))
            discard(flags)
            state, length, stack = marked.where("part = -2"), width, ExitStack()
            held.callback(lambda: stack.close())
            while state.agg(F.sum("n")).first()[0]:
                flags = state.mapInPandas(extend(length), _MESSAGE).groupBy("part").applyInPandas(_flags, _MESSAGE)
                kept = state.groupBy("block").cogroup(flags.groupBy("block")).applyInPandas(keep(length), _STATE)
                following = ExitStack()
                state = following.enter_context(bucketed(kept, "block", parts))
                stack.close()
                stack, length = following, 2 * length
            found = marked.where("part = -1").unionByName(state)
            shape = "_id long, _null boolean, kept binary, n_words long, n_removed long, longest long"
            result = by_block.cogroup(found.groupBy("block")).applyInPandas(cut, shape)
            result = result.select(F.when(~F.col("_null"), F.col("_id")).cast(kind).alias(id), F.col("kept").cast("string").alias("kept"), "n_words", "n_removed", "longest")
            return materialise(finish(result))


def _state(ids: np.ndarray, here: np.ndarray, names: np.ndarray, reached: np.ndarray, length: int) -> bytes:
    """Windows that repeat at ``length`` (document number and place as one, rising) and every document's greatest length."""
    reached = reached.copy()
    reached[here >> 32] = length
    return _packed(ids, here, names, reached)


def _doubled(blob: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of twice the length both of whose halves repeat: (ids, document and place, names, greatest lengths)."""
    ids, here, names, reached = _unpacked(blob, "i8", "i8", "u8", "i4")
    right = np.searchsorted(here, here + length)
    both = here[np.minimum(right, len(here) - 1)] == here + length if len(here) else np.zeros(0, bool)
    return ids, here[both], _joined(names[both], names[right[both]]), reached
