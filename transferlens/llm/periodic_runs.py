"""Periodic runs of words: a suffix automaton whose link tree is recoloured by link-cut access."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^ \t-\r]+")


class _Numbers(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def maximal_repetitions(words: Sequence[int]) -> dict[tuple[int, int], int]:
    """{(start, period): last place} of every maximal stretch with that smallest period and two periods or more.

    A state's strings end together, so the last place where they ended is one colour per state, and the
    states on the way from a prefix to the root form segments of one colour. Appending word i walks up
    from the new prefix and recolours the way with i (the access step of a link-cut tree: a preferred
    path is a segment). A segment last seen at e whose lowest state on the way has length n says that the
    n words up to e and up to i are equal and that n + 1 are not; with d = i - e <= n they make a square,
    and n + d words up to i have period d and cannot be extended to the left. The largest i of a stretch
    is its right end. Shorter periods are met as shorter distances, so d is always the smallest period.
    """
    length, link, edges = [0], [-1], [{}]
    up, left, right, colour = [0], [0], [0], [-1]  # splay trees of the preferred paths; 0 is the root and no node of them
    found: dict[tuple[int, int], int] = {}

    def new_state(n: int, parent: int, out: dict) -> int:
        length.append(n)
        link.append(parent)
        edges.append(out)
        for nodes in (up, left, right):
            nodes.append(0)
        colour.append(-1)
        return len(length) - 1

    def rotate(x: int, f: int) -> None:
        g = up[f]
        if left[f] == x:
            b = right[x]
            left[f], right[x] = b, f
        else:
            b = left[x]
            right[f], left[x] = b, f
        if b:
            up[b] = f
        up[f], up[x] = x, g
        if left[g] == f:
            left[g] = x
        elif right[g] == f:
            right[g] = x
        colour[x] = colour[f]  # a path's colour is kept at the root of its splay tree

    def splay(x: int) -> None:
        f = up[x]
        while left[f] == x or right[f] == x:
            g = up[f]
            if left[g] == f:
                if left[f] == x:
                    rotate(f, g)
                else:
                    rotate(x, f)
                    f = g
            elif right[g] == f:
                if right[f] == x:
                    rotate(f, g)
                else:
                    rotate(x, f)
                    f = g
            rotate(x, f)
            f = up[x]

    last = 0
    for i, word in enumerate(words):
        state, p = new_state(i + 1, 0, {}), last
        while p != -1 and word not in edges[p]:
            edges[p][word] = state
            p = link[p]
        parent = 0
        if p != -1:
            parent = q = edges[p][word]
            if length[p] + 1 != length[q]:
                parent = new_state(length[p] + 1, link[q], edges[q].copy())
                while p != -1 and edges[p].get(word) == q:
                    edges[p][word] = parent
                    p = link[p]
                link[q] = parent
                # The copy stands directly above q on q's path and has its colour.
                splay(q)
                above = left[q]
                left[parent], up[parent], left[q] = above, q, parent
                if above:
                    up[above] = parent
        link[state] = up[state] = parent
        last = state

        x, below, before = state, 0, -1
        while x:
            splay(x)
            e = colour[x]
            if e != before:
                n, d = length[x], i - e
                if e >= 0 and d <= n:
                    found[i - n - d + 1, d] = i
                before = e
            cut = right[x]
            if cut:
                colour[cut] = e
            right[x] = below
            below, x = x, up[x]
        colour[below] = i
    return found


def _covered(words: np.ndarray, owner: np.ndarray, gram: int) -> np.ndarray:
    """Words covered by ``gram`` words that stand at least twice under the same owner."""
    out = np.zeros(len(words) + 1, np.int32)
    n = len(words) - gram + 1
    if n <= 1:
        return out[:-1] > 0
    with np.errstate(over="ignore"):
        h = owner[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(gram):
            h = (h ^ words[k : k + n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
    at = np.flatnonzero(owner[:n] == owner[gram - 1 :])
    order = at[np.argsort(h[at])]
    same = h[order[1:]] == h[order[:-1]]
    again = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    out[again] += 1
    np.add.at(out, again + gram, -1)
    return np.cumsum(out[:-1]) > 0


def _stretches(words: np.ndarray, owner: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches that hold every run whole.

    A run of n >= max(least, 2 * period) words repeats its first n - period >= least / 2 words at its end,
    and the two copies cover it: a word outside repeated half-length windows is in no run. The same is
    asked again of the stretches that are left, until none shrinks.
    """
    gram, at = -(-least // 2), np.arange(len(words))
    while True:
        kept = at[_covered(words[at], owner[at], gram)]
        fresh = np.append(True, (np.diff(kept) != 1) | (np.diff(owner[kept]) != 0)) if len(kept) else np.zeros(0, bool)
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(kept)))
        kept = kept[np.repeat(sizes >= least, sizes)]
        if len(kept) == len(at):
            break
        at = kept
        owner = owner.copy()
        owner[kept] = np.cumsum(np.append(True, (np.diff(kept) != 1) | (np.diff(owner[kept]) != 0)))[: len(kept)]
    bounds = np.append(np.flatnonzero(np.append(True, np.diff(owner[at]) != 0)), len(at)) if len(at) else np.zeros(1, int)
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(bounds[:-1], bounds[1:])]


def runs_of_texts(texts: Sequence[str | None], least: int = 12) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """(words, runs (start, length, period) by start and period) of every text."""
    numbers = _Numbers()
    words = [WORD.findall(t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((numbers[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
    first, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(words)), sizes)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for a, b in _stretches(flat, owner, least):
        t = int(owner[a])
        base = a - int(first[t])
        for (start, period), end in maximal_repetitions(flat[a:b].tolist()).items():
            n = end - start + 1
            if n >= least:
                runs[t].append((base + start, n, period))
    return [(w, sorted(r, key=lambda x: (x[0], x[2]))) for w, r in zip(words, runs)]


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    gone = bytearray(len(words))
    for start, n, period in runs:
        gone[start + period : start + n] = b"\1" * (n - period)
    return " ".join([w for w, g in zip(words, gone) if not g])


_SHAPE = "struct<n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string>"


def periodic_runs(text: Column, least: int = 12) -> Column:
    """Struct (n_words, starts, lengths, periods, collapsed) of each text; the arrays go together, one entry per run.

    A run is a maximal stretch of max(``least``, 2 * period) words or more (white space apart words) with that
    smallest period. Null counts as the empty text: no words, no runs, an empty collapsed text. Rows are
    worked on by themselves, so ids, repeated rows and other columns do not matter; a text is held whole
    by one task, with some 500 bytes for each word of a stretch that repeats itself.
    """

    @F.pandas_udf(_SHAPE)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        sizes = texts.str.len().fillna(0).to_numpy("int64")
        for _, part in texts.groupby(np.cumsum(sizes) // (1 << 21), sort=True):  # about two million characters at a time
            for words, runs in runs_of_texts(part.tolist(), least):
                starts, lengths, periods = (list(c) for c in zip(*runs)) if runs else ([], [], [])
                rows.append((len(words), starts, lengths, periods, collapse(words, runs)))
        return pd.DataFrame(rows, columns=["n_words", "starts", "lengths", "periods", "collapsed"])

    return find(text)


def with_runs(docs: DataFrame, text: str = "text", to: str = "found", least: int = 12) -> DataFrame:
    """Adds struct ``to`` (n_words, runs array<struct<start, length, period>>, collapsed); an older column of that name goes."""
    found = docs.withColumn(to, periodic_runs(F.col(text).cast("string"), least))
    runs = F.arrays_zip(
        F.col(to)["starts"].alias("start"), F.col(to)["lengths"].alias("length"), F.col(to)["periods"].alias("period")
    ).cast("array<struct<start: long, length: long, period: long>>")
    return found.withColumn(to, F.struct(F.col(to)["n_words"].alias("n_words"), runs.alias("runs"), F.col(to)["collapsed"].alias("collapsed")))
