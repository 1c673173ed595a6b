"""Best-fit packing by a tree of residual rounds."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transferlens.session import materialise

#: Words, and parts of words, that a worker keeps with their ids; a full store is emptied, which changes no result.
_WORDS = 600_000
_CODERS: dict[str, _WordIds] = {}


#: The vocabulary's own splitting rule (fixed value) and, for words of common Latin letters, the same rule.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įĲ-ſ]+|[0-9]|[^a-zß-öø-įĲ-ſ0-9]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įĲ-ſ]+")


class _WordIds:
    """Ids (as bytes) of words by a public vocabulary.

    Words of common Latin letters, digits and ASCII signs are lower-cased and split here, and the
    vocabulary's merges are asked once for each distinct part; all others, and words that may hold a
    special token, go through the vocabulary's whole encoder.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        steps = json.loads(self.tokenizer.to_str())
        rules = [p.get("pattern", {}).get("Regex") for p in (steps["pre_tokenizer"] or {}).get("pretokenizers", [])]
        lower = [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.latin = lower and rules[:1] == [_RULE]
        self.shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.store: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            text = part if part.isascii() else self.shown(part)[0][0]
            found = self.parts[part] = array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()
        return found

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.store)
        if len(self.store) + len(new) > _WORDS:
            self.store.clear()
            new = words
        if len(self.parts) > _WORDS:
            self.parts.clear()
        rest = []
        for w in new:
            text = w.decode()
            if self.latin and _PLAIN.fullmatch(text) and "<|" not in text:
                self.store[w] = b"".join(map(self._part, _LATIN.findall(text.lower())))
            else:
                rest.append((w, text))
        for i in range(0, len(rest), 10_000):
            some = rest[i : i + 10_000]
            for (w, _), found in zip(some, self.tokenizer.encode_batch([t for _, t in some], add_special_tokens=False)):
                self.store[w] = array("I", found.ids).tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): each document's ids with a closing 0, cut at ``capacity``.

    White space never takes part in an id of this kind of vocabulary, so a text's ids are those of its
    words one after another, and a worker encodes each word about once. Null texts count as empty. Each row
    is a document of its own, also with a null or repeated id; ids travel as text, since a null among
    numbers would turn a pandas column into floats.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _CODERS.get(tokenizer_path) or _CODERS.setdefault(tokenizer_path, _WordIds(tokenizer_path))
        close = bytes(4)

        def cut(held: list[tuple]) -> list[tuple]:
            coder.learn(set().union(*(words for _, words in held)))
            out = []
            for doc, words in held:
                raw = b"".join([*map(coder.store.__getitem__, words), close])
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            return out

        for batch in batches:
            held, size, out = [], 0, []
            for doc, t in zip(batch[id], batch["_t"]):
                held.append((doc, t.encode().split()))
                size += len(t)
                if size > 1 << 21:
                    out += cut(held)
                    held, size = [], 0
            out += cut(held) if held else []
            yield pd.DataFrame(out, columns=[id, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id].dataType.simpleString()
    texts = docs.select(F.col(id).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    found = texts.mapInPandas(pieces, f"{id} string, piece int, start long, length long, ids_crc32 long")
    return found.withColumn(id, F.col(id).cast(kind))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit of falling sizes: the bin of every item and its place there.

    Open bins are kept by free space, so the tightest one that fits is found by bisection.
    """
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_at: dict[int, list[int]] = {}
    free: list[int] = []
    made = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        k = bisect_left(free, size)
        if k == len(free):
            b, room, made = made, capacity, made + 1
        else:
            room = free[k]
            b = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                free.pop(k)
        bins[i], places[i] = b, capacity - room
        if left := room - size:
            if left not in open_at:
                open_at[left] = []
                insort(free, left)
            open_at[left].append(b)
    return bins, places


def pack(items: DataFrame, size: str = "length", capacity: int = 2048, local: int = 16_384, fanout: int = 16, full: float = 0.995, carried: int = 8_192) -> DataFrame:
    """``items`` with sequence_id and offset: no sequence holds more than ``capacity``.

    Items are dealt by a hash to parts of about ``local`` items. Each part packs its own by best fit
    and emits nearly full bins (``full``) at once. The others become items of the next round, in which
    ``fanout`` parts meet in one; so on until one part is left. After best fit at most one bin of a
    part is half empty or more, and only such a bin can still move, so a part sends on its ``carried``
    emptiest bins and emits the rest: a task never gets more than ``fanout * carried`` of them.

    Items larger than ``capacity`` or not positive are an error. Items of equal size and equal rows
    are packed one by one; an empty table gives an empty result.
    """
    spark = items.sparkSession
    items = materialise(items.withColumn("_item", F.monotonically_increasing_id()))
    n, least, most = items.agg(F.count("*"), F.min(size), F.max(size)).first()
    if n and (least < 1 or most > capacity):
        raise ValueError(f"sizes go from {least} to {most}; the capacity is {capacity}")
    parts = max(1, -(-n // local))

    def one_round(level: int):
        def run(key, rows: pd.DataFrame) -> pd.DataFrame:
            sizes = rows["size"].to_numpy()
            bins, places = best_fit(sizes, capacity)
            fill = np.bincount(bins, weights=sizes).astype(np.int64)
            final = fill >= full * capacity
            rest = np.flatnonzero(~final)
            final[rest[np.argsort(fill[rest], kind="stable")[carried:]]] = True
            name = (np.int64(level) << 58) + (np.int64(key[0]) << 26) + np.arange(len(fill))
            return pd.DataFrame({"item": rows["item"], "bin": name[bins], "place": places, "fill": fill[bins], "part": np.int64(key[0]), "final": final[bins]})

        return run

    shape = "item long, bin long, place long, fill long, part long, final boolean"
    now = items.select(F.col("_item").alias("item"), F.col(size).cast("long").alias("size"), F.pmod(F.xxhash64("_item"), F.lit(parts)).alias("part"))
    level, done = 0, None
    while True:
        placed = materialise(now.groupBy("part").applyInPandas(one_round(level), shape))
        if done is None:
            done = placed.select(F.col("item").alias("_item"), "bin", "place", "final")
        else:
            moved = placed.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("place").alias("by"), F.col("final").alias("end"))
            done = done.join(moved, "bin", "left").select("_item", F.coalesce("to", "bin").alias("bin"), (F.col("place") + F.coalesce("by", F.lit(0))).alias("place"), F.coalesce("end", "final").alias("final"))
        if parts == 1:
            break
        parts, level = -(-parts // fanout), level + 1
        now = placed.where("NOT final").groupBy("bin").agg(F.first("fill").alias("size"), F.first("part").alias("part"))
        now = now.select(F.col("bin").alias("item"), "size", F.floor(F.col("part") / fanout).alias("part"))
    placed = done.select("_item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    return items.join(placed, "_item").drop("_item")
