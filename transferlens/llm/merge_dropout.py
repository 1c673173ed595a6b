"""Byte-pair encoding with seeded merge dropout, and its inverse."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = "▁"
#: Plain segmentations kept per worker (and at most 8 times as many merges): before a block of texts a full
#: store is emptied. This changes no result.
_STORED = 500_000
_CODERS: dict[tuple, DropoutEncoder] = {}
#: Words shorter than this merge side by side and are kept; texts are taken this many characters at a time.
_SHORT, _BLOCK = 64, 1 << 22
_NONE = np.iinfo(np.int32).max
_WHOLE = 2**64 - 1
_WORD = re.compile(f"{_SPACE}+[^{_SPACE}\n]*|[^{_SPACE}\n]+|\n")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def _span(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each stretch of a word."""
    return (start.astype(np.uint64) << np.uint64(32) | end.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)


def _draw(keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32 bits for the candidate that covers a word from start to end."""
    return (_mixed(keys ^ _span(start, end)) >> np.uint64(32)).astype(np.int64)


def _draw_one(key: int, start: int, end: int) -> int:
    """``_draw`` of one candidate."""
    x = key ^ ((start << 32 | end) * 0x9E3779B97F4A7C15 & _WHOLE)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _WHOLE
    return ((x ^ x >> 27) * 0x94D049BB133111EB & _WHOLE) >> 32


def _slots(pairs: np.ndarray, slots: int) -> np.ndarray:
    hashed = pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (hashed >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _gathered(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places first, first + 1, ... of each stretch, one stretch after the other."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


class _Flat:
    """Lists of numbers by place: ``values[first : first + count]`` of each."""

    def __init__(self, kind: type, places: int):
        self.parts, self.total = [np.zeros(0, kind)], 0
        self.first, self.count = np.zeros(places, np.int64), np.zeros(places, np.int64)

    def put(self, places: np.ndarray, values: np.ndarray, count: np.ndarray) -> None:
        """Sets the lists at ``places``, which stand in ``values`` one after the other."""
        self.first[places], self.count[places] = self.total + np.cumsum(count) - count, count
        self.parts.append(values.astype(self.parts[0].dtype, copy=False))
        self.total += len(values)

    def append(self, other: _Flat) -> None:
        """Adds the places of the other list behind."""
        self.first, self.count = np.concatenate((self.first, other.first + self.total)), np.concatenate((self.count, other.count))
        self.parts += other.parts
        self.total += other.total

    def __len__(self) -> int:
        return self.total

    @property
    def values(self) -> np.ndarray:
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        return self.parts[0]


class DropoutEncoder:
    """Encodes with a public BPE vocabulary whose pieces carry merge scores and fall back to bytes.

    Symbols are merged by an agenda: best score first, then leftmost. A candidate taken from the
    agenda is dropped for good when a hash of (seed, text's key, word's number, place) falls under
    ``dropout``, so every occurrence of a word draws each of its candidates, the same on every run. Where
    none of the merges of the plain segmentation is dropped, that segmentation is taken from a store.
    With dropout 0 the ids are those of the vocabulary's own encoder. A literal U+2581 is written as
    bytes, so that every text decodes to itself.
    """

    def __init__(self, model_file: str, dropout: float = 0.1, seed: int = 1):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.dropout, self.seed = int(dropout * 2**32), seed
        self.packed: dict[str, bytes] = {}
        scores: dict[str, float] = {}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.decoded: list[bytes] = [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                piece = sp.id_to_piece(i)
                scores[piece], self.packed[piece] = sp.get_score(i), i.to_bytes(4, "little")
                self.decoded[i] = piece.replace(_SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.decoded[i] = bytes([b])
        order = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: order[score] for piece, score in scores.items()}
        if any(_SPACE in p.lstrip(_SPACE) or ("\n" in p and p != "\n") for p in scores):
            raise ValueError("a piece reaches over a word's end")
        self.mark = np.array([self.bytes[b] for b in _SPACE.encode()], "<u4").tobytes()
        #: words by their place in two lists: ids of the plain segmentation, and its merges
        self.place: dict[str, int]
        self.plain: _Flat
        self.spans: _Flat
        self._forget()
        self._index_pairs()

    def _segment(self, word: str, number: int | None, taken: list[tuple[int, int]] | None = None) -> bytes:
        """Ids of one word as little-endian bytes, by a heap; with number None nothing is dropped.

        A candidate is one number: rank of its piece, start and end. Two neighbours can cover a span in
        one way only, so the span says which symbols it joins, and it is live while they still stand there.
        """
        ranks, drop = self.ranks, 0 if number is None else self.dropout
        n = len(word)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n))  # of a symbol's start; 0 where none starts any more
        agenda = [(r << shift | i) << shift | i + 2 for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            candidate = heapq.heappop(agenda)
            end, i = candidate & mask, candidate >> shift & mask
            j = after[i]
            if not j or j >= end or after[j] != end or (drop and _draw_one(number, i, end) < drop):
                continue
            after[i], after[j], before[end] = end, 0, i
            if taken is not None:
                taken.append((i, end))
            if end < n and (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(agenda, (r << shift | i) << shift | after[end])
            if i and (r := ranks.get(word[before[i] : end])) is not None:
                heapq.heappush(agenda, (r << shift | before[i]) << shift | end)
        ids, at = [], 0
        while at < n:
            ids.append(self._id_bytes(word[at : after[at]]))
            at = after[at]
        return b"".join(ids)

    def _segment_many(self, words: list[str], keys: np.ndarray | None = None) -> tuple[_Flat, _Flat]:
        """Ids of many words; with keys None nothing is dropped and the second list has each word's merges.

        Short words of one length work off their agendas side by side: a word is a column, its agenda the
        numbers (rank, start) of that column. Words with a character that is no piece, or as long as
        ``_SHORT``, are left to the heap.
        """
        ids, spans = _Flat(np.uint32, len(words)), _Flat(np.uint64, len(words))
        apart, groups = self._columns(words)
        for k in apart:
            taken: list[tuple[int, int]] = []
            one = np.frombuffer(self._segment(words[k], None if keys is None else int(keys[k]), taken), "<u4")
            ids.put(np.array([k]), one, np.array([len(one)]))
            if keys is None:
                one = np.array(taken, np.int64).reshape(-1, 2)
                spans.put(np.array([k]), _span(one[:, 0], one[:, 1]), np.array([len(one)]))
        for chosen, symbols in groups:
            taken_many: list[np.ndarray] | None = [] if keys is None else None
            merged, alive = self._merge(symbols, None if keys is None else keys[chosen], taken_many)
            ids.put(chosen, merged.T[alive.T], alive.sum(axis=0))
            if taken_many:
                rows = np.concatenate(taken_many)
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                spans.put(chosen, _span(rows[:, 1], rows[:, 2]), np.bincount(rows[:, 0], minlength=len(chosen)))
        return ids, spans

    def _columns(self, words: list[str]) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
        """Which words are left to the heap; the others by length, with a column of symbols each."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words):
            return [], []
        chars = self.chars[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        first = np.cumsum(size) - size
        apart = (np.minimum.reduceat(chars, first) < 0) | (size >= _SHORT)
        groups = []
        for n in np.unique(size[~apart]).tolist():
            chosen = np.flatnonzero(~apart & (size == n))
            groups.append((chosen, chars[first[chosen] + np.arange(n)[:, None]]))
        return np.flatnonzero(apart).tolist(), groups

    def _merge(self, symbols: np.ndarray, keys: np.ndarray | None, taken: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Merges the columns of ``symbols``; returns the symbols and which of their places still start one.

        With keys None nothing is dropped. ``taken`` gets rows (column, start, end) of what is merged.
        """
        n, width = symbols.shape
        symbol = symbols.astype(np.int64).ravel()  # place i of column c is at i * width + c
        after = np.repeat(np.arange(1, n + 1), width)
        before = np.repeat(np.arange(-1, n), width)
        alive, agenda = np.ones(n * width, bool), np.full((n, width), _NONE, np.int32)
        for i in range(n - 1):
            agenda[i] = self._candidates(symbols[i], symbols[i + 1], i)
        flat = agenda.ravel()
        columns = np.arange(width)
        while True:
            best = agenda.min(axis=0) if len(columns) == width else agenda[:, columns].min(axis=0)
            left = best != _NONE
            columns, i = columns[left], best[left].astype(np.int64) % _SHORT
            if not len(columns):
                return symbol.reshape(n, width), alive.reshape(n, width)
            here = i * width + columns
            flat[here] = _NONE
            there = after[here] * width + columns
            end = after[there]
            if keys is not None and self.dropout:
                go = _draw(keys[columns], i, end) >= self.dropout
                i, here, there, end, at = i[go], here[go], there[go], end[go], columns[go]
            else:
                at = columns
            if taken is not None:
                taken.append(np.stack((at, i, end), axis=1))
            symbol[here] = self._joined(symbol[here], symbol[there])[1]
            alive[there], flat[there] = False, _NONE
            after[here] = end
            before[end * width + at] = i
            more = np.flatnonzero(end < n)
            flat[here[more]] = self._candidates(symbol[here[more]], symbol[end[more] * width + at[more]], i[more])
            more = np.flatnonzero(i)
            i = before[here[more]]
            over = i * width + at[more]
            flat[over] = self._candidates(symbol[over], symbol[here[more]], i)

    def _candidates(self, a: np.ndarray, b: np.ndarray, start) -> np.ndarray:
        rank, _ = self._joined(a, b)
        return np.where(rank < 0, _NONE, rank * _SHORT + start)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that two neighbouring pieces make; -1 where there is none."""
        wanted = a.astype(np.int64) << 32 | b
        slot = _slots(wanted, len(self.pairs))
        found = self.pairs[slot]
        open_ = np.flatnonzero((found != wanted) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.pairs)
            found = self.pairs[slot[open_]]
            open_ = open_[(found != wanted[open_]) & (found >= 0)]
        return self.pair_rank[slot], self.pair_id[slot]

    def _index_pairs(self) -> None:
        """Open-addressed table of all cuts of a piece into two pieces, and the piece of each character."""
        number = {piece: int.from_bytes(raw, "little") for piece, raw in self.packed.items()}
        self.chars = np.full(0x110000, -1, np.int32)
        made: list[tuple[int, int, int]] = []
        for piece, k in number.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = k
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    made.append((a << 32 | b, self.ranks[piece], k))
        pairs, rank, piece_id = (np.array(x, np.int64) for x in zip(*made)) if made else (np.zeros(0, np.int64),) * 3
        slots = 1 << max(10, (4 * len(pairs)).bit_length())
        self.pairs, self.pair_rank, self.pair_id = (np.full(slots, -1, np.int64) for _ in range(3))
        at, todo = _slots(pairs, slots), np.arange(len(pairs))
        while len(todo):
            free = todo[self.pairs[at[todo]] < 0]
            self.pairs[at[free]] = pairs[free]  # of several, one stays
            placed = self.pairs[at[todo]] == pairs[todo]
            done = todo[placed]
            self.pair_rank[at[done]], self.pair_id[at[done]] = rank[done], piece_id[done]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) % slots

    def _id_bytes(self, symbol: str) -> bytes:
        found = self.packed.get(symbol)
        if found is None:
            found = np.array([self.bytes[b] for b in symbol.encode()], "<u4").tobytes()
        return found

    def _words(self, text: str, key: int) -> tuple[list[str], np.ndarray]:
        """Words of the text and a number of 64 bits for each; a literal U+2581 is the word ""."""
        words: list[str] = []
        for k, part in enumerate(text.split(_SPACE)):
            part = part.replace(" ", _SPACE)
            if k:
                words.append("")
            words += _WORD.findall(part if k else _SPACE + part)
        number = np.arange(len(words), dtype=np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + self.seed) % 2**64)
        return words, _mixed(number)

    def _forget(self) -> None:
        """Empties the store, but for the mark of a literal U+2581."""
        self.place, self.plain, self.spans = {"": 0}, _Flat(np.uint32, 1), _Flat(np.uint64, 1)
        self.plain.put(np.array([0]), np.frombuffer(self.mark, "<u4"), np.array([3]))

    def _recall(self, words: list[str]) -> np.ndarray:
        """Places of the words in the store, after those it lacks are segmented."""
        if len(self.place) >= _STORED or len(self.spans) >= 8 * _STORED:
            self._forget()
        fresh = list(set(words).difference(self.place))
        if fresh:
            ids, spans = self._segment_many(fresh)
            self.plain.append(ids)
            self.spans.append(spans)
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def _dropped(self, of: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Places of the occurrences that drop a merge of their plain segmentation."""
        count = self.spans.count[of]
        who = np.repeat(np.arange(len(of)), count)
        spans = self.spans.values[_gathered(self.spans.first[of], count)]
        who = who[(_mixed(numbers[who] ^ spans) >> np.uint64(32)).astype(np.int64) < self.dropout]
        return who[np.diff(who, prepend=-1) > 0]

    def encode_many(self, texts: list[str], keys: list[int]) -> Iterator[np.ndarray]:
        """Ids of each text in turn, about ``_BLOCK`` characters at a time; an empty text has none."""
        at = 0
        while at < len(texts):
            first, chars = at, 0
            while at < len(texts) and (at == first or chars + len(texts[at]) <= _BLOCK):
                chars += len(texts[at])
                at += 1
            block = [self._words(text, key) if text else ([], np.zeros(0, np.uint64)) for text, key in zip(texts[first:at], keys[first:at])]
            words = [w for found, _ in block for w in found]
            of = self._recall(words)
            pool, begin, count = self.plain.values, self.plain.first[of], self.plain.count[of]
            if words and self.dropout:
                numbers = np.concatenate([n for _, n in block])
                changed = self._dropped(of, numbers)
                ids, _ = self._segment_many([words[k] for k in changed.tolist()], numbers[changed])
                begin[changed], count[changed] = ids.first + len(pool), ids.count
                pool = np.concatenate((pool, ids.values))
            ids_of_all = pool[_gathered(begin, count)]
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))[np.cumsum([0, *[len(found) for found, _ in block]])]
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                yield ids_of_all[start:end]

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        """Ids of the text; an empty text has none."""
        return next(self.encode_many([text], [key]))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``encode``'s ids."""
        return b"".join(map(self.decoded.__getitem__, ids.tolist()))[1:].decode()


def _coder(*settings) -> DropoutEncoder:
    """The worker's encoder of these settings, with what it has stored."""
    return _CODERS.get(settings) or _CODERS.setdefault(settings, DropoutEncoder(*settings))


def encode_documents(docs: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text, one row for each; null counts as empty and has no ids.

    Ids travel as text, since a null among numbers would turn a pandas column into floats. Rows of one id draw alike.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(model_file, dropout, seed)
        for batch in batches:
            ids = [x.astype(np.int32) for x in coder.encode_many([t or "" for t in batch["t"]], batch["k"].tolist())]
            yield pd.DataFrame({id: batch[id], "ids": ids})

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).cast("string"), F.col(text).cast("string").alias("t"), F.xxhash64(id).alias("k"))
    return rows.mapInPandas(run, f"{id} string, ids array<int>").withColumn(id, F.col(id).cast(kind))


def decode_documents(encoded: DataFrame, model_file: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) from rows of ids; null or empty ids give the empty text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(model_file, 0.0)
        for batch in batches:
            yield pd.DataFrame({id: batch[id], "text": ["" if x is None else coder.decode(np.asarray(x)) for x in batch[ids]]})

    kind = encoded.schema[id].dataType.simpleString()
    rows = encoded.select(F.col(id).cast("string"), ids)
    return rows.mapInPandas(run, f"{id} string, text string").withColumn(id, F.col(id).cast(kind))


def round_trip(docs: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_ids, ids_crc32, lossless, decoded_sha256): digests of encoding and decoding in one pass."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(model_file, dropout, seed)
        for batch in batches:
            out, texts = [], [t or "" for t in batch["t"]]
            for i, t, ids in zip(batch[id], texts, coder.encode_many(texts, batch["k"].tolist())):
                back = coder.decode(ids)
                out.append((i, len(ids), zlib.crc32(ids.tobytes()), back == t, hashlib.sha256(back.encode()).hexdigest()))
            yield pd.DataFrame(out, columns=[id, "n_ids", "ids_crc32", "lossless", "decoded_sha256"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).cast("string"), F.col(text).cast("string").alias("t"), F.xxhash64(id).alias("k"))
    digests = rows.mapInPandas(run, f"{id} string, n_ids long, ids_crc32 long, lossless boolean, decoded_sha256 string")
    return digests.withColumn(id, F.col(id).cast(kind))
