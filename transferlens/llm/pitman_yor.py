"""Hierarchical Pitman-Yor language model: seating sampled by blocked Gibbs over Spark parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transferlens.llm.column_bwt import _packed, _unpacked
from transferlens.llm.common import bucketed, shards
from transferlens.session import materialise

_hash = xxhash.xxh3_64_intdigest
#: Names of the end token and of the context before the first word; no word is empty or a line feed.
_END, _START = b"", b"\n"
#: Up to this count a dish's number of tables is drawn from its exact conditional.
_EXACT = 256


def _stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c and t up to ``_EXACT``."""
    table = np.full((_EXACT + 1, _EXACT + 2), -np.inf)
    table[1, 1] = 0.0
    for c in range(1, _EXACT):
        t = np.arange(1, c + 1)
        table[c + 1, 1 : c + 1] = table[c, 1 : c + 1] + np.log(np.maximum(c - discount * t, 1e-300))
        table[c + 1, 2 : c + 2] = np.logaddexp(table[c + 1, 2 : c + 2], table[c, 1 : c + 1])
    return table


def seat(count: np.ndarray, open_weight: np.ndarray, discount: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Number of tables of each dish, all its customers reseated at once given everything else.

    The conditional is p(t) ~ open_weight^t S(count, t), where ``open_weight`` is the weight of a new
    table. It is drawn exactly up to ``_EXACT`` customers; beyond, S takes its asymptotic form, under
    which t - 1 is Poisson with mean open_weight / discount * (1 - count^-discount).
    """
    tables = np.ones(len(count), np.int64)
    order = np.argsort(count, kind="stable")
    sizes = count[order]
    values, start = np.unique(sizes, return_index=True)
    for c, a, b in zip(values.tolist(), start, np.append(start[1:], len(order))):
        if c < 2:
            continue
        if c > _EXACT:
            at = order[a:]
            n = count[at].astype(float)
            tables[at] = np.minimum(1 + rng.poisson(open_weight[at] / discount * (1 - n**-discount)), count[at])
            break
        t = np.arange(1, c + 1)
        for x in range(a, b, 1 << 14):
            at = order[x : min(b, x + (1 << 14))]
            log = stirling[c, 1 : c + 1] + np.log(open_weight[at])[:, None] * t
            p = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + (p < rng.random(len(at))[:, None] * p[:, -1:]).sum(axis=1)
    return tables


class PitmanYorModel:
    """Bigram restaurants over one shared unigram restaurant over a uniform base.

    A context is the class of the previous word: its hash cut to ``contexts`` values, so that the two
    numbers per context that all tasks need (customers and tables) are vectors of fixed length. Dishes
    are words by 64-bit hash. The base is uniform over the V training words and one unknown word, so
    probabilities add up to one. Discounts follow from the counts of ones and twos, n1 / (n1 + 2 n2).

    Work is dealt by dish: all contexts of a word are in one part, which thus knows the word's customers
    in the parent restaurant. Words with a large share in a small sample of texts (``hot``, at most 4
    per part) are dealt by context as well; their parent counts are added up centrally. The sample
    only balances work. Each round every part reseats its dishes given the other parts' totals of the
    last round (``inner`` times), then the totals are exchanged. Rounds after ``burn`` are samples;
    a token's probability is the average of the samples' predictive probabilities.
    """

    def __init__(self, contexts: int = 1 << 18, strength: float = 1.0, burn: int = 1, samples: int = 3, inner: int = 2, seed: int = 11):
        self.contexts, self.strength, self.burn, self.samples, self.inner, self.seed = contexts, strength, burn, samples, inner, seed

    def score(self, docs: DataFrame, learn: str, id: str = "doc_id", text: str = "text", chunk_tokens: int = 1 << 21) -> DataFrame:
        """Rows (id, n_tokens, n_known, train_tokens, base_score, score), one per row of ``docs``.

        ``learn`` is a boolean column: rows that teach the model. Null texts count as empty (one token,
        the end); repeated rows are scored and counted each; with nothing to learn every token has
        probability one. Texts are whole; A-Z is lower-cased and words are parted by ASCII white space.
        """
        spark, parts, contexts, strength = docs.sparkSession, shards(docs.sparkSession), self.contexts, self.strength
        if contexts > 1 << 22 or contexts & (contexts - 1):
            raise ValueError("contexts must be a power of two up to 2^22")
        shift = np.uint64(64 - int(contexts).bit_length() + 1)
        # Ids travel as text: a null among numbers would turn a pandas column into floats.
        rows = docs.select(F.col(id).cast("long").cast("string").alias("id"), F.coalesce(F.col(learn), F.lit(False)).alias("learn"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"))
        hot = self._hot_words(rows, parts)
        hot_hash = np.array(sorted(_hash(w) for w in hot), np.uint64)

        def messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state: dict = {}

            def clear() -> None:
                state.update(words={_END: 0, _START: 1}, tokens=[], before=[], doc=[], ids=[], none=[], learn=[], n=0)

            clear()
            chunk = 0
            for batch in batches:
                for i, learned, raw in zip(batch["id"], batch["learn"], batch["raw"]):
                    words = state["words"]
                    found = [words.setdefault(w, len(words)) for w in raw.lower().split()]
                    found.append(0)
                    state["tokens"].append(np.array(found, np.int64))
                    state["before"].append(np.array([1, *found[:-1]], np.int64))
                    state["doc"].append(len(found))
                    state["none"].append(i is None)
                    state["ids"].append(0 if i is None else int(i))
                    state["learn"].append(bool(learned))
                    state["n"] += len(found)
                    if state["n"] >= chunk_tokens or len(state["doc"]) >= 1 << 14:
                        yield pack(state, chunk)
                        chunk += 1
                        clear()
            if state["n"]:
                yield pack(state, chunk)

        def pack(state: dict, chunk: int) -> pd.DataFrame:
            from pyspark import TaskContext

            h = np.fromiter(map(_hash, state["words"]), np.uint64, len(state["words"]))
            word = np.concatenate(state["tokens"])
            context = (h >> shift)[np.concatenate(state["before"])]
            doc = np.repeat(np.arange(len(state["doc"])), state["doc"]).astype(np.uint64)
            key = np.sort((word.astype(np.uint64) << np.uint64(36)) | (context << np.uint64(14)) | doc)
            word, context, doc = (key >> np.uint64(36)).astype(np.int64), (key >> np.uint64(14)) & np.uint64(2**22 - 1), (key & np.uint64(2**14 - 1)).astype(np.uint16)
            split = np.isin(h, hot_hash)[word]
            part = np.where(split, context % np.uint64(parts), (h % np.uint64(parts))[word])
            order = np.argsort(part.astype(np.uint32), kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            ids, none, learned = np.array(state["ids"], np.int64), np.array(state["none"], np.uint8), np.array(state["learn"], np.uint8)
            size = np.array(state["doc"], np.int64)
            name = (TaskContext.get().partitionId() << 32) + chunk
            out = []
            for p in range(parts):
                at = order[bounds[p] : bounds[p + 1]]
                w, u = word[at], context[at].astype(np.int64)
                first = np.flatnonzero(np.append(True, np.diff(w) != 0)) if len(at) else np.zeros(0, np.int64)
                blob = _packed(np.diff(ids, prepend=0), none, learned, size, h[w[first]], np.diff(np.append(first, len(at))).astype(np.int32), np.diff(u, prepend=0).astype(np.int32), doc[at])
                out.append((p, name, blob))
            return pd.DataFrame(out, columns=["part", "chunk", "blob"])

        with bucketed(rows.mapInPandas(messages, "part int, chunk long, blob binary"), "part", parts) as laid:
            return self._run(laid, parts, hot_hash, id, docs.schema[id].dataType.simpleString())

    def _hot_words(self, rows: DataFrame, parts: int, texts: int = 2000) -> list[bytes]:
        n = rows.count()
        words = rows.sample(min(1.0, texts / max(n, 1)), seed=self.seed).select(F.explode(F.split(F.lower(F.col("raw").cast("string")), "[\\x20\\x09-\\x0D]+")).alias("w"))
        counts = words.groupBy("w").count()
        total = counts.agg(F.sum("count")).first()[0] or 0
        often = counts.where(F.col("count") * 4 * parts >= total).select("w").collect() if total else []  # at most 4 a part
        return [_END, *(r["w"].encode() for r in often if r["w"])]

    def _run(self, laid: DataFrame, parts: int, hot: np.ndarray, id: str, id_kind: str) -> DataFrame:
        spark, contexts, strength, seed = laid.sparkSession, self.contexts, self.strength, self.seed
        slices = 16
        cut = -(-contexts // slices)

        def gather(rows: pd.DataFrame) -> tuple:
            """A part's messages: per message (doc of tokens, ids, none, sizes, place), and pairs by (word, context)."""
            got = [_unpacked(b, "i8", "u1", "u1", "i8", "u8", "i4", "i4", "u2") for b in rows["blob"]]
            words, inverse = np.unique(np.concatenate([g[4] for g in got]), return_inverse=True)
            keys, learned, at = [], [], 0
            for _, _, learn, _, h, n, u, doc in got:
                w = np.repeat(inverse[at : at + len(h)], n)
                at += len(h)
                keys.append((w.astype(np.int64) << 24) | np.cumsum(u, dtype=np.int64))
                learned.append(learn[doc])
            pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(place, weights=np.concatenate(learned), minlength=len(pairs)).astype(np.int64)
            return got, words, pairs >> 24, pairs & (2**24 - 1), count, place

        def sliced(vector: np.ndarray) -> Iterator[tuple[int, bytes]]:
            for s in range(slices):
                yield s, _packed(vector[s * cut : (s + 1) * cut].astype(np.int64))

        def start(rows: pd.DataFrame) -> pd.DataFrame:
            _, words, w, u, c, _ = gather(rows)
            busy, seen = c > 1, c > 0
            total = np.bincount(w, weights=c, minlength=len(words)).astype(np.int64)
            ones = np.bincount(w[c == 1], minlength=len(words))
            alone = np.bincount(u[c == 1], minlength=contexts)
            types = np.bincount(w[seen], minlength=len(words))
            mine = np.isin(words, hot)
            heat = np.zeros((3, len(hot)), np.int64)
            heat[:, np.searchsorted(hot, words[mine])] = np.stack((total, types, types))[:, mine]
            rest = ~mine
            numbers = [c.sum(), ((total > 0) & rest).sum(), (c == 1).sum(), (c == 2).sum(), (types == 1)[rest].sum(), (types == 2)[rest].sum(), types.sum(), (types > 0)[rest].sum()]
            state = _packed(words, w[busy], u[busy].astype(np.int32), c[busy], np.ones(busy.sum(), np.int64), ones, types, (types > 0).astype(np.int64), alone.astype(np.int32))
            sent = [(int(rows["part"].iloc[0]), -1, state, [int(x) for x in numbers], heat[:2].ravel().tolist())]
            sent += [(-1, s, b, None, None) for s, b in sliced(np.bincount(u, weights=c, minlength=contexts))]
            sent += [(-1, slices + s, b, None, None) for s, b in sliced(np.bincount(u[seen], minlength=contexts))]
            return pd.DataFrame(sent, columns=["part", "slice", "blob", "numbers", "heat"])

        shape = "part int, slice int, blob binary, numbers array<long>, heat array<long>"

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"slice": rows["slice"].iloc[:1], "blob": [_packed(sum(_unpacked(b, "i8")[0] for b in rows["blob"]))]})

        def totals(table: DataFrame, vectors: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
            """Sums over all parts: vectors by context, numbers and hot words' counts, of fixed length each."""
            found = table.where("slice >= 0").select("slice", "blob").groupBy("slice").applyInPandas(add, "slice int, blob binary").collect()
            by = {r["slice"]: _unpacked(r["blob"], "i8")[0] for r in found}
            out = [np.concatenate([by.get(v * slices + s, np.zeros(cut, np.int64))[:cut] for s in range(slices)]) if by else np.zeros(contexts, np.int64) for v in range(vectors)]
            few = table.where("slice < 0").select("numbers", "heat").collect()  # a row per part
            numbers = np.sum([r["numbers"] for r in few], axis=0) if few else np.zeros(8, np.int64)
            heat = np.sum([r["heat"] for r in few], axis=0).reshape(2, -1) if few else np.zeros((2, len(hot)), np.int64)
            return out, numbers, heat

        state = materialise(laid.groupBy("part").applyInPandas(start, shape))
        (customers, tables), numbers, (hot_total, hot_types) = totals(state, 2)
        tokens, vocabulary = int(numbers[0]), int(numbers[1] + (hot_total > 0).sum())
        ones, twos = numbers[2], numbers[3]
        words1, words2 = numbers[4] + (hot_types == 1).sum(), numbers[5] + (hot_types == 2).sum()
        discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.05, 0.95))
        root_discount = float(np.clip(words1 / max(words1 + 2 * words2, 1), 0.05, 0.95))
        base = 1.0 / (vocabulary + 1)
        low, top = _stirling(discount), _stirling(root_discount)
        hot_tables, hot_roots = hot_types.astype(np.int64), (hot_types > 0).astype(np.int64)
        guests, root_tables = int(numbers[6]), int(numbers[7] + hot_roots.sum())

        def parent(t: np.ndarray, t0: np.ndarray, guests: int, root_tables: int) -> np.ndarray:
            return (np.maximum(t - root_discount * t0, 0) + (strength + root_discount * root_tables) * base) / (strength + guests)

        kept: list[tuple[np.ndarray, np.ndarray]] = []
        kinds = ["u8", "i8", "i4", "i8", "i8", "i8", "i8", "i8", "i4"]
        for r in range(self.burn + self.samples):
            hot_parent = parent(hot_tables, hot_roots, guests, root_tables)
            shared = spark.sparkContext.broadcast((tables.astype(np.int32), hot_parent))

            def reseat(batches: Iterator[pd.DataFrame], shared=shared, guests=guests, root_tables=root_tables, r=r) -> Iterator[pd.DataFrame]:
                tables, hot_parent = shared.value
                for batch in batches:
                    for part, blob in zip(batch["part"], batch["blob"]):
                        words, w, u, c, t, ones, t1, t0, alone = _unpacked(blob, *kinds)
                        rng = np.random.default_rng([seed, r, int(part)])
                        mine = np.isin(words, hot)
                        own = np.searchsorted(hot, words[mine])
                        for _ in range(self.inner):
                            above = parent(t1, t0, guests, root_tables)
                            above[mine] = hot_parent[own]
                            t = seat(c, (strength + discount * tables[u]) * above[w], discount, low, rng)
                            t1 = ones + np.bincount(w, weights=t, minlength=len(words)).astype(np.int64)
                            weight = np.full(len(words), (strength + root_discount * root_tables) * base)
                            t0 = np.where(t1 > 0, seat(t1, weight, root_discount, top, rng), 0)
                        above = parent(t1, t0, guests, root_tables)
                        heat = np.zeros(len(hot), np.int64)
                        heat[own] = t1[mine]
                        numbers = [int(t1.sum()), int(t0[~mine].sum())]
                        vector = alone + np.bincount(u, weights=t, minlength=contexts).astype(np.int64)
                        sent = [(int(part), -1, _packed(words, w, u, c, t, ones, t1, t0, alone), numbers, [*heat.tolist(), *heat.tolist()])]
                        sent += [(-1, s, b, None, None) for s, b in sliced(vector)]
                        yield pd.DataFrame(sent, columns=["part", "slice", "blob", "numbers", "heat"])

            before = state.where("slice < 0").select("part", "blob").repartition(parts, "part")
            state = materialise(before.mapInPandas(reseat, shape))
            (tables,), numbers, (hot_tables, _) = totals(state, 1)
            guests = int(numbers[0])
            rng = np.random.default_rng([seed, r])
            weight = np.full(len(hot), (strength + root_discount * root_tables) * base)
            hot_roots = np.where(hot_tables > 0, seat(hot_tables, weight, root_discount, top, rng), 0)
            root_tables = int(numbers[1] + hot_roots.sum())
            if r >= self.burn:
                kept.append((state, tables.astype(np.int32), parent(hot_tables, hot_roots, guests, root_tables), guests, root_tables))

        seen = [(guests, root_tables, above) for _, _, above, guests, root_tables in kept]
        vectors = spark.sparkContext.broadcast((customers, np.stack([t for _, t, _, _, _ in kept])))
        drawn = kept[0][0].where("slice < 0").select("part", F.lit(0).alias("sample"), "blob")
        for s, (table, *_) in enumerate(kept[1:], 1):
            drawn = drawn.union(table.where("slice < 0").select("part", F.lit(s).alias("sample"), "blob"))

        def answer(rows: pd.DataFrame, samples: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame(columns=["chunk", "blob"])
            customers, tables = vectors.value
            got, words, w, u, c, place = gather(rows)
            total = np.bincount(w, weights=c, minlength=len(words))
            mine = np.isin(words, hot)
            own = np.searchsorted(hot, words[mine])
            total[mine] = hot_total[own]
            p, busy = np.zeros(len(w)), c > 1
            for s, blob in zip(samples["sample"], samples["blob"]):
                guests, root_tables, hot_parent = seen[s]
                _, _, _, _, t, _, t1, t0, _ = _unpacked(blob, *kinds)
                above = parent(t1, t0, guests, root_tables)
                above[mine] = hot_parent[own]
                seated = np.minimum(c, 1)
                seated[busy] = t
                p += (c - discount * seated + (strength + discount * tables[s][u]) * above[w]) / (strength + customers[u])
            log_p = np.log10(p / len(samples))
            log_base = np.log10((total + 1) / (tokens + vocabulary + 1))
            known = (total > 0).astype(np.float64)
            out, at = [], 0
            for chunk, (ids, none, _, size, _, _, _, doc) in zip(rows["chunk"], got):
                mine_at = place[at : at + len(doc)]
                at += len(doc)
                sums = [np.bincount(doc, weights=x, minlength=len(ids)) for x in (log_p[mine_at], log_base[w[mine_at]], known[w[mine_at]])]
                out.append((chunk, _packed(ids, none, size, sums[0], sums[1], sums[2].astype(np.int32))))
            return pd.DataFrame(out, columns=["chunk", "blob"])

        def finish(rows: pd.DataFrame) -> pd.DataFrame:
            got = [_unpacked(b, "i8", "u1", "i8", "f8", "f8", "i4") for b in rows["blob"]]
            ids, none, size = got[0][:3]
            out = pd.DataFrame({"id": pd.array(np.cumsum(ids), "Int64"), "n_tokens": size, "n_known": sum(g[5].astype(np.int64) for g in got), "base_score": sum(g[4] for g in got), "score": sum(g[3] for g in got)})
            out.loc[none.astype(bool), "id"] = pd.NA
            return out

        told = laid.groupBy("part").cogroup(drawn.groupBy("part")).applyInPandas(answer, "chunk long, blob binary")
        result = told.groupBy("chunk").applyInPandas(finish, "id long, n_tokens long, n_known long, base_score double, score double")
        named = result.select(F.col("id").cast(id_kind).alias(id), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
        return materialise(named)
