"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transferlens.session import discard, materialise

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed 1- to 3-grams of the lower-cased text and their counts; None if it has no letter.

    Characters that are not letters act as one blank between words.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.concatenate(([32], np.where(letter, points, 32), [32])).astype(np.uint64)
    blank = points == 32
    points = points[~(blank & np.roll(blank, 1)) | (np.arange(len(points)) == 0)]
    one = points[points != 32] * np.uint64(0x9E3779B97F4A7C15)
    two = points[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[1:] * np.uint64(0x165667B19E3779F9)
    three = two[:-1] * np.uint64(0xD6E8FEB86659FD93) + points[2:] * np.uint64(0xA0761D6478BD642F)
    hashes = (np.concatenate((one, two, three)) >> np.uint64(40)) % np.uint64(buckets)
    counts = np.bincount(hashes.astype(np.int64), minlength=buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def _probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits with the least loss against smoothed truth.

    The true class of n rows has the target (n+1)/(n+2) and the rest goes to the others, so the least
    loss lies at a finite temperature also where all rows are told apart.
    """
    n, k = logits.shape
    if k < 2 or not np.ptp(logits):
        return 1.0
    target = np.full((n, k), 1 / (n + 2) / max(k - 1, 1))
    target[np.arange(n), truth] = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        return -(target * np.log(np.maximum(_probabilities(logits / t), 1e-300))).sum() / n

    low, high = -7.0, 7.0  # of log t; the loss has one valley
    for _ in range(60):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    """N-gram document frequencies cover all training texts; labelled rows of the fit are bounded by ``max_rows``.

    Each epoch trains ``learners`` FTRL-proximal learners, each on its share of those rows by id hash, and
    averages their states as rows (language, bucket), so that the model does not depend on the cluster. The
    last tenth of the rows (by id hash) sets the temperature. The driver holds two arrays of
    languages x ``buckets``, whatever the size of the corpus.
    """

    max_rows: int = 10_000
    buckets: int = 1 << 15
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 3
    learners: int = 4
    unknown: str = "und"
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    temperature: float = 1.0

    def fit(self, docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
        """Learns from the rows of ``docs``; rows with a null language or id teach frequencies only."""
        spark, buckets = docs.sparkSession, self.buckets

        def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            df, n = np.zeros(buckets, np.int64), 0
            for batch in batches:
                for t in batch["t"]:
                    if found := grams(t, buckets):
                        df[found[0]] += 1
                        n += 1
            at = np.flatnonzero(df)
            yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df[at], n)})

        texts = docs.select(F.col(text).cast("string").alias("t"))
        seen = texts.mapInPandas(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # one row a bucket
        counted = np.zeros(buckets + 1)  # the last one counts texts
        counted[seen["bucket"].to_numpy(np.int64)] = seen["n"]
        df, n = counted[:-1], counted[-1]
        self.idf = idf = np.log((n + 1) / (df + 1)) + 1.0

        chosen = (
            docs.select(F.col(id).alias("_id"), F.col(lang).alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").distinct()
            .orderBy(F.xxhash64("_id"), "_id", "_y").limit(self.max_rows)
        )
        known = docs.join(F.broadcast(chosen), docs[id] == chosen["_id"]).select("_id", "_y", docs[text].cast("string").alias("t"))

        def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [grams(t, buckets) for t in batch["t"]]
                keep = [i for i, f in enumerate(found) if f]
                yield pd.DataFrame({
                    "_id": batch["_id"].iloc[keep], "y": batch["_y"].iloc[keep],
                    "at": [found[i][0].astype(np.int32) for i in keep], "x": [_weighted(*found[i], idf).astype(np.float32) for i in keep],
                })

        rows = known.mapInPandas(featurise, "_id long, y string, at array<int>, x array<float>")
        rows = rows.withColumn("u", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(10)))
        rows = materialise(rows.withColumn("learner", F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(self.learners)).cast("int")).repartition(self.learners, "learner"))
        self.languages = sorted(r["y"] for r in rows.select("y").distinct().collect())
        size = (max(len(self.languages), 1), buckets)
        z, s = np.zeros(size), np.zeros(size)
        self.weights = np.zeros(size, np.float32)
        if not self.languages:
            return self
        code = {y: i for i, y in enumerate(self.languages)}
        alpha, beta, l1, l2 = self.alpha, self.beta, self.l1, self.l2

        def solve(z: np.ndarray, s: np.ndarray) -> np.ndarray:
            return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(s)) / alpha + l2))

        def weighted(z: np.ndarray, s: np.ndarray, n: int) -> pd.DataFrame:
            language, bucket = np.nonzero(s)
            return pd.DataFrame({"language": language, "bucket": bucket, "z": n * z[language, bucket], "s": n * s[language, bucket]})

        taught = rows.where("u < 9").count()
        for _ in range(self.epochs):
            start = spark.sparkContext.broadcast((z, s))

            def learn(batches: Iterator[pd.DataFrame], start=start) -> Iterator[pd.DataFrame]:
                """The rows of a task are sorted by learner; each learner starts from the common state."""
                now, n = None, 0
                for batch in batches:
                    for learner, y, at, x in zip(batch["learner"], batch["y"], batch["at"], batch["x"]):
                        if learner != now:
                            if n:
                                yield weighted(z, s, n)
                            now, n, (z, s) = learner, 0, (a.copy() for a in start.value)
                        at, x = np.asarray(at), np.asarray(x, np.float64)
                        w = solve(z[:, at], s[:, at])
                        p = _probabilities(w @ x)
                        p[code[y]] -= 1.0
                        g = p[:, None] * x
                        old = s[:, at]
                        new = old + g * g
                        z[:, at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
                        s[:, at] = new
                        n += 1
                if n:
                    yield weighted(z, s, n)

            own = rows.where("u < 9").withColumn("order", F.xxhash64("_id", F.lit(3))).repartition(self.learners, "learner")
            own = own.sortWithinPartitions("learner", "order", "_id", "y").select("learner", "y", "at", "x")
            states = own.mapInPandas(learn, "language int, bucket int, z double, s double")
            found = states.groupBy("language", "bucket").agg(F.sum("z").alias("z"), F.sum("s").alias("s")).toPandas()  # languages x buckets at most
            if len(found):
                z, s = np.zeros(size), np.zeros(size)
                at = found["language"].to_numpy(), found["bucket"].to_numpy()
                z[at], s[at] = found["z"] / taught, found["s"] / taught
            start.unpersist()
        self.weights = weights = solve(z, s).astype(np.float32)

        def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"y": [code[y] for y in batch["y"]], "f": [(weights[:, a] @ x).tolist() for a, x in zip(batch["at"], batch["x"])]})

        apart = rows.where("u = 9").select("y", "at", "x").mapInPandas(logits, "y int, f array<double>").toPandas()  # a tenth of max_rows
        if len(apart):
            f, y = np.array(apart["f"].tolist()), apart["y"].to_numpy()
            self.temperature = _temperature(f, y)
        discard(rows)
        return self

    def predict(self, docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """The kept columns, lang_pred and score (its calibrated probability).

        Texts that are null or have no letter get ``unknown`` and 0.0, as does every text if nothing
        could be learned.
        """
        spark, buckets, unknown, languages, heat = docs.sparkSession, self.buckets, self.unknown, self.languages, self.temperature
        model = spark.sparkContext.broadcast((self.idf, self.weights))

        @F.pandas_udf("lang_pred string, score double")
        def guess(texts: pd.Series) -> pd.DataFrame:
            idf, weights = model.value
            out = []
            for t in texts:
                found = grams(t, buckets) if languages else None
                if found is None:
                    out.append((unknown, 0.0))
                    continue
                p = _probabilities(weights[:, found[0]] @ _weighted(*found, idf) / heat)
                best = int(p.argmax())
                out.append((languages[best], float(p[best])))
            return pd.DataFrame(out, columns=["lang_pred", "score"])

        return docs.select(*keep, guess(F.col(text).cast("string")).alias("_g")).select(*keep, "_g.lang_pred", "_g.score")
