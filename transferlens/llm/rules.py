"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into column expressions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from transferlens.session import materialise

STATISTICS = [
    "log_bytes", "log_words", "mean_word", "longest_word", "upper_share", "digit_share", "space_share",
    "punctuation_share", "symbol_share", "distinct_word_share", "distinct_line_share", "words_per_line",
]

#: Class of each byte: 0 other (bytes of longer characters too), 1 A-Z, 2 a-z, 3 digit, 4 space, 5 punctuation, 6 symbol.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[list(b".,;:'\"!?()-")] = 5
_CLASS[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 6


def _measure(text: str) -> list[float]:
    raw = text.encode()
    words, lines, n = raw.split(), raw.split(b"\n"), len(raw) or 1
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / n
    letters = max(len(raw) - raw.count(b" ") - raw.count(b"\n"), 0)
    return [
        math.log1p(len(raw)), math.log1p(len(words)), letters / max(len(words), 1), float(max(map(len, words), default=0)),
        kinds[1], kinds[3], kinds[4], kinds[5], kinds[6],
        len(set(words)) / max(len(words), 1), len(set(lines)) / len(lines), len(words) / len(lines),
    ]


@F.pandas_udf(StructType([StructField(s, DoubleType()) for s in STATISTICS]))
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_measure(t or "") for t in texts], columns=STATISTICS, dtype="float64")


def with_statistics(docs: DataFrame, keep: list[str | Column], text: str = "text") -> DataFrame:
    """The kept columns and one double per statistic of the whole text; null counts as empty."""
    return docs.select(*keep, _statistics(F.col(text).cast("string")).alias("_s")).select(
        *[F.col(f"`{c}`") for c in docs.select(*keep).columns], *[F.col(f"_s.{s}").alias(s) for s in STATISTICS]
    )


#: A rule is a conjunction of (statistic, "<=" or ">", cut).
Rule = tuple[tuple[str, str, float], ...]


def paths(forest_text: str, names: list[str]) -> list[Rule]:
    """Every path from a root to an inner or leaf node of the printed trees, as rules without repeats."""
    found: dict[Rule, None] = {}
    stack: list[tuple[int, tuple[str, str, float]]] = []
    for line in forest_text.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if re.match(r"\s*Tree \d+", line):
            stack = []
        if not m:
            continue
        depth = len(m[1])
        stack = [x for x in stack if x[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
        tight: dict[tuple[str, str], float] = {}
        for _, (s, op, cut) in stack:
            tight[s, op] = (min if op == "<=" else max)(cut, tight.get((s, op), cut))
        found[tuple(sorted((s, op, cut) for (s, op), cut in tight.items()))] = None
    return list(found)


def holds(rule: Rule) -> Column:
    """The rule as a boolean column expression."""
    parts = [F.col(s) <= cut if op == "<=" else F.col(s) > cut for s, op, cut in rule]
    return reduce(lambda a, b: a & b, parts)


@dataclass
class RuleEnsemble:
    """Lasso logistic weights over tree-path rules.

    Labelled rows for the fit are bounded by ``max_rows`` (those with the smallest id hashes): the
    model is small and more rows do not change it. With rows of one class only, or none, every text
    gets the smoothed share of label 1 ((ones + 1) / (rows + 2), so 0.5 without labels).
    """

    max_rows: int = 20_000
    trees: int = 16
    depth: int = 3
    penalty: float = 0.002
    seed: int = 7
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    intercept: float = 0.0

    def fit(self, docs: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality") -> RuleEnsemble:
        """``labels`` has ``id`` and a 0/1 ``label``; rows with nulls are not learned from."""
        chosen = (
            labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_y"))
            .where("_id IS NOT NULL AND _y IN (0, 1)").distinct()
            .orderBy(F.xxhash64("_id"), "_id", "_y").limit(self.max_rows)
        )
        # at most max_rows pairs of numbers are sent to the executors
        known = docs.join(F.broadcast(chosen), docs[id] == chosen["_id"]).withColumn("_t", docs["text"])
        rows = materialise(with_statistics(known, [F.col("_y").cast("double").alias("label")], "_t"))
        count = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        n, ones = sum(count.values()), count.get(1.0, 0)
        self.rules, self.intercept = [], math.log((ones + 1) / (n - ones + 1))
        if len(count) < 2:
            return self
        vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows)
        forest = RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, maxBins=64, seed=self.seed).fit(vectors)
        rules = paths(forest.toDebugString, STATISTICS)
        if not rules:
            return self
        names = [f"r{i}" for i in range(len(rules))]
        fires = rows.select("label", *[holds(r).cast("double").alias(n) for r, n in zip(rules, names)])
        fires = VectorAssembler(inputCols=names, outputCol="features").transform(fires)
        model = LogisticRegression(regParam=self.penalty, elasticNetParam=1.0, maxIter=40).fit(fires)
        self.intercept = float(model.intercept)
        self.rules = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w]
        return self

    def score(self) -> Column:
        """Probability of label 1 as one expression over the statistics columns."""
        total = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
