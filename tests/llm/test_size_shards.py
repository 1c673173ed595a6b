import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from transferlens.llm import gray_simhash


def test_shards_of_sizes_that_cannot_link_do_not_meet(spark):
    n = 4096
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, n // 2, dtype=np.uint64).repeat(2)  # each code stands twice, so every shard could meet any other
    fp[1::2] ^= np.uint64(1) << rng.integers(0, 63, n // 2).astype(np.uint64)
    size = np.floor(1.9 ** rng.integers(2, 16, n)).astype(np.int64)
    size[1::2] = np.where(rng.random(n // 2) < 0.5, np.ceil(size[::2] * 0.8), np.floor(size[::2] * 0.7)).astype(np.int64)
    frame = pd.DataFrame({"fp": fp.view(np.int64), "key": np.arange(n), "label": np.arange(n), "size": size})
    nodes = spark.createDataFrame(frame).select("fp", "key", "label", "size")

    def listed(work):
        got, met = set(), 0
        for r in work.select("a", "b", "left", "right").collect():
            x, y = (np.frombuffer(raw, np.uint64).reshape(4, -1) for raw in (r["left"], r["right"]))
            met += x.shape[1] * y.shape[1]
            for block in gray_simhash.near_pairs(x, None if r["a"] == r["b"] else y, 14, ratio=0.8):
                got |= {tuple(sorted(p)) for p in block.tolist()}
        return got, met

    differ = np.bitwise_count(fp[:, None] ^ fp[None, :])
    small, great = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    wanted = {(int(a), int(b)) for a, b in zip(*np.nonzero((differ <= 14) & (small >= 0.8 * great))) if a < b}
    got, met = listed(gray_simhash._shard_pairs(nodes, n, 14, 512, 0.8))
    assert len(wanted) > 500 and got == wanted
    assert met < n * n / 2  # four shards that all met would make 0.62
    assert listed(gray_simhash._shard_pairs(nodes, n, 14, 512))[0] == wanted


def test_similar_groups_cut_their_shards_by_size(spark, monkeypatch):
    ratios, plain = [], gray_simhash._shard_pairs
    monkeypatch.setattr(gray_simhash, "_shard_pairs", lambda *args: ratios.append(args[4:]) or plain(*args))
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.xxhash64("id", F.lit(i)).cast("string") for i in range(12)]).alias("text"))
    assert gray_simhash.similar_groups(texts).where("doc_id <> component_id").count() == 0
    assert ratios == [(), (0.8,)]
