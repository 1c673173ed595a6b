import numpy as np

from transferlens.llm.gray_simhash import _digests, _distinct, _folded, similar_groups


def test_similar_texts_of_distant_fingerprints_are_joined(spark):
    """Texts at 0.8 whose fingerprints differ in over 14 bits."""
    rng, rows = np.random.default_rng(7), []
    for _ in range(2000):
        words = rng.integers(0, 10**9, 50).astype(str)
        other = words.copy()
        other[25] = "edited"
        (a, b), (x, y) = [(" ".join(w)) for w in (words, other)], [_digests(" ".join(w), 5) for w in (words, other)]
        u, v = _distinct(x), _distinct(y)
        common = len(np.intersect1d(u, v))
        if (_folded(x) ^ _folded(y)).bit_count() > 14 and common / (len(u) + len(v) - common) >= 0.8:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    assert len(rows) >= 40
    got = {r["doc_id"]: r["component_id"] for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(rows))}
