"""Operators on small tables with nulls, repeats, ties and clashing names, against brute force."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from transferlens.llm import queries as q
from transferlens.llm.column_bwt import remove_repeats
from transferlens.llm.common import linked
from transferlens.llm.gray_simhash import _sketch, components, fingerprints, gray_rank, link_codes, near_pairs, simhash, similar_groups
from transferlens.llm.kd_search import top_k
from transferlens.llm.language import LanguageModel
from transferlens.llm.line_runs import remove_later_runs
from transferlens.llm.merge_dropout import DropoutEncoder, decode_documents, encode_documents
from transferlens.llm.pitman_yor import PitmanYorModel, _stirling, seat
from transferlens.llm.residual_packing import best_fit, pack, token_pieces
from transferlens.llm.rules import RuleEnsemble, with_statistics
from transferlens.llm.spotsigs import likeness, near_duplicates, with_next, with_signatures

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 97} the{i % 5}" for i in range(4000))
TEXTS = [
    "the cat sat on the mat and looked at the moon over the hills beyond the river today",
    "the cat sat on the mat and looked at the moon over the hills beyond the river today",
    "", None, "x", "a\nb\na\nb\nc", "a\nb\nc\n\n\nd", "Ünïcödé ▁ text  with   spaces\tand\n\nlines ▁▁", LONG, LONG + " end",
    "don't <|endoftext|> stop 12 times", "\n\n\n", "1234 5678 !!!",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][i % 2], "s", None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_line_runs(docs, empty):
    got = rows_of(remove_later_runs(docs))
    assert got[5]["text"] == "a\nb\nc" and got[5]["n_removed"] == 2
    assert got[6]["text"] == "\n\nd" and got[6]["n_removed"] == 3
    assert got[3]["text"] is None and got[11]["text"] == "\n\n\n" and len(got) == len(TEXTS)
    assert got[1]["text"] == TEXTS[1]  # a single line is no run of two
    assert remove_later_runs(empty).count() == 0


def test_line_runs_of_three(spark):
    texts = ["p\nq\nr\ns", "q\nr\nz", "0\nq\nr\ns\n1", "p\nq\nr\ns"]
    got = rows_of(remove_later_runs(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA), min_lines=3))
    assert [got[i]["text"] for i in range(4)] == ["p\nq\nr\ns", "q\nr\nz", "0\n1", ""]


def test_repeated_bytes(spark, docs, empty):
    for width in (50, 10):
        got = rows_of(remove_repeats(docs, lambda d: d, width))
        seen = set()
        for i, t in enumerate(TEXTS):
            raw = (t or "").encode()
            windows = [raw[k : k + width] for k in range(len(raw) - width + 1)]
            gone = np.zeros(len(raw), bool)
            for k, w in enumerate(windows):
                gone[k : k + width] |= w in seen
            seen.update(windows)
            assert got[i]["kept"] == bytes(np.frombuffer(raw, np.uint8)[~gone]) and got[i]["n_removed"] == gone.sum()
    assert remove_repeats(empty, lambda d: d).count() == 0


def test_gray_links_equal_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    codes = [int(b) ^ sum(1 << int(k) for k in rng.integers(0, 64, n)) for b in base for n in (0, 1, 2, 3, 5, 8)]
    codes = np.unique(np.array(codes, np.uint64))
    codes = codes[np.argsort(gray_rank(codes))]
    label = list(range(len(codes)))
    for i, j in itertools.combinations(range(len(codes)), 2):
        if bin(int(codes[i] ^ codes[j])).count("1") <= 4 and label[i] != label[j]:
            label = [label[i] if x == label[j] else x for x in label]
    root = {int(a): int(b) for a, b in link_codes(codes, None, 4)}
    got = [root.get(int(c), int(c)) for c in codes]
    assert len(set(zip(label, got))) == len(set(label)) == len(set(got))


def test_near_duplicates_by_simhash(docs, empty):
    got = rows_of(components(fingerprints(docs)))
    assert got[1]["component_id"] == 0 and got[9]["component_id"] == 8
    assert got[2]["fp"] == got[3]["fp"] == 0 and got[3]["component_id"] == 2
    assert len(got) == len(TEXTS) and components(fingerprints(empty)).count() == 0
    assert simhash("One two") == simhash("one TWO") != 0


def test_near_pairs_equal_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    codes = np.array([int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, n))) for b in base for n in (0, 0, 5, 9, 13, 18)], np.uint64)
    codes = codes[np.argsort(gray_rank(codes), kind="stable")]
    rows = np.stack((codes, np.arange(len(codes)).astype(np.uint64), rng.integers(0, 40, len(codes)).astype(np.uint64)))
    want = {(i, j) for i, j in itertools.combinations(range(len(codes)), 2) if bin(int(codes[i] ^ codes[j])).count("1") <= 14 and rows[2][i] != rows[2][j]}
    assert want and {tuple(map(int, p)) for block in near_pairs(rows, None, 14) for p in block} == want
    half = len(codes) // 3
    across = {tuple(map(int, p)) for block in near_pairs(rows[:, :half], rows[:, half:], 14) for p in block}
    assert across == {(i, j) for i, j in want if i < half <= j}


def test_near_pairs_of_fitting_sizes():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 6, 300).astype(np.uint64)
    codes = codes[np.argsort(gray_rank(codes))]
    rows = np.stack((codes, np.arange(300, dtype=np.uint64), np.arange(300, dtype=np.uint64), rng.integers(1, 50, 300).astype(np.uint64)))
    size = rows[3].astype(int)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if int(codes[i] ^ codes[j]).bit_count() <= 2 and min(size[i], size[j]) >= 0.8 * max(size[i], size[j])}
    assert want and {tuple(map(int, p)) for block in near_pairs(rows, None, 2, ratio=0.8) for p in block} == want


def test_sketches_follow_jaccard():
    rng = np.random.default_rng(3)
    for n in (20, 300, 9_000):
        pool = rng.integers(0, 1 << 63, 3 * n).astype(np.uint64)
        shared = [(np.frombuffer(_sketch(pool[:n]), np.uint8) == np.frombuffer(_sketch(pool[a : a + n]), np.uint8)).mean() for a in (n // 9, n // 3, 2 * n)]
        assert shared[0] >= 0.6 and 0.3 < shared[1] < 0.7 and shared[2] < 0.1
    assert len(_sketch(np.zeros(0, np.uint64))) == 64


def test_similar_groups_of_unlike_near_codes(spark):
    """Texts of one base with many edits: none is 0.8 like another, so none is joined; copies and light edits are."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(120, 9, replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    rows += [(1_000, rows[7][1]), (1_001, rows[8][1] + " end"), (1_002, ""), (1_003, None)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, (t or "").split()) for i, t in rows)}
    assert max(len(sets[i] & sets[0]) / len(sets[i] | sets[0]) for i in range(1, 400)) < 0.8
    got = {r["doc_id"]: r["component_id"] for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: {1_000: 7, 1_001: 8, 1_003: 1_002}.get(i, i) for i, _ in rows}


def test_similar_groups_follow_jaccard(spark):
    """Pairs of 0.8 and more link also when their fingerprints are over 6 bits apart, others never."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        for cuts in (0, 3, 4, 5, 9):
            edited = list(words)
            for at in rng.permutation(38)[:cuts] * 5 + 4:
                edited[at] = "new"
            texts.append(" ".join(edited))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label, far = list(range(len(texts))), 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            apart = bin(simhash(texts[i], 5) ^ simhash(texts[j], 5)).count("1")
            far += 6 < apart <= 14
            if apart <= 14:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert far
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None)], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in similar_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == label
    assert len(corpus_pipeline.near_dedup(spark, docs, "").collect()) == len(set(label)) + 1


def test_linked(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8), (7, 7), (None, 2), (1, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in linked(edges).collect()} == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)], i) for i in range(300)] + [(300, None, 0), (301, [1.0, None], 0), (302, [float("nan")] * 6, 0), (303, [2.0], 0), (400, [0.5] * 6, 0), (401, [0.5] * 6, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for r in top_k(vectors, vectors.where("vec_id % 50 = 0"), shard_size=64, leaf=4, block=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    whole = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if v and None not in v and not any(map(math.isnan, v))}
    for i in (x for x in whole if x % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[i], v)), j) for j, v in whole.items() if j != i and len(v) == len(whole[i]))[:5]
        assert got[i] == [(-s, j) for s, j in scores]
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_merge_dropout(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    plain, sp = DropoutEncoder(path, 0.0), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in TEXTS:
        if t and "▁" not in t:
            assert plain.encode(t).tolist() == sp.encode(t)
    varied = DropoutEncoder(path, 0.3, seed=5)
    assert varied.encode(LONG, 1).tolist() != plain.encode(LONG).tolist()
    assert varied.encode(LONG, 1).tolist() == DropoutEncoder(path, 0.3, seed=5).encode(LONG, 1).tolist() != varied.encode(LONG, 2).tolist()
    back = rows_of(decode_documents(encode_documents(docs, path, 0.3), path))
    assert all(back[i]["text"] == (t or "") for i, t in enumerate(TEXTS))


def test_merge_dropout_side_by_side_equals_the_heap():
    coder = DropoutEncoder(public_tokenizers.path("piece_bpe_32k.model"), dropout=0.3)
    words = ["\u2581the", "\u2581internationalisation", "\u2581\u2581\u2581", "a", "\n", "\u2581na\u00efve", "\u2581\u732b\U0001f642x", "\u2581" + "ab" * 40, "z" * 63, "z" * 64]
    asked = [(w, v) for w in words for v in range(4)]
    ids, _ = coder._segment_many([w for w, _ in asked], np.array([v for _, v in asked], np.uint64))
    found = [ids.values[at : at + n].astype("<u4").tobytes() for at, n in zip(ids.first, ids.count)]
    assert found == [coder._segment(*a) for a in asked]
    texts = ["", "a \u2581 b\n\n c", "x" * 3_000, "one two " * 500]
    alone = [coder.encode(t, k).tolist() for k, t in enumerate(texts)]
    assert [x.tolist() for x in coder.encode_many(texts, [0, 1, 2, 3])] == alone
    assert [coder.decode(np.array(x, "<u4")) for x in alone] == texts


def test_merge_dropout_store_size_changes_no_result(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [LONG[i * 500 : i * 500 + 900] for i in range(12)] + ["", "a \u2581 b"]
    usual = [x.tolist() for x in DropoutEncoder(path, 0.3).encode_many(texts, list(range(14)))]
    monkeypatch.setattr("transferlens.llm.merge_dropout._STORED", 20)
    monkeypatch.setattr("transferlens.llm.merge_dropout._BLOCK", 2_000)
    assert [x.tolist() for x in DropoutEncoder(path, 0.3).encode_many(texts, list(range(14)))] == usual


def test_merge_dropout_draws_for_every_occurrence():
    path = public_tokenizers.path("piece_bpe_32k.model")
    coder, plain = DropoutEncoder(path, 0.1), DropoutEncoder(path, 0.0)
    word = "\u2581q"  # one merge
    assert plain._segment_many([word])[1].count.tolist() == [1]
    text = " ".join(["q"] * 20_000)
    shares = [(len(coder.encode(text, key)) - 20_000) / 20_000 for key in range(3)]
    assert all(0.09 < x < 0.11 for x in shares)
    texts = [LONG[:3_000], "a \u2581 na\u00efve \u732b\U0001f642x\n\n" + "ab" * 50 + " internationalisation" * 50]
    for key, t in enumerate(texts):
        alone = [coder._segment(w, int(n)) if w else coder.mark for w, n in zip(*coder._words(t, key))]
        assert coder.encode(t, key).tobytes() == b"".join(alone)
        assert coder.decode(coder.encode(t, key)) == t


def test_packing(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    got = collections.defaultdict(list)
    for r in token_pieces(docs, path, 64).collect():
        got[r["doc_id"]].append(r)
    for i, t in enumerate(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want = [(k, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(got[i], key=lambda r: r["piece"])] == want
    items = spark.range(3000).select((F.col("id") % 37 + 1).alias("length"), F.lit("x").alias("bin"))
    packed = pack(items, capacity=50, local=100, fanout=3).collect()
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(packed) == 3000
    for b in bins.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(b))]
        assert ends[-1] <= 50 and [o for o, _ in sorted(b)] == ends[:-1]
    assert len(bins) <= 1.03 * math.ceil(sum(r["length"] for r in packed) / 50)
    assert pack(token_pieces(empty, path)).count() == 0
    with pytest.raises(ValueError):
        pack(items, capacity=10)
    assert best_fit(np.array([6, 4, 5, 5]), 10)[0].max() == 1


def test_spotsigs(spark, docs, empty):
    sigs = {r["doc_id"]: set(r["s"]) for r in with_signatures(docs, "text", "s").collect()}
    assert sigs[0] == sigs[1] and all(sigs.values()) and len(sigs[0]) == 8
    got = {r["doc_id"]: r["next_text"] for r in with_next(docs, "doc_id", ["text"]).collect()}
    assert got == {i: TEXTS[(i + 1) % len(TEXTS)] for i in range(len(TEXTS))}
    pairs, members = near_duplicates(docs, 0.8)
    brute = {(i, j) for i, j in itertools.combinations(range(len(TEXTS)), 2) if len(sigs[i] & sigs[j]) / len(sigs[i] | sigs[j]) >= 0.8}
    of = {r["doc_id"]: r["class"] for r in members.collect()}
    linked_classes = {(r["a"], r["b"]) for r in pairs.collect()}
    assert {(i, j) for i, j in itertools.combinations(sorted(of), 2) if of[i] == of[j] or tuple(sorted((of[i], of[j]))) in linked_classes} == brute
    assert with_next(empty, "doc_id", ["text"]).count() == 0
    assert docs.select(likeness(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)))).first()[0] == 0.5


def test_rules(spark, empty):
    junk = [(i, f"BUY!!! $$$ ### {i} &&& ***", "", "", 0) for i in range(60)]
    fine = [(i, f"Quiet words number {i} follow one another here.", "", "", 0) for i in range(60, 120)]
    docs = spark.createDataFrame(junk + fine + [(200, None, "", "", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, text int")
    model = RuleEnsemble().fit(docs, labels)
    got = rows_of(with_statistics(docs, ["doc_id"]).withColumn("score", model.score()))
    assert all((got[i]["score"] >= 0.7) == (i >= 60) for i in range(120)) and 0 <= got[200]["score"] <= 1
    none = RuleEnsemble().fit(empty, labels)
    assert not none.rules and with_statistics(docs, ["doc_id"]).select(none.score()).first()[0] == 0.5


def test_language(spark, empty):
    words = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "žluťoučký kůň úpěl ďábelské".split()}
    rows = [(i, " ".join(words[k][(i + j) % 4] for j in range(6)), k, "", 0) for i, k in enumerate(["aa", "bb"] * 40)]
    docs = spark.createDataFrame([*rows, (200, None, "aa", "", 0), (201, "123 !", "bb", "", 0), (202, "kůň", None, "", 0)], SCHEMA)
    got = rows_of(LanguageModel().fit(docs).predict(docs, ["doc_id"]))
    assert all(got[r[0]]["lang_pred"] == r[2] and 0 <= got[r[0]]["score"] <= 1 for r in rows)
    assert got[200]["lang_pred"] == got[201]["lang_pred"] == "und" and got[202]["lang_pred"] == "bb"
    assert LanguageModel().fit(empty).predict(docs, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_pitman_yor(spark, docs, empty):
    marked = docs.withColumn("learn", F.when(F.col("doc_id") == 0, F.lit(None)).otherwise(F.col("doc_id") % 3 != 0)).withColumn("raw", F.lit(1))
    got = rows_of(PitmanYorModel().score(marked, "learn"))
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in enumerate(TEXTS)}
    count = collections.Counter(itertools.chain.from_iterable(words[i] for i in words if i % 3))
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in count for x in w), n) and r["score"] < 0
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    assert got[8]["score"] > got[8]["base_score"]
    nothing = rows_of(PitmanYorModel().score(docs.withColumn("learn", F.lit(False)), "learn"))
    assert all(abs(r["score"]) < 1e-9 for r in nothing.values())
    assert PitmanYorModel().score(empty.withColumn("learn", F.lit(True)), "learn").count() == 0


def test_seating_follows_the_conditional():
    d, a, c = 0.6, 1.5, 7
    weights = collections.Counter()  # all ways to seat 7 customers, by number of tables
    ways = {(1,): 1.0}
    for _ in range(c - 1):
        new = collections.Counter()
        for sizes, w in ways.items():
            for k in range(len(sizes)):
                new[tuple(sorted((*sizes[:k], sizes[k] + 1, *sizes[k + 1 :])))] += w * (sizes[k] - d)
            new[tuple(sorted((*sizes, 1)))] += w
        ways = new
    for sizes, w in ways.items():
        weights[len(sizes)] += w * a ** len(sizes)
    drawn = seat(np.full(40_000, c), np.full(40_000, a), d, _stirling(d), np.random.default_rng(0))
    for t, w in weights.items():
        assert abs((drawn == t).mean() - w / sum(weights.values())) < 0.01


def test_pipeline(spark, small_folder, docs, empty):
    source = spark.read.parquet(f"{small_folder}/documents.parquet")
    now = source
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, small_folder)
        if name != "best_fit_packing":
            assert now.columns == source.columns and now.select("doc_id").distinct().count() == now.count() <= source.count()
    assert now.count() == corpus_pipeline.run(spark, small_folder).count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small_folder).count() > 0 and stage(spark, empty, small_folder).count() == 0


def test_edited_fingerprints(spark, small_folder):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small_folder}/documents.parquet").collect()}
    order = sorted(texts)
    for r in q.op6(spark, small_folder).collect():
        t, following = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and (r["near_edited"] == 1) >= (edited == t)
