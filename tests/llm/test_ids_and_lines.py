"""Null ids beside ids that floats cannot hold, repeated ids, clashing columns; texts of many lines."""

import time

import pytest
from pyspark.sql import functions as F

from transferlens.llm.column_bwt import remove_repeats
from transferlens.llm.line_runs import remove_later_runs
from transferlens.llm.merge_dropout import decode_documents, encode_documents, round_trip
from transferlens.llm.pitman_yor import PitmanYorModel
from transferlens.llm.queries import tokenizer_file
from transferlens.llm.residual_packing import pack, token_pieces

BIG = 2**53


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(BIG + 1 + 2 * i, f"text number {i} with some words\nand a line {i}", "clash") for i in range(20)]
    rows += [(None, "no id here", "clash"), (BIG + 1, "the same id again", "clash"), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, _t string").repartition(1)


def ids_of(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda i: (i is None, i))


def test_ids_are_kept(spark, docs):
    expected = ids_of(docs)
    pieces = token_pieces(docs, tokenizer_file("word_bpe_49k.json"))
    assert ids_of(pieces) == expected and ids_of(pack(pieces)) == expected
    model = tokenizer_file("piece_bpe_32k.model")
    encoded = encode_documents(docs, model)
    assert ids_of(encoded) == expected and ids_of(decode_documents(encoded, model)) == expected
    done = round_trip(docs, model)
    assert ids_of(done) == expected and done.where("NOT lossless").count() == 0
    assert ids_of(remove_repeats(docs, lambda rows: rows)) == expected
    assert ids_of(PitmanYorModel().score(docs.withColumn("learn", F.lit(True)), "learn")) == expected
    assert ids_of(remove_later_runs(docs)) == expected


def test_line_dedup_takes_time_in_proportion_to_the_lines(spark):
    lines = [f"line {i % 150_000}" for i in range(200_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:3]))], "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r for r in remove_later_runs(docs).select("doc_id", "n_lines", "n_removed", "text").collect()}
    assert got[1]["n_lines"] == 200_000 and got[1]["n_removed"] == 50_000 and got[1]["text"] == "\n".join(lines[:150_000])
    assert got[2]["n_removed"] == 3 and time.time() - start < 120


def test_blank_runs_stay_and_half_blank_runs_go(spark):
    docs = spark.createDataFrame([(1, "a\n\n\n\nb\n"), (2, "\n\n\n\nb\n"), (3, "\n\n\n")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in remove_later_runs(docs).collect()}
    assert got == {1: "a\n\n\n\nb\n", 2: "\n\n", 3: "\n\n\n"}


def test_long_single_lines_go_and_short_ones_stay(spark):
    """A line of 60 characters counts alone, also as a whole text, and once where a run covers it too."""
    long, other = "x" * 60, "y" * 59
    texts = [f"a\n{long}\nb\n{other}", long, other, f"c\n{long}\nd\n{other}\ne", f"{long}\nb\n{long}", " " * 70 + "\n" + " " * 70]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_runs"]) for r in remove_later_runs(docs, long_line=60).collect()}
    assert got[0] == (texts[0], 0, 0) and got[1] == ("", 1, 1) and got[2] == (other, 0, 0)
    assert got[3] == (f"c\nd\n{other}\ne", 1, 1) and got[4] == ("", 3, 1) and got[5] == (texts[5], 0, 0)
    plain = {r["doc_id"]: r["text"] for r in remove_later_runs(docs).collect()}
    assert plain[1] == long and plain[3] == texts[3] and plain[4] == long


def test_temperature_lies_inside_its_range():
    """Separable and mixed logits; the least loss of a fine grid is not better."""
    import numpy as np

    from transferlens.llm.language import _probabilities, _temperature

    rng = np.random.default_rng(7)
    truth = rng.integers(0, 3, 200)
    for mixed in (0.0, 2.0):
        logits = 5 * np.eye(3)[truth] + mixed * rng.normal(size=(200, 3))
        target = np.full((200, 3), 1 / 202 / 2)
        target[np.arange(200), truth] = 201 / 202
        loss = lambda t: -(target * np.log(_probabilities(logits / t))).sum()
        found = _temperature(logits, truth)
        assert 0.01 < found < 100 and loss(found) <= min(map(loss, np.geomspace(0.01, 100, 400))) + 1e-9
    assert _temperature(np.zeros((5, 3)), truth[:5]) == 1.0


def test_language_model_does_not_depend_on_the_partitions(spark):
    import numpy as np

    from transferlens.llm.language import LanguageModel

    words = {"aa": "alpha beta gamma delta", "bb": "uno dos tres cuatro"}
    rows = [(i, f"{words[k]} {words[k].split()[i % 4]} {i % 3}", k) for i in range(120) for k in ["aa", "bb"][i % 2 : i % 2 + 1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = LanguageModel().fit(docs.repartition(1)), LanguageModel().fit(docs.repartition(7))
    assert np.allclose(one.weights, many.weights, atol=1e-6) and abs(one.temperature - many.temperature) < 1e-6 and np.abs(one.weights).max() > 0
    got = one.predict(docs, ["doc_id", "lang"])
    assert got.where("lang <> lang_pred OR score <= 0.5 OR score >= 1").count() == 0
