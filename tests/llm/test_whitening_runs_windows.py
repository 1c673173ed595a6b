"""Whitening, periodic runs and window doubling against brute force: nulls, repeats, ties, clashing names, empty and long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from transferlens.llm import queries as q
from transferlens.llm.periodic_runs import maximal_repetitions, runs_of_texts, with_runs
from transferlens.llm.whitening import by_component, whiten
from transferlens.llm.window_doubling import remove_repeated_windows, window_names, word_hashes

BIG = 2**53


def words_of(text):
    return re.findall(r"[^ \t-\r]+", text or "")


# Whitening


def whitened_by_hand(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ vecs[:, ::-1] / np.sqrt(values[::-1]), values[::-1] / values.sum()


def test_whitening_equals_numpy_with_a_hot_vector(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 5)).tolist() + [[0.5, -0.25, 0.125, 1.0, 2.0]] * 200
    rows = [(BIG + 1 + 2 * i, v, "x") for i, v in enumerate(vectors)]
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, "x"), (2, [1.0, None, 0.0, 0.0, 0.0], "x"), (3, [nan] * 5, "x"), (4, [inf, 0.0, 0.0, 0.0, 0.0], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, weight string")
    out, model = whiten(df, components=4)
    got = {r["vec_id"]: r for r in out.collect()}
    n, deviation, white, explained = whitened_by_hand(vectors)
    assert model.n == n == 500 and len(got) == 500 and model.identity_error < 1e-9
    assert np.allclose(model.explained, explained[:4])
    z = np.array([got[r[0]]["whitened"] for r in rows])
    assert [got[r[0]]["deviation"] for r in rows] == deviation.tolist()
    assert np.allclose(np.abs(z), np.abs(white[:, :4]), atol=1e-8)
    signs = np.sign(z[0] * white[0, :4])
    assert np.allclose(z * signs, white[:, :4], atol=1e-8)


def test_whitening_keeps_null_and_repeated_ids(spark):
    rows = [(None, [0.0, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (BIG + 1, [0.5, 0.5]), (BIG + 3, [2.0, 0.25])]
    out, model = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(str(r["vec_id"]) for r in out.collect()) == sorted(str(r[0]) for r in rows)
    long = by_component(out, model).where(f"vec_id = {BIG + 1}").collect()
    assert [r["component"] for r in long] == [1, 2] and long[0]["n"] == 5


def test_whitening_without_variance_or_rows(spark):
    shape = "vec_id long, embedding array<double>"
    same, model = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], shape))
    assert [r["whitened"] for r in same.collect()] == [[], []] and by_component(same, model).count() == 0
    line, model = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [0.0, 0.0])], shape))
    assert len(model.eigenvalues) == 1 and model.explained[0] == pytest.approx(1)
    none, model = whiten(spark.createDataFrame([(1, None)], shape))
    assert model is None and by_component(none, model).count() == 0
    with pytest.raises(ValueError):
        whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], shape))


def test_whitening_query(spark, small_folder):
    got = q.op11(spark, small_folder).toPandas()
    vectors = spark.read.parquet(f"{small_folder}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, deviation, white, explained = whitened_by_hand(np.vstack(vectors["embedding"]))
    got = got.sort_values(["vec_id", "component"])
    assert len(got) == 32 * n and (got["n"] == n).all() and (got["identity_error"] < 1e-4).all()
    z = got["whitened"].to_numpy().reshape(n, 32)
    assert np.allclose(np.abs(z), np.abs(white[:, :32]), atol=1e-6)
    assert (got["deviation"].to_numpy().reshape(n, 32)[:, 0] == deviation).all()
    assert np.allclose(got["explained"].to_numpy().reshape(n, 32)[0], explained[:32])


# Periodic runs


def runs_by_hand(w, least):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if length >= max(least, 2 * p):
                part = w[i : i + length]
                if not any(all(part[k] == part[k + s] for k in range(length - s)) for s in range(1, p)):
                    out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 5, 8])
    w = [str(rng.randrange(k)) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 2))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)] + [str(rng.randrange(k)) for _ in range(rng.choice([0, 5]))]
    return w


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(1500):
        w, least = some_words(rng), rng.choice([2, 3, 5, 12])
        assert runs_of_texts([" ".join(w)], least)[0][1] == runs_by_hand(w, least), (w, least)


def test_stretches_are_no_shortcut():
    """The automaton over whole texts finds the same runs as over the stretches that repeat themselves."""
    rng = random.Random(4)
    texts = [some_words(rng) for _ in range(400)]
    by_stretch = [r for _, r in runs_of_texts([" ".join(w) for w in texts])]
    whole = [
        sorted(((s, e - s + 1, p) for (s, p), e in maximal_repetitions(w).items() if e - s + 1 >= 12), key=lambda r: (r[0], r[2])) for w in texts
    ]
    assert by_stretch == whole and sum(map(len, whole)) > 50


def test_fibonacci_words_have_many_runs():
    a, b = ["0"], ["0", "1"]
    while len(b) < 400:
        a, b = b, b + a
    assert runs_of_texts([" ".join(b)])[0][1] == runs_by_hand(b, 12)


def test_runs_of_a_table(spark):
    long = " ".join(["ab", "c"] * 60_000)
    rows = [(None, None), (1, ""), (2, "\x85  x"), (3, "a b c d " * 4), (3, "a b c d " * 4), (BIG + 1, long), (BIG + 3, "x " * 12 + "y " * 11)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, runs string, found int")
    got = with_runs(docs).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["found"])
    assert by_id[None][0]["n_words"] == 0 and by_id[None][0]["collapsed"] == "" and by_id[1][0]["runs"] == []
    assert by_id[2][0]["n_words"] == 2  # no-break spaces and next-line signs are no white space here
    assert [tuple(x) for x in by_id[3][0]["runs"]] == [(0, 16, 4)] and by_id[3][0]["collapsed"] == "a b c d" and len(by_id[3]) == 2
    assert [tuple(x) for x in by_id[BIG + 1][0]["runs"]] == [(0, 120_000, 2)] and by_id[BIG + 1][0]["collapsed"] == "ab c"
    assert [tuple(x) for x in by_id[BIG + 3][0]["runs"]] == [(0, 12, 1)]
    assert with_runs(docs.limit(0)).count() == 0 and got[0]["runs"] == "clash"


def test_runs_query(spark, small_folder):
    got = {r["doc_id"]: r for r in q.op12(spark, small_folder).collect()}
    docs = spark.read.parquet(f"{small_folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, text in docs:
        w, h = words_of(text), zlib.crc32(str(d).encode())
        n, g = len(w), h // 10
        if n > 1500:
            continue  # the hand-written version is quadratic
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(w, 12)
        gone = {k for s, m, p in runs for k in range(s + p, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        r = got[d]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


# Window doubling


def windows_by_hand(rows, width):
    """[(id, kept, n_words, n_removed, longest)] in the order of the rows."""
    docs = [(d, words_of(t)) for d, t in rows]

    def where(length):
        out = {}
        for d, w in docs:
            if d is not None:
                for i in range(len(w) - length + 1):
                    out.setdefault(tuple(w[i : i + length]), set()).add(d)
        return out

    lengths, length, first, out = [], width, where(width), []
    while max(map(len, (found := where(length)).values()), default=0) > 1:
        lengths.append((length, found))
        length *= 2
    for d, w in docs:
        gone, longest = set(), 0
        if d is not None:
            for i in range(len(w) - width + 1):
                if min(first[tuple(w[i : i + width])]) < d:
                    gone |= set(range(i, i + width))
            for n, found in lengths:
                if any(len(found[tuple(w[i : i + n])]) > 1 for i in range(len(w) - n + 1)):
                    longest = n
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone), longest))
    return out


def removed(spark, rows, width):
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, n_words int, kept string")
    return [tuple(r) for r in remove_repeated_windows(docs, lambda x: x, width).collect()]


def by_text(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("width", [2, 3, 13])
def test_windows_of_random_texts(spark, width):
    rng = random.Random(width)
    base = [str(rng.randrange(9)) for _ in range(400)]
    rows = [(None, " ".join(base[:60])), (None, None), (1, None), (2, ""), (3, " ".join(base[:80])), (3, " ".join(base[:80]))]
    for i in range(60):
        a = rng.randrange(350)
        part = base[a : a + rng.randrange(120)] + [str(rng.randrange(9)) for _ in range(rng.randrange(30))] + base[:9]
        rows.append((BIG + 2 * i + 1 if i % 2 else 10 + i, "\t\n".join(part) + " "))
    assert by_text(removed(spark, rows, width)) == by_text(windows_by_hand(rows, width))


def test_windows_of_copies_empty_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, long), (2, long), (0, long + " more"), *[(100 + i, "one two three four five six seven eight nine ten eleven twelve thirteen") for i in range(3000)]]
    got = {r[0]: r for r in removed(spark, rows, 13)}
    assert got[1][1:4] == ("", 100_000, 100_000) and got[0][3] == 0 and got[2][4] == 13 * 2**12
    assert got[100][3] == 0 and all(got[100 + i][3] == 13 and got[100 + i][4] == 13 for i in range(1, 3000))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_windows(empty, lambda x: x).count() == 0


def test_windows_query(spark, small_folder):
    got = {r["doc_id"]: r for r in q.op13(spark, small_folder).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{small_folder}/documents.parquet").select("doc_id", "text").collect()]
    for d, kept, n, gone, longest in windows_by_hand(rows, 13):
        r = got[d]
        assert (r["n_words"], r["n_removed"], r["longest"]) == (n, gone, longest)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert len(got) == len(rows) and any(r["n_removed"] for r in got.values())


def test_names_of_windows():
    words = np.random.default_rng(5).integers(0, 3, 500).astype(np.uint64)
    for width in (1, 2, 3, 7, 13):
        names = window_names(words, width)
        assert len(names) == 500 - width + 1
        by_name = {}
        for i, name in enumerate(names.tolist()):
            by_name.setdefault(name, set()).add(tuple(words[i : i + width].tolist()))
        assert all(len(s) == 1 for s in by_name.values()) and len(by_name) == len({w for s in by_name.values() for w in s})
    assert len(window_names(words[:3], 13)) == 0


def test_hashes_of_words(monkeypatch):
    from transferlens.llm import window_doubling

    rng = random.Random(6)
    words = ["".join(rng.choice("ab\u00a0\x85\u4e2d") for _ in range(rng.choice([1, 2, 5, 70, 200]))) for _ in range(3000)]
    raw = "".join(w + rng.choice([" ", "\t\n", "\x0b", "\r", "\x0c  "]) for w in words).encode()
    monkeypatch.setattr(window_doubling, "_CHUNK", 100)
    starts, first, second = word_hashes(raw)
    assert len(starts) == len(words) and [raw[s : s + 3] for s in starts] == [(w.encode() + raw[s + len(w.encode()) :][:3])[:3] for s, w in zip(starts, words)]
    monkeypatch.setattr(window_doubling, "_CHUNK", 1 << 20)
    assert all(np.array_equal(a, b) for a, b in zip((starts, first, second), word_hashes(raw)))  # wherever a word lies
    assert len(set(first.tolist())) == len(set(second.tolist())) == len(set(words)) == len(set(zip(words, first.tolist())))
    assert len(word_hashes(b"")[0]) == len(word_hashes(b" \n ")[0]) == 0
