"""One registered query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transferlens.llm.column_bwt import remove_repeats
from transferlens.llm.common import fold, query, table, text_or_empty
from transferlens.llm.gray_simhash import components, fingerprints
from transferlens.llm.kd_search import top_k
from transferlens.llm.language import LanguageModel
from transferlens.llm.line_runs import remove_later_runs
from transferlens.llm.merge_dropout import round_trip
from transferlens.llm.periodic_runs import with_runs
from transferlens.llm.pitman_yor import PitmanYorModel
from transferlens.llm.residual_packing import pack, token_pieces
from transferlens.llm.rules import RuleEnsemble, with_statistics
from transferlens.llm.spotsigs import likeness, printed, with_next, with_signatures
from transferlens.llm.whitening import by_component, whiten
from transferlens.llm.window_doubling import remove_repeated_windows


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_pitman_yor_scores")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("learn", fold("doc_id", 7) != 2)
    scored = PitmanYorModel().score(docs, "learn")
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_rule_ensemble_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = RuleEnsemble().fit(docs, labels.where(fold("doc_id", 4) != 2))
    scored = with_statistics(docs.withColumn("held_out", fold("doc_id", 4) == 2), ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", model.score().alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query(
    "op3_kd_top_k",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


@query("op4_gray_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_merge_dropout")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op6_spotsigs_fingerprint")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    rows = with_next(with_signatures(docs, "text", "sigs"), "doc_id", ["text", "sigs"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_signatures(rows.withColumn("edited", edited), "edited", "edited_sigs")
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sigs")).alias("fingerprint"), printed(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


@query("op7_ftrl_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 5) == 0)
    model = LanguageModel().fit(docs.where("NOT held_out"))
    return model.predict(docs, ["doc_id", "held_out"])


@query("op8_column_bwt_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

    return remove_repeats(table(spark, sf_dir, "documents"), digest)


@query(
    "op9_line_run_dedup",
    """
WITH lines AS (
  SELECT doc_id, len(ls) AS n, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
named AS (SELECT *, CASE WHEN trim(line) = '' THEN '' ELSE line END AS name FROM lines),
pairs AS (SELECT *, lead(name) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM named),
later AS (
  SELECT doc_id, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY name, next ORDER BY doc_id, pos) AS k
    FROM pairs WHERE next IS NOT NULL AND NOT (name = '' AND next = ''))
  WHERE k > 1),
long_later AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, pos) AS k FROM named WHERE name <> '' AND length(line) >= 60)
  WHERE k > 1),
marks AS (SELECT DISTINCT doc_id, pos FROM (
  SELECT doc_id, pos FROM later UNION ALL SELECT doc_id, pos + 1 FROM later UNION ALL SELECT doc_id, pos FROM long_later)),
state AS (SELECT l.*, m.pos IS NOT NULL AS gone FROM lines l LEFT JOIN marks m USING (doc_id, pos)),
flow AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS before FROM state)
SELECT d.doc_id, coalesce(any_value(f.n), 0)::BIGINT AS n_lines, (count(*) FILTER (f.gone))::BIGINT AS n_removed,
       (count(*) FILTER (f.gone AND NOT f.before))::BIGINT AS n_runs,
       sha256(coalesce(string_agg(f.line, chr(10) ORDER BY f.pos) FILTER (NOT f.gone), '')) AS text_sha256
FROM documents d LEFT JOIN flow f ON d.doc_id = f.doc_id GROUP BY d.doc_id
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = remove_later_runs(docs, ["doc_id", "text"], long_line=60)
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(text_or_empty().cast("binary"), 256).alias("text_sha256"))


@query("op10_residual_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op11_whitened_vectors")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(*whiten(table(spark, sf_dir, "embeddings")))


def made_periodic(docs: DataFrame) -> DataFrame:
    """Of each document with h % 10 = 0 (h: crc32 of the id as text) the words from a on repeat with period p:
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10), n words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", text_or_empty().alias("text"), (h % 10 == 0).alias("_some"), F.floor(h / 10).alias("_g"))
    words = F.when(F.col("_some"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("_w", words).withColumn("_n", F.size("_w"))
    a = F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int")
    rows = rows.withColumn("_a", a).withColumn("_p", (F.floor((F.col("_n") - F.col("_a")) / (F.col("_g") % 8 + 3)) + 1).cast("int"))
    moved = F.transform("_w", lambda w, i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(made_periodic(table(spark, sf_dir, "documents")), to="found").select("doc_id", "found.*")
    # Greatest length, then smallest start, then smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed")
    rows = rows.select("doc_id", "n_runs", (-F.col("b")["s"]).alias("start"), F.col("b")["n"].alias("length"), (-F.col("b")["p"]).alias("period"), "lines", "collapsed")
    return rows.select(
        "doc_id", "n_runs", "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_window_doubling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "longest")

    return remove_repeated_windows(table(spark, sf_dir, "documents"), digest)
